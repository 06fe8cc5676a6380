"""Structure derived from turns: problems, decisions, gates, attempts, topics and outcome."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import rules as R
from ..functions import text as X

LAST = {"problems": 40, "decisions": 50, "gates": 40, "signals": 20, "attempts": 80}


def _order():
    return Window.partitionBy("conv_id").orderBy("idx")


def control(content):
    """Messages that a harness puts in a person's place."""
    hit = X.matches(content, R.CONTROL_MESSAGE)
    for mark in R.CONTROL_MARKS:
        hit = hit | F.contains(content, F.lit(mark))
    return hit


def marked(turns: DataFrame) -> DataFrame:
    """Turns with what the rules see in them and in their neighbours."""
    after_tool = F.coalesce(F.lag(F.col("tool").isNotNull()).over(_order()), F.lit(False))
    c = F.col("content")
    return turns.withColumn("after_tool", after_tool).withColumns({
        "problem": (F.col("role") == "user") & ~F.col("after_tool") & X.matches(c, R.PROBLEM) & ~control(c),
        "decision": F.col("role").isin("assistant", "system") & X.matches(c, R.DECISION),
        "gate": ((F.col("role") == "assistant") | (F.col("role") == "tool") | F.col("after_tool")) & X.matches(c, R.GATE),
        "signal": X.signal(c),
    })


def newest(rows: DataFrame, n: int) -> DataFrame:
    """The last n rows of each conversation."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("idx"))
    return rows.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= n).drop("__k")


def problems(turns: DataFrame) -> DataFrame:
    return newest(marked(turns).where("problem"), LAST["problems"]).select("conv_id", "idx", X.snippet(F.col("content")).alias("snippet"), F.array_join(X.categories(F.col("content")), "|").alias("categories"))


def gate_result():
    """A zero exit code is a success unless the text also tells of failure alone."""
    return F.when(X.matches(F.col("content"), R.ZERO_EXIT) & (F.col("signal") != "failure"), "success").otherwise(F.col("signal"))


def gates(turns: DataFrame) -> DataFrame:
    """Turns that tell how a gate went."""
    told = marked(turns).where("gate").withColumn("result", gate_result()).where("result != 'unknown'")
    return newest(told, LAST["gates"])


def attempts(turns: DataFrame) -> DataFrame:
    """Tool turns of the assistant: what was meant (its own text, else that of up to four turns before), tools, and the next turn's signal."""
    c = F.when((F.col("role") == "assistant") & (F.col("content") != ""), F.col("content"))
    before = F.last(c, ignorenulls=True).over(_order().rowsBetween(-4, -1))
    used = F.col("tools") if "tools" in turns.columns else F.array_compact(F.array("tool"))
    m = marked(turns).withColumns({"next": F.lead("signal").over(_order()), "before": before, "tools": used})
    meant = F.coalesce(F.nullif(F.col("content"), F.lit("")), "before", F.concat(F.lit("Called "), F.array_join("tools", ", ")))
    rows = m.where("role = 'assistant' AND tool IS NOT NULL").withColumns({"outcome": F.coalesce("next", F.lit("unknown")), "meant": meant})
    return newest(rows, LAST["attempts"]).select("conv_id", "idx", "tool", "tools", "outcome", X.snippet(F.col("meant")).alias("snippet"))


def decisions(turns: DataFrame) -> DataFrame:
    return newest(marked(turns).where("decision"), LAST["decisions"]).select("conv_id", "idx", X.snippet(F.col("content")).alias("snippet"))


def told(turns: DataFrame) -> DataFrame:
    """conv_id, idx, signal, snippet of turns that tell of success or failure: the assistant's and gates'."""
    own = newest(marked(turns).where("role = 'assistant' AND signal != 'unknown'"), LAST["signals"])
    cut = X.snippet(F.col("content")).alias("snippet")
    return own.select("conv_id", "idx", "signal", cut).unionByName(gates(turns).select("conv_id", "idx", F.col("result").alias("signal"), cut))


def observed(turns: DataFrame) -> DataFrame:
    """status, problems, known and failed attempts of each conversation, in one pass over its turns.

    status: the later of success and failure; mixed when both are within 5 turns; unknown without either."""
    last = lambda hit, n: hit & (F.count(F.when(hit, 1)).over(Window.partitionBy("conv_id").orderBy(F.desc("idx"))) <= LAST[n])
    m = marked(turns).withColumns({"next": F.coalesce(F.lead("signal").over(_order()), F.lit("unknown")), "result": gate_result()})
    m = m.withColumns({
        "own": last((F.col("role") == "assistant") & (F.col("signal") != "unknown"), "signals"),
        "gated": last(F.col("gate") & (F.col("result") != "unknown"), "gates"),
        "tried": last((F.col("role") == "assistant") & F.col("tool").isNotNull(), "attempts"),
        "problem": last(F.col("problem"), "problems"),
    })
    newest = lambda kind: F.max(F.when((F.col("own") & (F.col("signal") == kind)) | (F.col("gated") & (F.col("result") == kind)), F.col("idx")))
    g = m.groupBy("conv_id").agg(
        newest("success").alias("good"), newest("failure").alias("bad"), F.count_if("problem").alias("problems"),
        F.count_if(F.col("tried") & (F.col("next") != "unknown")).alias("known"), F.count_if(F.col("tried") & (F.col("next") == "failure")).alias("failed"),
    )
    both = F.col("good").isNotNull() & F.col("bad").isNotNull()
    status = F.when(both & (F.abs(F.col("good") - F.col("bad")) <= 5), "mixed").when(F.col("bad").isNull() & F.col("good").isNull(), "unknown").when(F.col("bad").isNull() | (F.col("good") > F.col("bad")), "success").otherwise("failure")
    return g.select("conv_id", status.alias("status"), "problems", "known", "failed")


def outcomes(turns: DataFrame) -> DataFrame:
    """status per conversation."""
    return observed(turns).select("conv_id", "status")


def outcome_evidence(turns: DataFrame, n: int = 6) -> DataFrame:
    """The newest n turns that tell an outcome, one of each turn and snippet."""
    t = told(turns).dropDuplicates(["conv_id", "idx", "snippet"])
    w = Window.partitionBy("conv_id").orderBy(F.desc("idx"), "snippet")
    return t.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select("conv_id", "rank", "idx", "snippet")


def metrics(turns: DataFrame) -> DataFrame:
    """Turns, characters and turns by role of each conversation."""
    by = turns.groupBy("conv_id", "role").agg(F.count("*").alias("n"), F.sum(F.length("content")).alias("c"))
    return by.groupBy("conv_id").agg(F.sum("n").alias("turns"), F.sum("c").alias("characters"), F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "role", F.col("n").cast("string")))), "|").alias("roles"))


def topics(turns: DataFrame, n: int = 24) -> DataFrame:
    """term, distinct turns, first three turn indices: the n commonest per conversation."""
    plain = turns.where(~((F.col("role") == "user") & control(F.col("content"))))
    t = plain.select("conv_id", "idx", F.explode(X.terms(F.col("content"))).alias("term"))
    g = t.groupBy("conv_id", "term").agg(F.countDistinct("idx").alias("turns"), F.array_join(F.slice(F.array_sort(F.collect_set("idx")), 1, 3), "|").alias("first"))
    w = Window.partitionBy("conv_id").orderBy(F.desc("turns"), "term")
    return g.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
