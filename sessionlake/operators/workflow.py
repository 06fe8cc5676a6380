"""Operator turns, instruction signals and workflow events by episode."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from ..functions import rules as R
from ..functions import text as X


def _order():
    return Window.partitionBy("conv_id").orderBy("idx")


def operator_turns(turns: DataFrame) -> DataFrame:
    """What a person typed: user turns that follow no tool call and are no machine envelope."""
    after_tool = F.coalesce(F.lag(F.col("tool").isNotNull()).over(_order()), F.lit(False))
    c = X.trim(F.col("content"))
    t = turns.withColumn("after_tool", after_tool)
    return t.where((F.col("role") == "user") & ~F.col("after_tool") & (c != "") & ~X.matches(c, R.MACHINE_ENVELOPE) & ~X.matches(c, R.NOTIFICATION)).drop("after_tool")


def pole(signals: Column) -> Column:
    has = lambda names: F.arrays_overlap(signals, F.array(*map(F.lit, names)))
    return F.when(has(["stop-and-report", "one-writer", "spec-freeze"]), "determinism-impose").when(has(R.AUTONOMY), "autonomy-grant").when(F.size(signals) > 0, "determinism-impose")


def inventory(turns: DataFrame) -> DataFrame:
    """signal, matching turns, distinct conversations, with zeros."""
    seen = operator_turns(turns).select("conv_id", F.explode(X.signals(F.col("content"))).alias("signal"))
    g = seen.groupBy("signal").agg(F.count("*").alias("n"), F.countDistinct("conv_id").alias("c"))
    names = turns.sparkSession.createDataFrame([(s, p) for s, p, _ in R.SIGNALS], "signal string, pole string")
    return names.join(g, "signal", "left").select("signal", "pole", F.coalesce("n", F.lit(0)).alias("matching_turns"), F.coalesce("c", F.lit(0)).alias("conversations"))


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Compatibility forms; Spark has no function for it, and only classified turns come here."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def normalised(content: Column) -> Column:
    """A statement's text for comparison: redacted, one letter case, single spaces."""
    return X.trim(F.regexp_replace(F.lower(nfkc(X.redact(content))), X.SPACES, " "))


def episode(turns: DataFrame) -> Column:
    """Opaque id of a session's lineage: of its resume id, else of its own."""
    own = F.col("id") if "id" in turns.columns else F.col("conv_id").cast("string")
    resume = F.col("resume_id") if "resume_id" in turns.columns else F.lit(None).cast("string")
    kind = F.when(resume.isNull(), "conversation").otherwise("resume")
    return F.sha2(F.concat_ws("|", F.lit("episode"), "provider", "harness", kind, F.coalesce(resume, own)), 256)


def events(turns: DataFrame) -> DataFrame:
    """One row per classified operator turn and kind, with its statement, episode and retained policy."""
    c = F.col("content")
    question = c.rlike(R.QUESTION_END) & X.matches(c, R.QUESTION_WORD)
    s = X.signals(c)
    own = lambda names: F.array_sort(F.filter(s, lambda x: x.isin(names)))
    approval = X.matches(c, R.APPROVAL_CHANGE) & ~question & ~X.matches(c, R.APPROVAL_PROHIBITION)
    autonomy = ~question & ((F.size(own(R.AUTONOMY)) > 0) | X.matches(c, R.AUTONOMOUS_INTEGRATION))
    row = lambda kind, names: F.struct(F.lit(kind).alias("kind"), names.alias("signals"))
    either = F.array_compact(F.array(F.when(autonomy, row(R.KINDS[1], own(R.AUTONOMY))), F.when(F.size(own(R.OWNERSHIP)) > 0, row(R.KINDS[2], own(R.OWNERSHIP)))))
    kinds = F.when(approval, F.array(row(R.KINDS[0], F.array_sort(s)))).otherwise(either)
    t = operator_turns(turns).where(~X.matches(c, R.CONTROL_ENVELOPE)).withColumn("e", F.explode(kinds)).select("*", "e.kind", "e.signals").drop("e")
    retained = F.when(F.col("kind") == R.KINDS[0], F.array_join(X.named(c, R.RETAINED), "|"))
    t = t.withColumns({"said": normalised(c), "statement_text": X.snippet(c, R.STATEMENT), "episode": episode(t), "retained": retained})
    return t.where("said != ''").withColumns({"statement": F.sha2("said", 256), "day": F.date_format(F.timestamp_seconds("at_s"), "yyyy-MM-dd")}).drop("said")


def grouped(events: DataFrame, roles: DataFrame) -> DataFrame:
    """Events of one kind, statement, episode and UTC day are one; copies in other conversations are counted.

    roles: conv_id, role.  id, kind, statement, episode, day, at_s, conversations, collapsed, and sorted sets of
    projects, harnesses, roles and signals; statement_text, retained and evidence of the first ones."""
    key = ["kind", "statement", "episode", "day"]
    e = events.join(roles.select("conv_id", F.col("role").alias("agent")), "conv_id", "left")
    first = F.min(F.struct("at_s", F.col("conv_id").alias("conversation"), F.col("idx").alias("turn"), "statement_text", "retained")).alias("first")
    each = e.groupBy(*key, "conv_id").agg(first, *(F.collect_set(F.nullif(F.col(c), F.lit(""))).alias(c) for c in ("project", "harness")), F.collect_set("agent").alias("agent"), F.flatten(F.collect_set("signals")).alias("signals"))
    nth = F.row_number().over(Window.partitionBy(*key).orderBy("first"))
    each = each.withColumn("shown", F.when(nth <= R.EVENT_EVIDENCE, F.struct("first.at_s", "first.conversation", "first.turn")))
    merged = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c))))
    g = each.groupBy(*key).agg(F.min("first").alias("first"), F.count("*").alias("conversations"), merged("project").alias("projects"), merged("harness").alias("harnesses"), merged("agent").alias("agents"), merged("signals").alias("signals"), F.array_sort(F.collect_list("shown")).alias("evidence"))
    ordered = F.filter(F.array(*map(F.lit, R.AGENT_ROLES)), lambda r: F.array_contains("agents", r))
    return g.select(
        F.sha2(F.concat_ws(":", F.lit("workflow-event"), *key), 256).alias("id"), *key, F.col("first.at_s").alias("at_s"), "conversations", (F.col("conversations") - 1).alias("collapsed"),
        "projects", "harnesses", ordered.alias("roles"), "signals", F.col("first.statement_text").alias("statement_text"), F.col("first.retained").alias("retained"), "evidence",
    )


def summary(turns: DataFrame, events: DataFrame, groups: DataFrame) -> DataFrame:
    """One row: what was scanned, and events by kind."""
    scanned = operator_turns(turns).where(~X.matches(F.col("content"), R.CONTROL_ENVELOPE))
    n = F.count("*")
    parts = [
        turns.agg(F.lit("conversations").alias("measure"), F.countDistinct("conv_id").alias("n")), turns.select(episode(turns).alias("e")).agg(F.lit("episodes").alias("measure"), F.countDistinct("e").alias("n")),
        scanned.agg(F.lit("operator_turns").alias("measure"), n.alias("n")), events.agg(F.lit("candidates").alias("measure"), n.alias("n")),
        groups.agg(F.lit("collapsed").alias("measure"), F.coalesce(F.sum("collapsed"), F.lit(0)).alias("n")), *(groups.where(F.col("kind") == k).agg(F.lit(k).alias("measure"), n.alias("n")) for k in R.KINDS),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def coalesced(turns: DataFrame) -> DataFrame:
    """Consecutive turns of one role as one message, with strictly increasing times."""
    t = turns.where("role IN ('user', 'assistant')")
    new = F.when(F.col("role") == F.lag("role").over(_order()), 0).otherwise(1)
    t = t.select("conv_id", "idx", "role", "at_s", "content", new.alias("new")).withColumn("part", F.sum("new").over(_order()))
    m = t.groupBy("conv_id", "part").agg(F.first("role").alias("role"), F.count("*").alias("turns"), F.min("at_s").alias("own_s"), F.sum(F.length("content")).alias("characters"))
    w = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    return m.withColumn("at_s", F.max(F.col("own_s") - F.col("part")).over(w) + F.col("part"))
