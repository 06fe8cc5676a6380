"""Recurring workflow patterns: events of one kind, signal and agent role over distinct episodes and days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import rules as R
from ..functions import text as X

KEY = ["kind", "signal", "role"]
RELATIONS = ["introduced", "reinforced", "reformulated", "returned-to-prior"]
#: Measure, and whether more of it is favourable.
ASSOCIATED = {"completion": True, "friction": False, "rework": False}


def memberships(groups: DataFrame) -> DataFrame:
    """One row per event, signal and role; events without signals or roles take their kind's general signal, and no role."""
    approval = F.col("kind") == R.KINDS[0]
    general = F.when(F.col("kind") == R.KINDS[1], "autonomy-general").otherwise("ownership-general")
    signals = F.when(approval, F.array_distinct(F.concat(F.array(F.lit("approval-policy")), "signals"))).when(F.size("signals") > 0, F.col("signals")).otherwise(F.array(general))
    roles = F.when(F.size("roles") > 0, F.col("roles")).otherwise(F.array(F.lit("unclassified")))
    shared = (F.size(signals) * F.size(roles) > 1).alias("shared")
    return groups.select("*", shared, F.explode(signals).alias("signal")).withColumn("role", F.explode(roles))


def occurrences(members: DataFrame) -> DataFrame:
    """The last event of each episode in a pattern, in order, with its relation to what was said before."""
    best = members.groupBy(*KEY, "episode").agg(F.max(F.struct("at_s", "id", "statement", "statement_text", "day")).alias("b")).select(*KEY, "episode", "b.*")
    w = Window.partitionBy(*KEY).orderBy("at_s", "id")
    seen = F.row_number().over(Window.partitionBy(*KEY, "statement").orderBy("at_s", "id"))
    relation = F.when(F.row_number().over(w) == 1, RELATIONS[0]).when(F.lag("statement").over(w) == F.col("statement"), RELATIONS[1]).when(seen > 1, RELATIONS[3]).otherwise(RELATIONS[2])
    return best.withColumn("relation", relation)


def _effect() -> Column:
    latitude, gate = "operating-latitude-expanded", "approval-gate-relaxed"
    s = F.col("signal")
    return F.when(s.isin(R.GUARDRAILS), "guardrail-imposed").when(s.isin(R.AUTONOMY), latitude).when((s == "approval-policy") | (F.col("kind") == R.KINDS[0]), gate).when(F.col("kind") == R.KINDS[1], latitude).otherwise("guardrail-imposed")


def _associated(name: str, more: bool) -> list[Column]:
    """Samples, directions and median of a measure's changes over the observed events of a pattern."""
    v = F.when(F.col("status") == "observed", F.col(f"{name}_change"))
    enough = lambda x: F.when(F.count(v) >= R.SAMPLES, x)
    good = v if more else -v
    return [F.count(v).alias(f"{name}_samples"), enough(F.count_if(good > 0)).alias(f"{name}_favorable"), enough(F.count_if(good < 0)).alias(f"{name}_unfavorable"), enough(F.count_if(v == 0)).alias(f"{name}_unchanged"), enough(X.half_up(F.median(v))).alias(f"{name}_median")]


def patterns(groups: DataFrame, comparisons: DataFrame) -> DataFrame:
    """One row per pattern that passes the floors of distinct episodes and days."""
    members = memberships(groups)
    o = occurrences(members).join(comparisons.select("id", "status", *(f"{n}_change" for n in ASSOCIATED)), "id", "left")
    last = lambda c: F.max(F.struct("at_s", "id", c))[c]
    seen = F.count_if(F.col("status") == "observed")
    g = o.groupBy(*KEY).agg(
        F.count("*").alias("episodes"), F.countDistinct("day").alias("days"), F.countDistinct("statement").alias("formulations"), F.min("at_s").alias("first"), F.max("at_s").alias("last"),
        *(F.count_if(F.col("relation") == r).alias(r.replace("-", "_")) for r in RELATIONS), last("relation").alias("latest"),
        seen.alias("observed"), (F.count("*") - seen).alias("sparse"), *(c for n, more in ASSOCIATED.items() for c in _associated(n, more)),
    ).where(f"episodes >= {R.PATTERN_EPISODES} AND days >= {R.PATTERN_DAYS}")
    sets = members.groupBy(*KEY).agg(F.count("*").alias("memberships"), F.count_if("shared").alias("shared"), *(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))), "|").alias(c) for c in ("projects", "harnesses")))
    labels = F.create_map(*(F.lit(x) for kv in R.SIGNAL_LABELS.items() for x in kv))
    who = F.when(F.col("role") == "unclassified", "Agents").otherwise(F.concat(F.initcap("role"), F.lit(" agents")))
    return g.join(sets, KEY).select(
        F.sha2(F.concat_ws(":", F.lit("workflow-pattern"), *KEY), 256).alias("id"), *KEY, F.concat(who, F.lit(": "), labels[F.col("signal")]).alias("title"), _effect().alias("effect"),
        "memberships", "shared", "episodes", "days", "formulations", (F.col("memberships") - F.col("episodes")).alias("collapsed"), "projects", "harnesses", "first", "last",
        *(r.replace("-", "_") for r in RELATIONS), "latest", F.when(F.col("observed") >= R.SAMPLES, "observed").otherwise("insufficient-coverage").alias("outcome"), "observed", "sparse",
        *(f"{n}_{m}" for n in ASSOCIATED for m in ("samples", "favorable", "unfavorable", "unchanged", "median")),
    )


def examples(groups: DataFrame) -> DataFrame:
    """The first, the first reformulated, the first returned and the last event of each pattern, at most PATTERN_EXAMPLES, in that order."""
    o = occurrences(memberships(groups))
    w = Window.partitionBy(*KEY).orderBy("at_s", "id")
    n = F.row_number().over(w)
    total = F.count("*").over(Window.partitionBy(*KEY))
    nth = F.row_number().over(Window.partitionBy(*KEY, "relation").orderBy("at_s", "id"))
    slot = F.when(n == 1, 0).when((F.col("relation") == "reformulated") & (nth == 1), 1).when((F.col("relation") == "returned-to-prior") & (nth == 1), 2).when(n == total, 3)
    return o.withColumn("slot", slot).where(F.col("slot").isNotNull()).select(*KEY, "slot", "id", "relation", "at_s", "statement_text")


def timeline(groups: DataFrame) -> DataFrame:
    """The newest PATTERN_TIMELINE occurrences of each pattern."""
    o = occurrences(memberships(groups))
    n = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("at_s"), F.desc("id")))
    return o.withColumn("n", n).where(F.col("n") <= R.PATTERN_TIMELINE).select(*KEY, "n", "id", "episode", "at_s", "relation", "statement")
