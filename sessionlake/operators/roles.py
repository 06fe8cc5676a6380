"""The role that an agent had in a session, from its launch messages and the tools it called."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as X
from . import workflow as W

CONFIDENT, MARGIN, LEAST = 7, 3, 3


def _first(pairs) -> Column:
    """The role of the first pattern that matches; null without one."""
    out = F.lit(None).cast("string")
    for role, pattern in reversed(pairs):
        out = F.when(X.matches(F.col("launch"), pattern), role).otherwise(out)
    return out


def _like(pattern: str):
    return lambda name: X.matches(name, pattern)


def launches(turns: DataFrame) -> DataFrame:
    """Messages of a person within the first turns, cut to the length that is looked at, with their anchor role."""
    c = X.trim(F.col("content"))
    t = turns.where((F.col("idx") < R.LAUNCH_TURNS) & (F.col("role") == "user") & (c != "") & ~X.matches(c, R.NO_LAUNCH))
    t = t.select("conv_id", "idx", F.substring("content", 1, R.LAUNCH_CHARACTERS).alias("launch"))
    return t.withColumn("anchor", _first(R.ROLE_ANCHORS))


def inferred(turns: DataFrame) -> DataFrame:
    """conv_id, role, confidence, score, margin, evidence_idx and call counts of every conversation.

    The earliest anchor ends the reading of launch messages and gives its role 30 points; those
    before it add points of their own patterns; shapes of tool use add a few."""
    add = lambda role: reduce(lambda a, b: a + b, (F.when(X.matches(F.col("launch"), p), n).otherwise(0) for r, n, p in R.ROLE_POINTS if r == role))
    t = launches(turns).withColumns({f"p_{r}": add(r) for r in R.ROLES})
    by = t.groupBy("conv_id").agg(
        F.min("idx").alias("start"), F.min(F.when(F.col("anchor").isNotNull(), F.col("idx"))).alias("anchor_idx"), F.min_by("anchor", F.when(F.col("anchor").isNotNull(), F.col("idx"))).alias("anchor"),
        F.collect_list(F.struct("idx", *(f"p_{r}" for r in R.ROLES))).alias("said"),
    )  # at most LAUNCH_TURNS of them
    before = F.filter("said", lambda s: F.col("anchor_idx").isNull() | (s["idx"] < F.col("anchor_idx")))


    def points(role: str) -> Column:
        return F.aggregate(before, F.lit(0), lambda x, s: x + s[f"p_{role}"]) + F.when(F.col("anchor") == role, R.ANCHOR_POINTS).otherwise(0)

    def first(role: str) -> Column:
        said = F.filter(before, lambda s: s[f"p_{role}"] > 0)
        return F.least(F.array_min(F.transform(said, lambda s: s["idx"])), F.when(F.col("anchor") == role, F.col("anchor_idx")))

    by = by.select("conv_id", "start", *(points(r).alias(f"s_{r}") for r in R.ROLES), *(first(r).alias(f"e_{r}") for r in R.ROLES))

    used = F.col("tools") if "tools" in turns.columns else F.array_compact(F.array("tool"))
    calls = {f"c_{r}": F.sum(F.size(F.filter(F.coalesce(used, F.array().cast("array<string>")), _like(p)))) for r, p, _, _ in R.ROLE_TOOLS}
    shape = turns.groupBy("conv_id", "harness").agg(*(c.cast("bigint").alias(n) for n, c in calls.items()))
    all_ = shape.join(by, "conv_id", "left")
    bonus = {r: F.when((F.col(f"c_{r}") >= least) & ((F.col("c_worker") == 0) if r == "advisor" else F.lit(True)), n).otherwise(0) for r, _, least, n in R.ROLE_TOOLS}
    zero = F.lit(0)
    ranked = F.array(*(
        F.struct((F.coalesce(f"s_{r}", zero) + bonus.get(r, zero)).alias("score"), F.lit(-i).alias("rank"), F.lit(r).alias("role"), F.coalesce(f"e_{r}", F.when(bonus.get(r, zero) > 0, F.coalesce("start", F.lit(0))), "start").cast("bigint").alias("evidence"))
        for i, r in enumerate(R.ROLES)
    ))
    all_ = all_.withColumn("ranked", F.sort_array(ranked, asc=False))
    best, margin = F.col("ranked")[0], F.col("ranked")[0]["score"] - F.col("ranked")[1]["score"]
    known = best["score"] >= LEAST
    return all_.select(
        "conv_id", "harness", F.when(known, best["role"]).otherwise("unclassified").alias("role"),
        F.when(~known, "low").when((best["score"] >= CONFIDENT) & (margin >= MARGIN), "high").otherwise("medium").alias("confidence"),
        best["score"].cast("bigint").alias("score"), margin.cast("bigint").alias("margin"), F.when(known, best["evidence"]).alias("evidence_idx"),
        F.col("c_manager").alias("delegations"), F.col("c_worker").alias("mutations"), F.col("c_advisor").alias("lookups"),
    )


def counts(turns: DataFrame) -> DataFrame:
    """Conversations of each role, with zeros."""
    names = turns.sparkSession.createDataFrame([(r,) for r in [*R.ROLES, "unclassified"]], "role string")
    g = inferred(turns).groupBy("role").agg(F.count("*").alias("n"))
    return names.join(g, "role", "left").select("role", F.coalesce("n", F.lit(0)).alias("conversations"))


def profiles(turns: DataFrame) -> DataFrame:
    """Per role: sessions inferred with high confidence, their choices, how many grant autonomy, and the interval of that share."""
    sure = inferred(turns).where("confidence = 'high' AND role != 'unclassified'").select("conv_id", F.col("role").alias("agent"))
    s = sure.groupBy("agent").agg(F.count("*").alias("sessions"))
    said = W.operator_turns(turns).withColumn("pole", W.pole(X.signals(F.col("content")))).where("pole IS NOT NULL").select("conv_id", "pole")
    g = said.join(sure, "conv_id").groupBy("agent").agg(F.count("*").alias("choices"), F.count_if(F.col("pole") == "autonomy-grant").alias("autonomy"))
    p = s.join(g, "agent", "left").na.fill(0, ["choices", "autonomy"])
    low, high = X.wilson(F.col("autonomy"), F.col("choices"))
    bounded = lambda x: F.round(F.when(F.col("choices") > 0, F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))).otherwise(0.0), 6)
    return p.select(F.col("agent").alias("role"), "sessions", "choices", "autonomy", bounded(low).alias("low"), bounded(high).alias("high"))


def distinguishable(profiles: DataFrame, least: int = 15, apart: float = 0.1) -> DataFrame:
    """Pairs of roles whose shares of autonomy differ clearly; at most one row per role comes in."""
    p = profiles.where(F.col("choices") >= least).withColumn("rate", F.col("autonomy") / F.col("choices"))
    order = F.create_map(*(F.lit(x) for i, r in enumerate(R.ROLES) for x in (r, i)))
    a, b = (p.select(F.lit(1).alias("one"), order[F.col("role")].alias(f"{n}_at"), *(F.col(c).alias(f"{n}_{c}") for c in ("role", "rate", "low", "high"))) for n in ("a", "b"))
    pair = a.join(b, "one").where("a_at < b_at")
    return pair.where((F.abs(F.col("a_rate") - F.col("b_rate")) >= apart) & ((F.col("a_high") < F.col("b_low")) | (F.col("b_high") < F.col("a_low")))).select("a_role", "b_role", "a_rate", "b_rate")


def validated(inferred: DataFrame, labels: DataFrame) -> DataFrame:
    """Accuracy per expected role of labels (conv_id, expected); an unmatched label counts as wrong."""
    j = labels.join(inferred.select("conv_id", "role"), "conv_id", "left").withColumn("right", F.coalesce(F.col("role") == F.col("expected"), F.lit(False)))
    return j.groupBy("expected").agg(F.count("*").alias("labels"), F.avg(F.col("right").cast("double")).alias("accuracy"))
