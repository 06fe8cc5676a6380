"""Paired trials of a promotion candidate: validation, medians by arm, and which arm wins on what."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RUNS = "pair string, arm string, gate_passed boolean, tokens bigint, wall_ms bigint, interventions bigint, rederivations bigint"


def validated(runs: DataFrame, least: int = 3) -> DataFrame:
    """The runs; an error unless at least `least` pairs hold exactly one run of each arm."""
    g = runs.groupBy("pair").agg(F.count("*").alias("n"), F.countDistinct("arm").alias("arms"), F.count_if(~F.col("arm").isin("control", "treatment") | F.col("arm").isNull()).alias("odd"))
    r = g.agg(F.count("*").alias("pairs"), F.count_if((F.col("n") != 2) | (F.col("arms") != 2) | (F.col("odd") > 0)).alias("bad")).first()
    if r.bad:
        raise ValueError(f"{r.bad} pairs are incomplete or hold an arm twice")
    if r.pairs < max(3, least):
        raise ValueError(f"{r.pairs} pairs are fewer than {max(3, least)}")
    return runs


def by_arm(runs: DataFrame) -> DataFrame:
    return runs.groupBy("arm").agg(
        F.count("*").alias("runs"), F.avg(F.col("gate_passed").cast("double")).alias("pass_rate"), F.median("tokens").alias("tokens"), F.median("wall_ms").alias("wall_ms"),
        F.median("interventions").alias("interventions"), F.median("rederivations").alias("rederivations"), F.sum("tokens").alias("all_tokens"), F.sum("wall_ms").alias("all_wall_ms"),
    )


def verdict(runs: DataFrame, least: int = 3) -> dict:
    """recommendation, winner and the first measure in which it is better; an error where none is."""
    arms = {r.arm: r for r in by_arm(validated(runs, least)).collect()}
    c, t = arms["control"], arms["treatment"]
    less = lambda a, b: a is not None and b is not None and a < b
    helps = less(t.tokens, c.tokens) or less(t.rederivations, c.rederivations)
    keep = t.pass_rate >= c.pass_rate and helps
    w, o = (t, c) if keep else (c, t)
    if keep:
        why = "tokens" if less(t.tokens, c.tokens) else "rederivations"
    else:
        why = next((n for n, ok in (("pass_rate", w.pass_rate > o.pass_rate), ("interventions", less(w.interventions, o.interventions)), ("tokens", less(w.tokens, o.tokens)), ("rederivations", less(w.rederivations, o.rederivations))) if ok), None)
    if why is None:
        raise ValueError("no arm is better in any measure")
    return {"recommendation": "keep" if keep else "revise-or-cut", "winner": w.arm, "better_in": why}


def scale_up(runs: DataFrame, candidates: int, pairs: int = 3) -> dict:
    """Linear estimates for a number of candidates, from the mean run."""
    r = runs.agg(F.avg("tokens").alias("t"), F.avg("wall_ms").alias("w")).first()
    n = candidates * pairs * 2
    return {"runs": n, "tokens": round((r.t or 0) * n), "wall_ms": round((r.w or 0) * n)}
