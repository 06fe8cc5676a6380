"""What was observed around workflow events: symmetric windows of whole sessions in an event's projects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as X
from . import derive as D
from . import workflow as W

HOUR = 3600
WIDTH = R.WINDOW_DAYS * 24 * HOUR
STATUSES = ["success", "failure", "mixed", "unknown"]


def observations(turns: DataFrame) -> DataFrame:
    """One row per conversation: episode, project, span, turns, minutes, outcome, problems, attempts, reported tokens (null without any counter)."""
    stamp = lambda c: F.unix_seconds(F.try_to_timestamp(c))
    dated = "started_at" in turns.columns
    t = turns.withColumns({"episode": W.episode(turns), "from": stamp("started_at") if dated else F.col("at_s"), "to": stamp("ended_at") if dated else F.col("at_s")})
    parts = F.when(F.sum("t_in").isNotNull() | F.sum("t_out").isNotNull(), F.coalesce(F.sum("t_in"), F.lit(0)) + F.coalesce(F.sum("t_out"), F.lit(0)))
    head = t.groupBy("conv_id", "episode", "provider", "harness", "project").agg(F.min("from").alias("started"), F.max("to").alias("ended"), F.count("*").alias("turns"), F.coalesce(F.sum("t_total"), parts).alias("tokens"))
    minutes = F.when(F.col("ended") >= F.col("started"), X.half_up((F.col("ended") - F.col("started")) / 60))
    return head.withColumn("minutes", minutes).join(D.observed(turns), "conv_id")


def representatives(observations: DataFrame) -> DataFrame:
    """The latest, longest snapshot of each episode in a project."""
    best = F.max(F.struct("ended", "turns", "conv_id", "started", "provider", "harness", "status", "problems", "known", "failed", "tokens", "minutes")).alias("best")
    return observations.groupBy("episode", "project").agg(best).select("episode", "project", "best.*")


def _rate(hits: Column, n: Column, least: Column | None = None) -> Column:
    return F.when((n if least is None else least) >= R.SAMPLES, X.half_up(hits / n))


def near(groups: DataFrame, observations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row per event and project with its window, event rows beside the sessions of that project before, after and across it).

    Sessions and events meet in bins of the widest window: an event looks into three bins for sessions that start there, and into its own for those that span it."""
    reps = representatives(observations)
    span = observations.agg(F.min("ended").alias("first_end"), F.max("ended").alias("last_end")).withColumn("one", F.lit(1))
    e = groups.select("id", "kind", "at_s", "episode", F.explode_outer("projects").alias("project")).withColumn("one", F.lit(1)).join(F.broadcast(span), "one").drop("one")  # one row
    at = F.col("at_s")
    side = F.least(F.lit(WIDTH), at - F.col("first_end"), F.col("last_end") - at)
    e = e.withColumn("radius", F.greatest(F.lit(0), F.floor(side / HOUR) * HOUR)).drop("first_end", "last_end")
    bin_ = lambda c: F.floor(c / WIDTH)
    looks = e.where("project IS NOT NULL").withColumn("mid", bin_(at)).withColumn("bin", F.explode(F.sequence(F.col("mid") - 1, F.col("mid") + 1)))
    there = reps.withColumnRenamed("episode", "other").withColumn("home", bin_(F.col("started"))).withColumn("bin", F.explode(F.sequence(F.col("home"), F.greatest("home", bin_(F.col("ended"))))))
    met = looks.join(there, ["project", "bin"]).where("other != episode")
    begins, s, t = F.col("bin") == F.col("home"), F.col("started"), F.col("ended")
    met = met.withColumns({
        "pre": begins & (s <= t) & (s >= at - F.col("radius")) & (t < at),
        "post": begins & (s <= t) & (s >= at) & (t > at) & (t <= at + F.col("radius")),
        "across": (F.col("bin") == F.col("mid")) & (s < at) & (t > at),
    }).where("pre OR post OR across")
    return e, met


def comparisons(groups: DataFrame, observations: DataFrame) -> DataFrame:
    """One row per event: status, reasons, window, coverage, both sides' measures and their changes."""
    e, met = near(groups, observations)
    sides = []
    for side in ("pre", "post"):
        own = lambda c, side=side: F.when(F.col(side), F.col(c))
        sides += [F.count_if(side).alias(side), *(F.count_if(F.col(side) & (F.col("status") == k)).alias(f"{side}_{k}") for k in STATUSES)]
        sides += [F.count_if(F.col(side) & (F.col("problems") > 0)).alias(f"{side}_friction_episodes"), F.coalesce(F.sum(own("problems")), F.lit(0)).alias(f"{side}_problems")]
        sides += [F.coalesce(F.sum(own(c)), F.lit(0)).alias(f"{side}_{c}") for c in ("known", "failed")]
        sides += [F.median(own("turns")).alias(f"{side}_turns"), F.median(own("minutes")).alias(f"{side}_minutes"), F.count(own("minutes")).alias(f"{side}_timed")]
    got = met.groupBy("id").agg(F.count_if("across").alias("spanning"), *sides)
    scope = observations.groupBy("project").agg(F.count("*").alias("scoped")).join(representatives(observations).groupBy("project").agg(F.count("*").alias("reps")), "project")
    own = representatives(observations).select("episode", "project", F.lit(1).alias("self"))
    head = e.join(scope, "project", "left").join(own, ["episode", "project"], "left").groupBy("id", "kind", "at_s", "radius").agg(
        F.count("project").alias("in_projects"), F.coalesce(F.sum("scoped"), F.lit(0)).alias("scoped"), F.coalesce(F.sum("reps"), F.lit(0)).alias("reps"), F.coalesce(F.sum("self"), F.lit(0)).alias("event_episodes")
    )
    out = head.join(got, "id", "left")
    counts = [f.name for f in out.schema if f.name not in ("id", "kind") and not f.name.endswith(("_turns", "_minutes"))]
    out = out.na.fill(0, counts)
    for side in ("pre", "post"):
        c = lambda name, side=side: F.col(f"{side}_{name}")
        known = c("success") + c("failure") + c("mixed")
        out = out.withColumns({f"{side}_completion": _rate(c("success"), known), f"{side}_friction": _rate(c("friction_episodes"), F.col(side)), f"{side}_rework": _rate(c("failed"), c("known")), f"{side}_minutes": F.when(c("timed") >= R.SAMPLES, c("minutes"))})
    reasons = F.array_compact(F.array(
        F.when(F.col("in_projects") == 0, "no-project-scope"), F.when(F.col("radius") < 24 * HOUR, "observation-window-under-24h"),
        F.when(F.col("pre") < R.SIDE_EPISODES, f"pre-episodes-below-{R.SIDE_EPISODES}"), F.when(F.col("post") < R.SIDE_EPISODES, f"post-episodes-below-{R.SIDE_EPISODES}"),
    ))
    out = out.withColumn("reasons", F.array_join(reasons, "|")).withColumn("status", F.when(F.col("reasons") == "", "observed").otherwise("insufficient-coverage"))
    change = lambda n: F.when(F.col("status") == "observed", X.half_up(F.col(f"post_{n}") - F.col(f"pre_{n}"))).alias(f"{n}_change")
    measures = ("completion", "friction", "rework", "turns", "minutes")
    return out.select(
        "id", "kind", "at_s", "status", "reasons", (F.col("radius") / HOUR).cast("bigint").alias("window_hours"), "scoped", (F.col("reps") - F.col("event_episodes")).alias("representatives"), "event_episodes", "spanning",
        (F.col("reps") - F.col("event_episodes") - F.col("spanning") - F.col("pre") - F.col("post")).alias("outside"), "pre", "post",
        *(f"{side}_{n}" for side in ("pre", "post") for n in (*STATUSES, "problems", "known", "failed", *measures)), *map(change, measures),
    )


def token_changes(groups: DataFrame, observations: DataFrame) -> DataFrame:
    """Per event, provider and harness: samples and median reported tokens before and after, and the change, where both sides have enough and the event is observed."""
    met = near(groups, observations)[1].where("tokens IS NOT NULL")
    sides = [x for s in ("pre", "post") for x in (F.count_if(s).alias(f"{s}_samples"), F.median(F.when(F.col(s), F.col("tokens"))).alias(f"{s}_tokens"))]
    g = met.groupBy("id", "provider", "harness").agg(*sides).where(f"pre_samples >= {R.SAMPLES} AND post_samples >= {R.SAMPLES}")
    seen = comparisons(groups, observations).where("status = 'observed'").select("id")
    return g.join(seen, "id", "left_semi").withColumn("change", X.half_up(F.col("post_tokens") - F.col("pre_tokens")))
