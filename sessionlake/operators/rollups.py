"""Token, tool, length, model, project and time rollups over canonical turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R


def uncached(harness: Column, given: Column, out: Column, cached: Column) -> Column:
    """Tokens that were not read from a cache: codex counts cached input inside input, the others beside it."""
    given, out, cached = (F.coalesce(x, F.lit(0)) for x in (given, out, cached))
    return F.when(harness == "codex", F.greatest(given - cached, F.lit(0)) + out).otherwise(given + out)


def sessions(turns: DataFrame) -> DataFrame:
    """One row per conversation: header, turns, token sums."""
    total = lambda c: (F.coalesce(F.sum(c), F.lit(0)) if c in turns.columns else F.lit(0).cast("bigint")).alias(c)
    return turns.groupBy("conv_id", "harness", "provider", "project", "model", "domain").agg(
        F.count("*").alias("turns"), F.min("at_s").alias("started"), F.max("at_s").alias("ended"), *map(total, ("t_in", "t_out", "t_cached", "t_write", "t_total"))
    )


def measures(sessions: DataFrame) -> list[Column]:
    """Sessions, turns and the token measures of a group of sessions."""
    plain = uncached(F.col("harness"), F.col("t_in"), F.col("t_out"), F.col("t_cached"))
    sums = {"turns": F.col("turns"), "input_tokens": F.col("t_in"), "output_tokens": F.col("t_out"), "non_cached_tokens": plain, "cache_read_tokens": F.col("t_cached"), "cache_write_tokens": F.col("t_write"), "cached_tokens": F.col("t_cached") + F.col("t_write"), "reported_total_tokens": F.col("t_total")}
    return [F.count("*").alias("sessions"), *(F.sum(c).alias(n) for n, c in sums.items())]


def usage(turns: DataFrame, *keys: str | Column) -> DataFrame:
    s = sessions(turns)
    return s.groupBy(*keys).agg(*measures(s))


def period(form: str) -> Column:
    return F.date_format(F.timestamp_seconds("started"), form).alias("period")


def tools(turns: DataFrame, *keys: str, assistant_only: bool = True) -> DataFrame:
    t = turns.where("tool is not null")
    t = t.where("role = 'assistant'") if assistant_only else t
    return t.groupBy(*keys, "tool").agg(F.count("*").alias("calls"), F.countDistinct("conv_id").alias("sessions"))


def lengths(sessions: DataFrame) -> DataFrame:
    """Sessions by their number of turns."""
    n, name = F.col("turns"), F.lit(R.LENGTH_BUCKETS[-1][1])
    for top, label in reversed(R.LENGTH_BUCKETS[:-1]):
        name = F.when(n <= top, label).otherwise(name)
    return sessions.groupBy(name.alias("bucket")).agg(F.count("*").alias("sessions"), (F.floor(F.avg("turns") * 10 + 0.5) / 10).alias("average"), F.min("turns").alias("least"), F.max("turns").alias("most"))


def overview(turns: DataFrame) -> DataFrame:
    return sessions(turns).agg(F.count("*").alias("sessions"), F.countDistinct("project").alias("projects"), F.sum("turns").alias("turns"), F.min("started").alias("first"), F.max("ended").alias("last"), F.sum("t_in").alias("input_tokens"))


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """First n rows in a total order."""
    return df.orderBy(*order).limit(n)
