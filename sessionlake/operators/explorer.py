"""Views over workflow reports for people: filters, bounded projections without ids and paths, and total orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from . import patterns as P

TIMELINE = 12


def ordinal(column: str, values: list[str]) -> Column:
    return F.coalesce(F.array_position(F.array(*map(F.lit, values)), F.col(column)), F.lit(0))


def event_order() -> list[Column]:
    return [F.col("at_s"), ordinal("kind", R.KINDS), F.col("id")]


def pattern_order() -> list[Column]:
    return [F.desc("episodes"), ordinal("kind", R.KINDS), F.col("signal"), ordinal("role", R.AGENT_ROLES), F.col("id")]


def filtered(patterns: DataFrame, occurrences: DataFrame, query: str = "", since: str = "", until: str = "", reviews: DataFrame | None = None, review: str = "", harness: str = "", **equal: str) -> DataFrame:
    """Patterns whose text holds the query, whose columns (kind, signal, role, outcome) are equal, that saw the harness, have the
    review and any occurrence in the days since..until; empty filters do not filter.

    occurrences: all of them, as of `patterns.occurrences`; reviews: id, disposition, label, note; patterns without one are unreviewed."""
    none = F.lit(None).cast("string")
    p = patterns.join(reviews.select("id", "disposition", "label", "note"), "id", "left") if reviews is not None else patterns.withColumns({c: none for c in ("disposition", "label", "note")})
    p = p.withColumn("disposition", F.coalesce("disposition", F.lit("unreviewed")))
    if query:
        text = F.concat_ws(" ", "label", "note", "title", "kind", "signal", "role", F.replace(F.col("harnesses"), F.lit("|"), F.lit(" ")))
        p = p.where(F.contains(F.lower(text), F.lit(query.lower())))
    for column, value in equal.items():
        if value:
            p = p.where(F.col(column) == value)
    if review:
        p = p.where(F.col("disposition") == review)
    if harness:
        p = p.where(F.array_contains(F.split("harnesses", r"\|"), harness))
    if since or until:
        day = F.date_format(F.timestamp_seconds("at_s"), "yyyy-MM-dd")
        seen = occurrences.where(day.between(since or "0000-01-01", until or "9999-12-31")).select(*P.KEY).distinct()
        p = p.join(seen, P.KEY, "left_semi")
    return p


def bounded_patterns(patterns: DataFrame) -> DataFrame:
    """Patterns as they may be shown: an opaque handle for the id, a count for the projects."""
    keep = [c for c in patterns.columns if c not in ("id", "projects")]
    return patterns.select(F.sha2(F.concat_ws("|", F.lit("handle"), *P.KEY), 256).alias("handle"), *keep, F.when(F.col("projects") == "", 0).otherwise(F.size(F.split("projects", r"\|"))).alias("project_count"))


def bounded_timeline(timeline: DataFrame) -> DataFrame:
    """The newest occurrences of each pattern, without event and episode."""
    return timeline.where(F.col("n") <= TIMELINE).select(*P.KEY, "n", "at_s", "relation")


def bounded_comparisons(comparisons: DataFrame, groups: DataFrame) -> DataFrame:
    """Comparisons without ids, with the number of projects in scope."""
    return comparisons.join(groups.select("id", F.size("projects").alias("project_count")), "id").drop("id")


def projects(df: DataFrame, text: str, most: int = 40) -> DataFrame:
    """Projects whose path holds a text, whatever its case."""
    return df.where(F.contains(F.lower("project"), F.lit(text.lower()))).orderBy(F.desc("last"), "project").limit(most)
