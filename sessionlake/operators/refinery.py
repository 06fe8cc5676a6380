"""Promotion candidates: what recurs in problems, attempts and decisions of many sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import rules as R
from ..functions import text as X
from . import derive as D


def themes(text: Column) -> Column:
    return X.named(text, R.THEMES)


def references(text: Column) -> Column:
    """host/first segment of each URL in a text, once each."""
    urls = F.regexp_extract_all(text, F.lit(R.java(R.URL)), F.lit(0))
    host = lambda u: F.lower(F.regexp_replace(F.regexp_extract(u, r"^https?://(?:[^/?#]*@)?([^/?#]*)", 1), r":\d+$", ""))
    first = lambda u: F.regexp_extract(u, r"^https?://[^/?#]*/+([^/?#]+)", 1)
    name = lambda u: F.when(first(u) != "", F.concat(host(u), F.lit("/"), first(u))).otherwise(host(u))
    return F.array_distinct(F.filter(F.transform(urls, name), lambda x: x != ""))


def project(name: Column) -> Column:
    """The project without a worktree's suffix."""
    return F.regexp_replace(name, R.WORKTREE, "")


def observations(turns: DataFrame) -> DataFrame:
    """type, signature, conv_id, idx, project, harness, snippet: five streams of evidence."""
    head = turns.select("conv_id", project(F.col("project")).alias("project"), "harness").dropDuplicates(["conv_id"])
    p, a, d = (x.join(head, "conv_id") for x in (D.problems(turns), D.attempts(turns), D.decisions(turns)))
    mine = lambda names: F.transform(names, lambda n: F.concat("project", F.lit(":"), n))
    used = lambda pattern: F.exists("tools", lambda t: X.matches(t, pattern))

    def stream(rows: DataFrame, kind: str, names: Column) -> DataFrame:
        return rows.select(F.lit(kind).alias("type"), F.explode(names).alias("signature"), "conv_id", "idx", "project", "harness", "snippet")

    seen = F.col("snippet")
    out = stream(p, "gotcha-skill", F.filter(F.split("categories", "\\|"), lambda c: c != ""))
    out = out.unionByName(stream(a.where(F.col("outcome") == "success").where(used(R.ACTION_TOOL)), "skill", themes(seen)))
    out = out.unionByName(stream(d, "memory-or-adr", mine(themes(seen))))
    out = out.unionByName(stream(p, "claude-md", mine(themes(seen))))
    return out.unionByName(stream(a.where(used(R.LOOKUP_TOOL)), "wiki-page-later", references(seen)))


def candidates(turns: DataFrame, threshold: int = 3) -> DataFrame:
    """Signatures seen in at least `threshold` sessions, with how often and where."""
    if threshold < 3:
        raise ValueError("the threshold is at least 3")
    g = observations(turns).groupBy("type", "signature").agg(
        F.count("*").alias("occurrences"), F.countDistinct("conv_id").alias("sessions"), F.countDistinct("project").alias("projects"), F.countDistinct("harness").alias("harnesses")
    )
    status = F.when(F.col("type") == "wiki-page-later", "deferred-follow-up").otherwise("curation-required")
    return g.where(F.col("sessions") >= threshold).withColumn("id", F.substring(F.sha2(F.concat("type", F.lit(":"), "signature"), 256), 1, 20)).withColumn("status", status)


def evidence(turns: DataFrame, n: int = 6) -> DataFrame:
    """Up to n pieces of evidence of a signature, the first of each session."""
    one = Window.partitionBy("type", "signature", "conv_id").orderBy("idx", "snippet")
    few = Window.partitionBy("type", "signature").orderBy("conv_id")
    o = observations(turns).withColumn("k", F.row_number().over(one)).where("k = 1")
    return o.withColumn("rank", F.row_number().over(few)).where(F.col("rank") <= n).drop("k")
