"""The active projection: which snapshots reads may see, and differences of manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def current(rows: DataFrame, active: DataFrame, *keys: str) -> DataFrame:
    """Rows whose (source, hash) is active."""
    return rows.join(active.select(*keys), list(keys), "left_semi")


def missing(active: DataFrame, rows: DataFrame, *keys: str) -> DataFrame:
    """Active mappings without an indexed row."""
    return active.join(rows.select(*keys), list(keys), "left_anti")


def guarded(rows: DataFrame, key: str, expected: int) -> DataFrame:
    """The rows, or an error in the query if they do not hold exactly `expected` distinct keys."""
    n = rows.agg(F.countDistinct(key).alias("__n"))
    ok = n.select(F.when(F.col("__n") == expected, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("coverage mismatch: "), F.col("__n").cast("string")))).alias("__ok"))
    return rows.join(F.broadcast(ok), F.col("__ok")).drop("__ok")  # one row


def difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """source, before, after, change of entries that differ between two manifests (source, hash)."""
    b = before.select("source", F.col("hash").alias("before"))
    a = after.select("source", F.col("hash").alias("after"))
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").otherwise("changed")
    return b.join(a, "source", "full").where(~F.col("before").eqNullSafe(F.col("after"))).withColumn("change", change)


def classified(proposed: DataFrame, manifest: DataFrame) -> DataFrame:
    """Proposed imports (source, hash, domain) as new, unchanged, reclassified or changed against the manifest."""
    m = manifest.select("source", F.col("hash").alias("old"), F.col("domain").alias("old_domain"))
    kind = F.when(F.col("old").isNull(), "new").when(F.col("old") == F.col("hash"), F.when(F.col("domain") == F.col("old_domain"), "unchanged").otherwise("reclassified")).otherwise("changed")
    return proposed.join(m, "source", "left").withColumn("class", kind)
