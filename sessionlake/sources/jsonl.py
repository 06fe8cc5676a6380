"""JSON-lines session logs as rows of lines, and the rule for their last line.

Lines carry an order key (start of the file split, position in the partition) instead of a line
number, so no file has to be read by one task.  A line that is no JSON is an error, unless it is the
last of its file and has no line end: a log that is being appended to.  Whether the last line ends
is seen from sizes: lengths of all lines plus one byte each exceed the file's size by one if not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def plain_path(uri: Column) -> Column:
    """A local path from a file URI; other URIs stay."""
    local = F.regexp_replace(uri, "^file:(//)?", "")
    return F.when(uri.startswith("file:"), F.url_decode(F.replace(local, F.lit("+"), F.lit("%2B")))).otherwise(uri)


def listing(spark: SparkSession, root: str, pattern: str = "*.jsonl") -> DataFrame:
    """path, size, mtime_ms of the log files below a folder; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return files.select(plain_path(F.col("path")).alias("path"), F.col("length").alias("size"), F.unix_millis("modificationTime").alias("mtime_ms"))


def lines(spark: SparkSession, paths: str | list[str], pattern: str = "*.jsonl") -> DataFrame:
    """path, size, mtime_ms, key (order within the file), value: one row per line, empty ones too."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).option("lineSep", "\n").text(paths)
    m = F.col("_metadata")
    key = F.struct(m["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("seq"))
    return raw.select(plain_path(m["file_path"]).alias("path"), m["file_size"].alias("size"), F.unix_millis(m["file_modification_time"]).alias("mtime_ms"), key.alias("key"), "value")


def unended(size: Column, octets: Column) -> Column:
    """Whether a file's last line has no line end, from the summed lengths with one byte a line."""
    return octets > size
