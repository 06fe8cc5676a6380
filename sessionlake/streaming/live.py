"""Session logs as streams: new files into the corpus, and counters over trailing time.

The reference surface has no streaming; apart from incremental ingest these are extensions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import adapters as D
from ..store import corpus as C

EVENTS = "event_id bigint, user_id bigint, event_type string, ts timestamp, value double"


def ingest_new_files(spark: SparkSession, root: str, harness: str, folder: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Ingest whenever files arrive; by default all that are there, once.

    A batch only tells that something arrived: the ingest itself compares paths, sizes and times
    with the manifest, so a batch that is repeated after a failure changes nothing.  Files that grow
    in place are seen by the next batch's ingest."""
    files = spark.readStream.format("text").option("recursiveFileLookup", "true").option("pathGlobFilter", D.ADAPTERS[harness].pattern).load(folder)

    def run(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            C.ingest(batch.sparkSession, root, {harness: folder})

    return files.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def session_days(turns: DataFrame, late: str = "1 day") -> DataFrame:
    """The first turn of each conversation and UTC day; state is dropped behind the watermark.

    turns: conv_id, at (timestamp)."""
    t = turns.withWatermark("at", late).withColumn("day", F.date_format("at", "yyyy-MM-dd"))
    return t.dropDuplicatesWithinWatermark(["conv_id", "day"])


def events(spark: SparkSession, folder: str, schema: str = EVENTS) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def windowed(events: DataFrame, size: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Events by type and window, emitted once the watermark has passed."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    g = events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "event_type", "n", "total")
