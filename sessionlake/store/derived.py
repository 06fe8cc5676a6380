"""Derived structure of conversations, kept beside the corpus.

Each conversation's structure is written once per recipe, under its content hash: a later run reads
only conversations without one (an anti-join), so a changed corpus costs its changes.  A projection
names the current hashes; what it holds is checked against the corpus before it is read.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import derive as D
from . import corpus as C
from . import files

#: Changes whenever the rules that derive structure change; old rows are left alone.
RECIPE = "structure-2"
TABLES = {"problems": D.problems, "decisions": D.decisions, "attempts": D.attempts, "outcomes": D.observed, "metrics": D.metrics, "topics": D.topics}


def _folder(root) -> Path:
    return Path(root) / "derived" / RECIPE


def _pointer(root) -> Path:
    return _folder(root) / "current.json"


def held(spark: SparkSession, root) -> DataFrame:
    """conv_id of conversations whose structure is written."""
    path = _folder(root) / "metrics"
    return spark.read.parquet(str(path)).select("conv_id").distinct() if path.exists() else spark.createDataFrame([], "conv_id string")


def derive(spark: SparkSession, root) -> dict:
    """Write the structure of new conversations and the projection of the current ones; metrics come last and mark the others as whole."""
    with files.lock(_folder(root).parent / "lock"):
        snap = C.snapshot(root)
        conversations, turns = C.current(spark, root, snap)
        now = conversations.select(F.col("content_hash").alias("conv_id")).distinct()
        new = now.join(held(spark, root), "conv_id", "left_anti")
        n = new.count()
        if n:
            t = C.turns_view(conversations, turns).join(new, "conv_id", "left_semi")
            for name in sorted(TABLES, key=lambda k: k == "metrics"):
                TABLES[name](t).write.mode("append").parquet(str(_folder(root) / name))
        C.assert_unchanged(root, snap)
        files.write(_pointer(root), files.seal({"recipe": RECIPE, "snapshot": snap["hash"], "conversations": now.count()}))
        return {"derived": n, "current": now.count(), "recipe": RECIPE}


def load(spark: SparkSession, root, table: str) -> DataFrame:
    """A derived table of the current conversations; refused where the corpus has moved on."""
    snap = C.snapshot(root)
    if not _pointer(root).exists() or files.unseal(_pointer(root))["snapshot"] != snap["hash"]:
        raise LookupError("derived structure is behind the corpus: derive first")
    now = C.current(spark, root, snap)[0].select(F.col("content_hash").alias("conv_id")).distinct()
    # a run that was cut short before its metrics is written again, so rows may repeat
    return spark.read.parquet(str(_folder(root) / table)).join(now, "conv_id", "left_semi").distinct()
