"""The corpus: immutable Parquet snapshots of conversations and turns behind one pointer file.

An ingest lists files, skips those whose path, size and time are known, adapts the others in one
plan, appends them in a folder of their own, writes the next manifest, and replaces the pointer: the
only step that makes them current.  Readers resolve the pointer once and check it again at the end.
"""

from __future__ import annotations

import json
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as X
from ..operators import active as A
from ..sources import adapters as D
from ..sources import chat_export as E
from ..sources import jsonl as J
from . import files as S
from . import journal as L

MANIFEST = "source_path string, content_hash string, size bigint, mtime_ms bigint, harness string, domain string"
_HEAD = ["source_path", "content_hash", "id", "resume_id", "title", "harness", "provider", "domain", "source_kind", "project", "cwd", "model", "started_at", "ended_at", "n_turns", "partial_tail"]
_TURN = ["source_path", "content_hash", "idx", "role", "content", "at", "tool_calls", "tokens"]


def _pointer(root) -> Path:
    return Path(root) / "corpus" / "_snapshot.json"


def snapshot(root) -> dict:
    """The current snapshot; an empty one before the first ingest."""
    path = _pointer(root)
    return S.unseal(path) if path.exists() else {"hash": "empty", "manifest": None, "recipe": R.REDACTION_RECIPE, "sources": 0}


def assert_unchanged(root, before: dict) -> None:
    if snapshot(root)["hash"] != before["hash"]:
        raise S.IntegrityError("the corpus changed while it was read; run the query again")


def manifest(spark: SparkSession, root, snap: dict | None = None) -> DataFrame:
    snap = snap or snapshot(root)
    if snap["manifest"] is None:
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).parquet(f"{root}/corpus/{snap['manifest']}")


def manifest_hash(rows: DataFrame) -> tuple[str, int]:
    """(hash, rows) of a manifest whatever its order, folded by the executors."""
    one = F.xxhash64(F.to_json(F.struct(*sorted(rows.columns))))
    two = F.conv(F.substring(F.sha2(F.to_json(F.struct(*sorted(rows.columns))), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    r = rows.agg(F.count("*").alias("n"), F.bit_xor(one).alias("x"), F.sum(two).alias("s")).first()
    return S.sha256(f"{r.n}:{r.x}:{r.s}"), r.n


def _add(c: DataFrame, t: DataFrame) -> tuple[DataFrame, DataFrame]:
    have = c.columns
    for name in ("title", "domain", "source_kind"):
        if name not in have:
            c = c.withColumn(name, F.lit(None).cast("string"))
    return c.select(*_HEAD, "size", "mtime_ms"), t.select(*_TURN)


def _commit(spark: SparkSession, root, kind: str, c: DataFrame, t: DataFrame, detail: dict) -> dict:
    """Append objects, write the next manifest, and make it current under an intent."""
    op, snap = uuid.uuid4().hex, snapshot(root)
    where = f"{root}/corpus"
    c.write.parquet(f"{where}/conversations/op={op}")
    t.write.parquet(f"{where}/turns/op={op}")
    c = spark.read.schema(c.schema).parquet(f"{where}/conversations/op={op}")
    new = c.select("source_path", "content_hash", "size", "mtime_ms", "harness", "domain")
    A.missing(manifest(spark, root, snap), new, "source_path").unionByName(new).write.parquet(f"{where}/manifests/{op}")
    digest, n = manifest_hash(spark.read.schema(MANIFEST).parquet(f"{where}/manifests/{op}"))
    after = {"hash": digest, "manifest": f"manifests/{op}", "recipe": R.REDACTION_RECIPE, "sources": n}
    intent = L.create(root, kind, snap["hash"], digest, detail, op)
    try:
        S.write(_pointer(root), S.seal(after))
    except OSError:
        if L.settle(root, intent, snapshot(root)["hash"]) == "aborted":
            L.finish(root, intent, "aborted")
            raise
    intent = L.advance(root, intent, "committed")
    _resume(root, intent)
    L.finish(root, intent)
    return after | {"operation": op}


def _resume(root, intent: dict) -> None:
    """What follows a commit; each step may be repeated."""
    if intent["before"] != intent["after"]:
        L.invalidate(root, intent["after"], "the corpus has a newer snapshot")
    if intent["kind"] == "import":
        L.receipt(root, {"operation": intent["operation"], "completed": intent["created"], "snapshot": intent["after"]} | intent["detail"])


def recover(root) -> dict:
    return L.recover(root, lambda: snapshot(root)["hash"], lambda intent: _resume(root, intent))


def _lock(root):
    return S.lock(Path(root) / "corpus" / "ingest.lock")


def ingest(spark: SparkSession, root, sources: dict[str, str]) -> dict:
    """Ingest {harness: folder}; counts per harness, unfinished tails and files that changed meanwhile."""
    with _lock(root):
        recover(root)
        snap = snapshot(root)
        known = manifest(spark, root, snap).select(F.col("source_path").alias("path"), "size", "mtime_ms")
        if snap["recipe"] != R.REDACTION_RECIPE:
            known = known.limit(0)
        out: dict = {"harnesses": {}, "partial_tails": 0, "changed_during_read": 0, "snapshot": snap["hash"]}
        parts, seen = [], []
        for harness, folder in sorted(sources.items()):
            files = J.listing(spark, folder, D.ADAPTERS[harness].pattern)
            # the file listing is on the driver in any case: Spark plans a scan from it
            todo = [r.path for r in files.join(known, ["path", "size", "mtime_ms"], "left_anti").select("path").collect()]
            out["harnesses"][harness] = {"discovered": files.count(), "ingested": len(todo)}
            if todo:
                parts.append(_add(*D.adapt(J.lines(spark, todo, D.ADAPTERS[harness].pattern), harness, folder)))
                seen.append((files, folder, harness))
        for harness in out["harnesses"].values():
            harness["skipped"] = harness["discovered"] - harness["ingested"]
        if not parts:
            return out
        c, t = parts[0]
        for a, b in parts[1:]:
            c, t = c.unionByName(a), t.unionByName(b)
        done = _commit(spark, root, "ingest", c, t, {})
        new = spark.read.parquet(f"{root}/corpus/conversations/op={done['operation']}")
        out |= {"snapshot": done["hash"], "partial_tails": new.where("partial_tail").count()}
        later = None
        for _, folder, harness in seen:
            f = J.listing(spark, folder, D.ADAPTERS[harness].pattern)
            later = f if later is None else later.unionByName(f)
        was = new.select(F.col("source_path").alias("path"), "size", "mtime_ms")
        out["changed_during_read"] = was.join(later, ["path", "size", "mtime_ms"], "left_anti").count()
        return out


def preview_export(spark: SparkSession, root, path: str, domain: str = "general") -> dict:
    """What an import would do; nothing is written."""
    c, t = E.adapt(E.items(spark, path), path, domain)
    m = manifest(spark, root).select(F.col("source_path").alias("source"), F.col("content_hash").alias("hash"), "domain")
    return E.preview(c, t, m).first().asDict()


def import_export(spark: SparkSession, root, path: str, domain: str = "general") -> dict:
    """Import a chat export; unchanged conversations are skipped, and a receipt is written."""
    with _lock(root):
        recover(root)
        c, t = E.adapt(E.items(spark, path), path, domain)
        known = manifest(spark, root).select("source_path", "content_hash", "domain")
        counts = E.preview(c, t, known.select(F.col("source_path").alias("source"), F.col("content_hash").alias("hash"), "domain")).first().asDict()
        if counts["unchanged"] == counts["conversations"]:
            return counts | {"snapshot": snapshot(root)["hash"]}
        c = c.join(known, ["source_path", "content_hash", "domain"], "left_anti")
        t = t.join(c.select("content_hash"), "content_hash", "left_semi")
        done = _commit(spark, root, "import", *_add(c, t), {"counts": counts, "source": path, "domain": domain})
        return counts | {"snapshot": done["hash"]}


def current(spark: SparkSession, root, snap: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """(conversations, turns) of the current snapshot: superseded ones are not among them."""
    snap = snap or snapshot(root)
    if snap["manifest"] is None:
        raise S.IntegrityError("nothing has been ingested")
    m = manifest(spark, root, snap)
    c = spark.read.parquet(f"{root}/corpus/conversations").drop("op")
    t = spark.read.parquet(f"{root}/corpus/turns").drop("op")
    keys = ["source_path", "content_hash"]
    # the same snapshot may have been appended twice (a log that went back to an earlier state)
    return A.current(c, m, *keys).dropDuplicates(keys), A.current(t, m, *keys).dropDuplicates([*keys, "idx"])


def check(spark: SparkSession, root) -> dict:
    """Fail unless pointer, manifest and objects agree."""
    snap = snapshot(root)
    m = manifest(spark, root, snap)
    if snap["manifest"] is not None:
        digest, n = manifest_hash(m)
        if (digest, n) != (snap["hash"], snap["sources"]):
            raise S.IntegrityError("the manifest differs from the snapshot pointer")
        gone = A.missing(m, spark.read.parquet(f"{root}/corpus/conversations"), "source_path", "content_hash").count()
        if gone:
            raise S.IntegrityError(f"{gone} current conversations have no object")
    return snap


def turns_view(conversations: DataFrame, turns: DataFrame) -> DataFrame:
    """The columns that the operators read: one row per turn with its conversation's header."""
    head = conversations.select(F.col("content_hash"), "id", "resume_id", "title", "harness", "provider", "project", "model", "domain", "started_at", "ended_at")
    stamp = lambda c: F.unix_seconds(F.try_to_timestamp(c))
    return turns.join(head, "content_hash").select(
        F.col("content_hash").alias("conv_id"), "id", "resume_id", "title", F.col("idx"), "role", F.coalesce("content", F.lit("")).alias("content"), "harness", "provider", "project", "model", X.domain(F.col("domain")).alias("domain"),
        F.coalesce(stamp(F.col("at")), stamp(F.col("started_at"))).alias("at_s"), "started_at", "ended_at",
        F.col("tokens.input").alias("t_in"), F.col("tokens.output").alias("t_out"), F.col("tokens.cached_input").alias("t_cached"), F.col("tokens.cache_write").alias("t_write"), F.col("tokens.total").alias("t_total"),
        F.get(F.col("tool_calls.name"), F.lit(0)).alias("tool"), F.col("tool_calls.name").alias("tools"), "tool_calls",
    )


def catalog(root, configured: dict[str, str] | None = None) -> list[dict]:
    """Known sources: configured folders, and data archives beside the corpus; whether they can be read."""
    rows = [{"name": k, "kind": "session-log" if k in D.ADAPTERS else "unknown", "path": v, "available": Path(v).is_dir()} for k, v in sorted((configured or {}).items())]
    base = Path(root)
    rows += [{"name": p.stem, "kind": "chat-export", "path": str(p), "available": True} for p in sorted(base.glob("data-*.zip"))]
    return rows


def describe(root) -> str:
    return json.dumps(snapshot(root) | {"pending": len(L.pending(root))})
