"""Shared pieces: the shared working folder, Arrow text buffers, byte-level word hashing.

Text is handled as UTF-8 bytes in numpy.  Every separator class used by the operators is
ASCII-only, so cutting the bytes gives the same words as cutting the code points.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy step handles, and one step of a tokenizer; a longer document makes a step of its own.
STEP_BYTES, ENCODE_BYTES = 1 << 18, 2 << 20
#: Bytes of an Arrow batch of texts: with the steps, what a Python worker and the JVM hold at once.
BATCH = 1 << 22


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; where it is unset, a folder of our own, on a local master only."""
    conf = spark.sparkContext.getConf()
    where = conf.get("spark.checkpoint.dir") or getattr(spark, "_llm_dir", None)
    if not where:
        master = conf.get("spark.master") or ""
        if not re.fullmatch(r"local(\[[^]]*\])?", master):
            raise RuntimeError(f"spark.checkpoint.dir has to name a folder that all executors share (master {master!r})")
        made = tempfile.mkdtemp(prefix="llm-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        where = spark._llm_dir = "file://" + made
    return where.rstrip("/")


@contextlib.contextmanager
def tidy(spark: SparkSession, batch: int | None = None):
    """Executions inside delete their shuffle files when they end, as their results are written tables.

    batch: bytes after which Arrow batches to Python end, in place of the session's limit."""
    conf = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
    if batch:
        conf["spark.sql.execution.arrow.maxBytesPerBatch"] = str(batch)
    was = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


def materialize(df: DataFrame, name: str, codec: str = "zstd", batch: int | None = None) -> DataFrame:
    """Cut lineage: write df as Parquet in the shared folder and read it back."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with tidy(df.sparkSession, batch):
        df.write.option("compression", codec).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def remove(*tables: DataFrame | str, spark: SparkSession | None = None) -> None:
    """Delete what `materialize` wrote, or paths, once nothing reads it any more."""
    for x in tables:
        path, session = (x, spark) if isinstance(x, str) else (x._written, x.sparkSession)
        where = session._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(session._jsc.hadoopConfiguration()).delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id, n: int):
    """crc32 of the id as text, mod n; a null id falls in fold 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % n, F.lit(0))


def join_hash(col):
    """Lowercase hex SHA-256 of a string column."""
    return F.sha2(col.cast("string"), 256)


# ---------------------------------------------------------------- Arrow text


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def steps(offsets: np.ndarray, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole documents of at most `limit` bytes each, or one longer document."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def trim() -> None:
    """Give what this process has freed back to the system; a worker keeps it between tasks otherwise.  Nothing happens without glibc."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def int64s(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values with 0 for null, null mask)."""
    column = column.cast(pa.int64())
    null = np.asarray(pc.is_null(column))
    return np.asarray(pc.fill_null(column, 0)), null


def nullable(values: np.ndarray, null: np.ndarray) -> pa.Array:
    return pa.array(values, pa.int64(), mask=null)


# ---------------------------------------------------------------- word hashing

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
#: [^\x20\x09-\x0D]+
GRAPHIC = np.ones(256, bool)
GRAPHIC[[32, 9, 10, 11, 12, 13]] = False
LINE = np.ones(256, bool)
LINE[10] = False

_M = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_powers: dict = {}


def _tables(n: int, seed: int):
    """Per-byte values, and the powers of one odd base and of its inverse modulo 2**64."""
    if _powers.get("size", 0) < n:
        n = max(n, min(STEP_BYTES + 4096, 1 << n.bit_length()))  # short steps make short tables
        base = 0xD6E8FEB86659FD93
        up, down = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        np.multiply.accumulate(up, out=up)
        np.multiply.accumulate(down, out=down)
        _powers.update(size=n, up=up, down=down)
    if seed not in _powers:
        _powers[seed] = mix(np.arange(1, 257, dtype=np.uint64) * _M + np.uint64(seed))
    return _powers[seed], _powers["up"], _powers["down"]


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
    """64-bit hashes of data[start:end] for ascending, non-overlapping spans."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        lo = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, lo + STEP_BYTES, "right")))
        hi = int(ends[j - 1])
        byte, up, down = _tables(hi - lo + 1, seed)
        total = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(byte[data[lo:hi]] * up[: hi - lo], out=total[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = mix((total[e] - total[s]) * down[s] + (ends[i:j] - starts[i:j]).astype(np.uint64))
        i = j
    return out


def spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each document + total) of maximal runs of the class; runs end with their document."""
    mask = np.zeros(len(data) + 2, bool)
    mask[1:-1] = inside[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(mask[1:-1] & (~mask[:-2] | edge[:-1]))
    ends = np.flatnonzero(mask[1:-1] & (~mask[2:] | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, seed: int = 1):
    """(hash of each word, word bounds of each document) of lower-cased text, in steps of whole documents."""
    hashes, bounds, n = [], [np.zeros(1, np.int64)], 0
    for i, j in steps(offsets):
        part = LOWER[data[offsets[i] : offsets[j]]]
        s, e, first = spans(part, offsets[i : j + 1] - offsets[i], inside)
        hashes.append(hash_spans(part, s, e, seed))
        bounds.append(first[1:] + n)
        n += len(s)
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), np.concatenate(bounds)


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, k: int):
    """(hash, document) of every k-word shingle; a shorter, non-empty document gives its whole sequence as one."""
    n, size = len(words), np.diff(bounds)
    h = np.zeros(n, np.uint64)
    doc = np.repeat(np.arange(len(size)), size)
    left = bounds[1:][doc] - np.arange(n)
    for i in range(min(k, n)):
        ok = left > i
        step = np.zeros(n, np.uint64)
        step[: n - i][ok[: n - i]] = words[i:][ok[: n - i]]
        h = np.where(ok, mix(h * _M + step + np.uint64(i + 1)), h)
    first = np.arange(n) == bounds[:-1][doc] if n else np.zeros(0, bool)
    keep = (left >= k) | first
    return h[keep], doc[keep]


def shingle_weights(weight: np.ndarray, bounds: np.ndarray, k: int) -> np.ndarray:
    """Sum of the words' weights in every shingle, in the order of `shingle_hashes`."""
    at = np.arange(len(weight))
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    end = bounds[1:][doc]
    keep = (end - at >= k) | (at == bounds[:-1][doc])
    total = np.append(0, np.cumsum(weight, dtype=np.int64))
    return total[np.minimum(at + k, end)[keep]] - total[at[keep]]


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Concatenated ranges start..start+size."""
    sizes = np.asarray(sizes, np.int64)
    if not len(sizes) or not sizes.sum():
        return np.zeros(0, np.int64)
    at = np.cumsum(sizes) - sizes
    return np.arange(sizes.sum()) - np.repeat(at - starts, sizes)


def blob(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


# ---------------------------------------------------------------- connected components


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge table (a, b): root is the smallest node reachable.

    Alternating large-star and small-star steps; minima are aggregated before the shuffle and
    met again in joins, so a hub never gathers its neighbours in one task."""
    e = edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = materialize(e, "edges")
    mark = None
    while True:
        was = e
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")).first()
        if now == mark or not now.n:
            break
        mark = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        e = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        near = e.join(low, "u")
        e = near.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        e = materialize(e, "edges")
        remove(was)
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
