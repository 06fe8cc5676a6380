"""Best-fit packing with exact-complement hashing.

Documents are encoded, each ends with an end id, and only documents longer than a sequence are
cut.  The lengths of the pieces form a histogram of at most `size` entries; packing is planned
on it, so the plan is bounded whatever the number of pieces.  Working down from the longest
length left, the gap of a sequence is filled by single, pair or triple sums found in the index
of lengths that are still available, as many times at once as availability counts allow.  Where
no combination fills the gap exactly, the largest piece that fits goes in and the rest of the
gap is looked up again; what stays open at the end is the best fit.

A piece finds its place by its rank among the pieces of its length: partition counts give each
partition its first rank, and the plan maps rank ranges of a length to sequences and offsets.

Defined cases: null text is empty and gives the end id alone; rows with null or repeated ids are
packed like others; an empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as C
from . import tokens as T

SIZE, END, VOCABULARY = 2048, 0, "word_bpe_49k.json"

_PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part int, seq bigint, nth bigint, ids binary"


def _pieces(size: int, end: int, path: str, drops_space: bool, with_ids: bool, marks: bool):
    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        seen, n = np.zeros(size + 1, np.int64), 0
        enc = T.encoder(path, drops_space, marks)
        for b in batches:
            ids, null = C.int64s(b.column(0))
            data, off = C.buffers(b.column(1))
            for i, j in C.steps(off, C.ENCODE_BYTES):
                tok, bounds = T.with_end(*enc.encode(data[off[i] : off[j]], off[i : j + 1] - off[i]), end)
                count = -(-np.diff(bounds) // size)
                doc = np.repeat(np.arange(j - i), count)
                piece = C.ragged(np.zeros(j - i, np.int64), count)
                start = piece * size
                length = np.minimum(bounds[doc + 1] - bounds[doc] - start, size)
                raw, at = memoryview(tok.astype("<u4").tobytes()), (bounds[doc] + start) * 4
                cut = [raw[a : a + m] for a, m in zip(at.tolist(), (length * 4).tolist(), strict=True)]
                # rank of each piece among those of its length in this partition
                order = np.argsort(length, kind="stable")
                first = np.searchsorted(length[order], length[order])
                nth = np.empty(len(length), np.int64)
                nth[order] = seen[length[order]] + np.arange(len(length)) - first
                seen += np.bincount(length, minlength=size + 1)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": C.nullable(ids[i:j][doc], null[i:j][doc]), "piece": pa.array(piece.astype(np.int32)), "start": start, "length": length,
                    "ids_crc32": pa.array([zlib.crc32(x) for x in cut], pa.int64()), "part": pa.array(np.full(len(doc), part, np.int32)), "seq": n + np.arange(len(doc)), "nth": nth,
                    "ids": pa.array([bytes(x) for x in cut] if with_ids else [None] * len(cut), pa.binary()),
                })
                n += len(doc)
        C.trim()

    return run


class _Sums:
    """Singles, pairs and triples of available lengths by their exact sum."""

    def __init__(self, count: np.ndarray):
        self.count = count

    def exact(self, gap: int) -> list[int] | None:
        have = self.count > 0
        if have[gap]:
            return [gap]
        a = np.arange(gap // 2, gap)
        b = gap - a
        ok = have[a] & have[b] & ((a != b) | (self.count[a] > 1)) & (b > 0)
        if ok.any():
            x = int(a[ok][-1])
            return [x, gap - x]
        for x in np.flatnonzero(have[1 : gap - 1])[::-1] + 1:
            rest = gap - int(x)
            a = np.arange((rest + 1) // 2, min(rest, int(x) + 1))
            b = rest - a
            need = 1 + (a == x).astype(int)
            ok = have[a] & have[b] & (b > 0) & (self.count[a] >= need + (a == b)) & (self.count[b] >= 1 + (b == x) + ((a == b) & (a == x)))
            if ok.any():
                y = int(a[ok][-1])
                return [int(x), y, rest - y]
            if x * 3 < gap:
                break
        return None


def plan(count: np.ndarray, size: int = SIZE) -> list[tuple[list[int], int]]:
    """(lengths of a sequence, how many such sequences) that use up count[length] pieces of each length."""
    left = count.astype(np.int64).copy()
    left[0] = 0
    sums, out = _Sums(left), []
    for longest in range(size, 0, -1):
        while left[longest] > 0:
            used = [longest]
            left[longest] -= 1
            gap = size - longest
            while gap > 0:
                more = sums.exact(gap)
                if more is None:
                    fits = np.flatnonzero(left[1 : gap + 1])
                    if not len(fits):
                        break
                    more = [int(fits[-1]) + 1]
                for x in more:
                    left[x] -= 1
                used += more
                gap -= sum(more)
            kinds, n = np.unique(used, return_counts=True)
            times = 1 + int((left[kinds] // n).min())
            left[kinds] -= n * (times - 1)
            out.append((used, times))
    return out


def _slots(made: list[tuple[list[int], int]]):
    """Per length: (first rank, sequence of that rank, offset) of each run of pieces."""
    at: dict[int, list] = {}
    rank: dict[int, int] = {}
    sequence = 0
    for used, times in made:
        offset = 0
        for x in used:
            at.setdefault(x, []).append((rank.get(x, 0), sequence, offset))
            rank[x] = rank.get(x, 0) + times
            offset += x
        sequence += times
    return at


def _place(slots):
    def run(batches):
        for b in batches:
            length, rank = np.asarray(b.column("length")), np.asarray(b.column("rank"))
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for x in np.unique(length).tolist():
                row = np.flatnonzero(length == x)
                first, base, off = (np.array(c, np.int64) for c in zip(*slots[x], strict=True))
                k = np.searchsorted(first, rank[row], "right") - 1
                sequence[row], offset[row] = base[k] + rank[row] - first[k], off[k]
            keep = [n for n in b.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in keep), pa.array(sequence), pa.array(offset)], names=[*keep, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, size: int = SIZE, end: int = END, path: str = VOCABULARY, drops_space: bool = True, with_ids: bool = False, marks: bool = True) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and ids (little-endian uint32) if asked for.

    marks: whether a special token's string in a text is that token, as in the library, or ordinary text."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = C.materialize(rows.mapInArrow(_pieces(size, end, path, drops_space, with_ids, marks), _PIECES), "pieces")
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    first = counts.select("part", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("first"))
    count = np.zeros(size + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `size` rows
        count[r.length] = r.n
    keep = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    ranked = pieces.join(first, ["part", "length"]).select(*keep, (F.col("first") + F.col("nth")).alias("rank"))
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, " + "ids binary, " * with_ids + "sequence_id bigint, offset bigint"
    return ranked.mapInArrow(_place(_slots(plan(count, size))), schema)


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id, n_tokens, doc_ids, ids: the packed sequences (pieces from pack(with_ids=True)); a group holds one sequence."""
    g = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("p"))
    return g.select("sequence_id", "n_tokens", F.col("p.doc_id").alias("doc_ids"), F.aggregate(F.col("p.ids"), F.lit(b""), lambda a, x: F.concat(a, x)).alias("ids"))


def pack_stage(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The plan of all documents: null text is its end id alone, repeated rows and rows without id are packed like others, an empty table gives no rows."""
    return pack(docs)


