"""Exact n-gram Jaccard join in metric space.

Documents are sets of word shingles; 1 - Jaccard is a metric, eps = 1 - t.

Plain pivots alone do not partition text: unrelated documents are all at distance 1 from every
pivot, so every triangle-inequality window would hold everything.  So the first cut into regions
uses one fact that stays exact: order the shingles globally, then two sets within eps share a
shingle among the first floor((1 - t) n) + 1 of each.  A region is the sets that hold a shingle
in that prefix.  The order goes by the documents expected to hold a shingle: the product of its
words' frequencies in a bounded sample, or its own count there, if that is more.  Shingles with rare
words come first, so unrelated texts hardly meet however large the table; common passages come last.
The order is a function of the shingle's words alone, so it is the same in all documents.  This prefix filter with one pivot a
region stands in place of Voronoi regions about pivots: no set is assigned to its nearest pivot,
no boundary set is replicated and nothing recurses.

Within a region
- a region of at most LEAF sets is a leaf: its pairs pass the size window n_a >= t n_b, then
- a bound: the L1 distance of two folded count vectors (sketches) never exceeds the symmetric
  difference, so it bounds the Jaccard similarity from above; it rejects most pairs;
- what remains is settled on the shingle sets themselves.
- a larger region takes its most central set as pivot, the one that lies in most regions, and
  regions with one pivot are joined.  Sets within eps of the pivot are one class with it and need
  no pairs among themselves.  Only the sets outside the region's largest component meet the
  members of other components, in chunks of both, where the triangle-inequality window on the
  distances to the pivot and the bound let them; the exact test follows.  Regions of which a map
  block holds more than LEAF sets are pre-aggregated there to one local pivot, and are large
  wherever its posting meets others.

Equal sets are one class and joined once.  Only classes that are not connected yet are compared
again, so components are exact without listing every link inside them.  Texts are not shuffled:
the sets of candidates are made again in a scan that skips other documents by a bit map of fixed
size, and the class keys drop what passes it by chance.

Defined cases: null text and texts without words have an empty set, link with nothing and are
their own component; a null doc_id takes part but gives no component id of its own (its class is
the smallest id it reaches, else null); rows that repeat an id are separate documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

WORDS, PERCENT = 5, 75
#: Sets of a region that are compared pair by pair.
LEAF = 8
#: Members and outer sets of one task, and bits of the candidate map.
MEMBERS, OUTER, MAP = 2048, 1024, 1 << 24
#: Bytes of text of a step and of an Arrow batch: what a Python worker and the JVM hold at once follows these.
STEP, BATCH = C.STEP_BYTES, C.BATCH
#: Documents that are sampled for the frequencies of words, and at most SAMPLE * WIDE, one in SHARE, for those of shingles.
SAMPLE, WIDE, SHARE = 8192, 16, 4
#: Frequent shingles and words kept from them, and bits of the words' table.
FREQUENT, VOCABULARY, SLOTS = 1 << 18, 1 << 16, 20
#: Steps of a doubling in that order.
GRAIN = 16
#: Prefix shingles that one bucket gathers about.
BUCKET = 1 << 20

_U = np.uint64


def ranked_shingles(data: np.ndarray, off: np.ndarray, k: int, weight: np.ndarray):
    """(sorted distinct shingle hashes, bounds of each document, sums of their words' weights) of one step."""
    words, first = C.word_hashes(data, off, C.GRAPHIC, 7)
    h, doc = C.shingle_hashes(words, first, k)
    rank = C.shingle_weights(weight[words >> _U(64 - SLOTS)], first, k)
    order = np.argsort(h, kind="stable")
    order = order[np.argsort(doc[order], kind="stable")]
    h, doc, rank = h[order], doc[order], rank[order]
    if len(h):
        keep = np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))
        h, doc, rank = h[keep], doc[keep], rank[keep]
    return h, np.searchsorted(doc, np.arange(len(off))), rank


def shingles(data: np.ndarray, off: np.ndarray, k: int = WORDS):
    """(sorted distinct shingle hashes, bounds of each document) of one step."""
    return ranked_shingles(data, off, k, np.zeros(1 << SLOTS, np.int16))[:2]


def set_keys(h: np.ndarray, bounds: np.ndarray):
    """Two order-free 64-bit sums that name a set."""
    out = []
    for salt in (0x1234567, 0x89ABCDE):
        total = np.append(_U(0), np.cumsum(C.mix(h + _U(salt))))
        out.append((total[bounds[1:]] - total[bounds[:-1]]).view(np.int64))
    return out


def sketch(h: np.ndarray) -> np.ndarray:
    """Counts of a set's hashes in a power of two of cells, about one or two a cell; capped counts only lower the L1 distance."""
    cells = max(16, 1 << max(0, (len(h) // 2).bit_length()))
    return np.minimum(np.bincount((h >> _U(20)).astype(np.int64) & (cells - 1), minlength=cells), 255).astype(np.uint8)


def least_difference(a: np.ndarray, b: np.ndarray) -> int:
    """A lower bound of the symmetric difference of the sketched sets."""
    a, b = a.astype(np.int64), b.astype(np.int64)
    if (a == 255).any() or (b == 255).any():  # folding must not add up capped counts
        if len(a) != len(b):
            return 0
    if len(a) > len(b):
        a, b = b, a
    b = b.reshape(-1, len(a)).sum(0)
    return int(np.abs(a - b).sum())


def most_shared(na: int, nb: int, difference: int) -> int:
    """An upper bound of the intersection."""
    return min(na, nb, (na + nb - difference) // 2)


class Order:
    """The order of shingles: its ranks are in steps of 1 / GRAIN of a doubling of the documents expected to hold a shingle."""

    def __init__(self, words, n_docs: int, n_shingles: int, n_words: int):
        """words: (hash, count) in the sample of n_docs."""
        self.base = int(self._log(n_shingles, n_docs))
        self.weight = np.full(1 << SLOTS, self._log(0.5, n_words), np.int16)
        np.maximum.at(self.weight, (words[0] >> _U(64 - SLOTS)).astype(np.int64), self._log(words[1], n_words).astype(np.int16))
        self.hash, self.rank = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, h: np.ndarray, n: np.ndarray, n_docs: int) -> None:
        """Shingles with their documents in a sample of n_docs."""
        at = np.argsort(h)
        self.hash, self.rank = h[at], self._log(n[at], n_docs)

    @staticmethod
    def _log(n, of):
        return np.rint(GRAIN * np.log2(np.maximum(n, 0.5) / max(of, 1))).astype(np.int64)

    def ranked(self, data: np.ndarray, off: np.ndarray, k: int):
        """As `ranked_shingles`, with ranks."""
        h, bounds, rank = ranked_shingles(data, off, k, self.weight)
        rank += self.base
        if len(self.hash) and len(h):
            at = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
            rank = np.where(self.hash[at] == h, np.maximum(self.rank[at], rank), rank)
        return h, bounds, rank


_SETS = "doc_id bigint, th bigint, n bigint, s1 bigint, s2 bigint, sketch binary, prefix binary"


def _sets(ordered: Order, percent: int, k: int):
    def run(batches):
        for b in batches:
            data, off = C.buffers(b.column(1))
            for i, j in C.steps(off, STEP):
                h, bounds, rank = ordered.ranked(data[off[i] : off[j]], off[i : j + 1] - off[i], k)
                n = np.diff(bounds)
                s1, s2 = set_keys(h, bounds)
                doc = np.repeat(np.arange(j - i), n)
                order = np.lexsort((rank, doc))  # h ascends within a document already
                first = h[order]
                size = np.where(n > 0, n - -(-n * percent // 100) + 1, 0)
                prefix = [C.blob(first[x : x + m]) for x, m in zip(bounds[:-1].tolist(), size.tolist(), strict=True)]
                sk = [C.blob(sketch(h[x:y])) if y > x else b"" for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0)[i:j], b.column(2)[i:j], *map(pa.array, (n, s1, s2)), pa.array(sk, pa.binary()), pa.array(prefix, pa.binary())], names=["doc_id", "th", "n", "s1", "s2", "sketch", "prefix"])

    return run


_COUNTS = "kind int, h bigint, n bigint"


def _words(k: int):
    """kind 0: counts of words, 1: documents, shingles and words in all."""

    def run(batches):
        for b in batches:
            data, off = C.buffers(b.column(0))
            for i, j in C.steps(off, STEP):
                part, at = data[off[i] : off[j]], off[i : j + 1] - off[i]
                w, bounds = C.word_hashes(part, at, C.GRAPHIC, 7)
                key, n = np.unique(w, return_counts=True)
                total = [j - i, len(C.shingle_hashes(w, bounds, k)[0]), len(w)]
                yield pa.RecordBatch.from_pydict({"kind": np.append(np.zeros(len(key), np.int32), np.ones(3, np.int32)), "h": np.append(key.view(np.int64), np.arange(3)), "n": np.append(n, total)})

    return run


def _rare(order: Order, k: int):
    """kind 0: documents of the shingles that the words put in the first half of a document, 1: documents in all."""

    def run(batches):
        for b in batches:
            data, off = C.buffers(b.column(0))
            for i, j in C.steps(off, STEP):
                h, bounds, rank = order.ranked(data[off[i] : off[j]], off[i : j + 1] - off[i], k)
                n = np.diff(bounds)
                doc = np.repeat(np.arange(j - i), n)
                at = np.lexsort((rank, doc))
                key, n = np.unique(h[at[(np.arange(len(h)) - bounds[:-1][doc]) * 2 <= n[doc]]], return_counts=True)
                yield pa.RecordBatch.from_pydict({"kind": np.append(np.zeros(len(key), np.int32), np.int32(1)), "h": np.append(key.view(np.int64), 0), "n": np.append(n, j - i)})

    return run


def _order(docs: DataFrame, k: int) -> Order:
    """The order by sampled documents: words first, then shingles that more documents hold than their words let expect."""
    n = docs.count()
    part = F.pmod(F.xxhash64("doc_id", "text", F.lit("order")), F.lit(1 << 30))

    def counted(run, most: int, limit: int):
        text = docs.where(part < ((most << 30) // max(n, 1))).select("text")
        made = C.materialize(text.mapInArrow(run, _COUNTS).groupBy("kind", "h").agg(F.sum("n").alias("n")).where("n > 1 or kind = 1"), "counts", batch=BATCH)
        got = made.where("kind = 0").orderBy(F.desc("n"), "h").limit(limit).toArrow()
        total = {x.h: x.n for x in made.where("kind = 1").collect()}
        C.remove(made)
        return (np.asarray(got["h"]).view(np.uint64), np.asarray(got["n"])), [total.get(i, 0) for i in range(3)]

    words, total = counted(_words(k), min(n, SAMPLE), VOCABULARY)
    order = Order(words, *total)
    (h, count), total = counted(_rare(order, k), min(n, SAMPLE * WIDE, max(SAMPLE, n // SHARE)), FREQUENT)
    order.add(h, count, total[0])
    return order


_POST = "kind int, bucket int, h binary, uid binary, n binary"
_POST_NAMES = ["kind", "bucket", "h", "uid", "n"]


def _post_rows(rows):
    kind, bucket, h, uid, n = zip(*rows, strict=True) if rows else ((),) * 5
    return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(bucket, pa.int32()), *(pa.array([C.blob(x) for x in y], pa.binary()) for y in (h, uid, n))], names=_POST_NAMES)


def _groups(h, uid, n):
    """Sorted by (h, uid), with group starts and sizes."""
    order = np.lexsort((uid, h))
    h, uid, n = h[order], uid[order], n[order]
    start = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
    size = np.diff(np.append(start, len(h)))
    return h, uid, n, start, size


def _star(h, uid, start, size, big):
    """Members of large groups and their pivots."""
    at = C.ragged(start[big], size[big])
    return h[at], uid[at], np.repeat(uid[start[big]], size[big])


def _postings(bits: int):
    """Per batch: one blob of (shingle, set) for each bucket; kind 1: pairs, kind 2: members of large regions.

    The size of a local pivot is negated: its group has members that the bucket does not see."""

    def run(batches):
        for b in batches:
            uid, n = np.asarray(b.column(0)), np.asarray(b.column(1))
            key = np.stack([np.asarray(b.column(2)), np.asarray(b.column(3))])
            _, one = np.unique(key, axis=1, return_index=True)
            blobs = b.column(4).to_pylist()
            h = np.frombuffer(b"".join(blobs[i] for i in one), np.uint64)
            size = np.array([len(blobs[i]) // 8 for i in one], np.int64)
            h, u, m, start, size = _groups(h, np.repeat(uid[one], size), np.repeat(n[one], size))
            rows = []
            big = size > LEAF
            sh, su, sp = _star(h, u, start, size, big)
            if len(sh):
                rows += [(1, -1, sh, su, sp), (2, -1, sh, su, sp)]
                keep = np.repeat(~big, size)
                keep[start] = True
                m[start[big]] *= -1
                h, u, m = h[keep], u[keep], m[keep]
            bucket = (h >> _U(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)
            edge = np.searchsorted(bucket, np.arange((1 << bits) + 1))
            rows += [(0, k, h[x:y], u[x:y], m[x:y]) for k, (x, y) in enumerate(zip(edge[:-1], edge[1:], strict=True)) if y > x]
            yield _post_rows(rows)

    return run


def _regions(percent: int):
    def run(table: pa.Table) -> pa.Table:
        col = lambda name, kind: np.concatenate([np.frombuffer(x, kind) for x in table[name].to_pylist()])
        h, u, m, start, size = _groups(col("h", np.uint64), col("uid", np.int64), col("n", np.int64))
        rows = []
        big = (size > 1) & ((size > LEAF) | np.logical_or.reduceat(m < 0, start)) if len(h) else size > 1
        sh, su, sp = _star(h, u, start, size, big)
        if len(sh):
            rows += [(1, -1, sh, su, sp), (2, -1, sh, su, sp)]
        at = C.ragged(start[(size > 1) & ~big], size[(size > 1) & ~big])
        h, u, m = h[at], u[at], m[at]
        ids, of = np.unique(u, return_inverse=True)
        found = []
        at = np.arange(len(h))
        for d in range(1, LEAF):
            at = at[at + d < len(h)]
            at = at[h[at] == h[at + d]]
            if not len(at):
                break
            x, y = m[at], m[at + d]
            ok = (np.minimum(x, y) * 100 >= percent * np.maximum(x, y)) & (u[at] != u[at + d])
            found.append(of[at[ok]] * np.int64(len(ids)) + of[at[ok] + d])
        pair = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        if len(pair):
            a, b = ids[pair // len(ids)], ids[pair % len(ids)]
            rows.append((1, -1, np.zeros(0, np.uint64), b, a))
        return pa.Table.from_batches([_post_rows(rows)])

    return run


def _unpack(batches):
    for b in batches:
        for kind, h, uid, p in zip(b["kind"].to_pylist(), b["h"].to_pylist(), b["uid"].to_pylist(), b["n"].to_pylist(), strict=True):
            uid, p = np.frombuffer(uid, np.int64), np.frombuffer(p, np.int64)
            h = np.frombuffer(h, np.int64) if kind == 2 else np.zeros(len(uid), np.int64)
            for i in range(0, len(uid), 1 << 16):
                yield pa.RecordBatch.from_pydict({"h": h[i : i + (1 << 16)], "a": p[i : i + (1 << 16)], "b": uid[i : i + (1 << 16)]})


_BOUND = "a bigint, b bigint, na bigint, nb bigint, shared bigint"


def _bounds(batches):
    for b in batches:
        na, nb = np.asarray(b["na"]), np.asarray(b["nb"])
        shared = [most_shared(x, y, least_difference(np.frombuffer(p, np.uint8), np.frombuffer(q, np.uint8))) for x, y, p, q in zip(na.tolist(), nb.tolist(), b["ka"].to_pylist(), b["kb"].to_pylist(), strict=True)]
        yield pa.RecordBatch.from_pydict({"a": b["a"], "b": b["b"], "na": na, "nb": nb, "shared": pa.array(shared, pa.int64())})


def _intersections(batches):
    for b in batches:
        got = []
        for p, q in zip(b["ha"].to_pylist(), b["hb"].to_pylist(), strict=True):
            p, q = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
            both = np.sort(np.concatenate([p, q]))
            got.append(int((both[1:] == both[:-1]).sum()))
        yield pa.RecordBatch.from_pydict({"a": b["a"], "b": b["b"], "na": b["na"], "nb": b["nb"], "shared": pa.array(got, pa.int64())})


def _full(k: int, bits: np.ndarray):
    def run(batches):
        for b in batches:
            spot = np.asarray(b.column(2))
            b = b.take(pa.array(np.flatnonzero((bits[spot >> 6] >> (spot & 63)) & 1)))
            data, off = C.buffers(b.column(1))
            for i, j in C.steps(off, STEP):
                h, bounds = shingles(data[off[i] : off[j]], off[i : j + 1] - off[i], k)
                s1, s2 = set_keys(h, bounds)
                yield pa.RecordBatch.from_arrays([*map(pa.array, (np.diff(bounds), s1, s2)), pa.array([C.blob(h[x:y]) for x, y in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())], names=["n", "s1", "s2", "h"])

    return run


class _Sketches:
    """Sketches of one width each, folded on demand."""

    def __init__(self, raw: list[bytes]):
        self.width = np.array([len(x) for x in raw])
        self.rows = {w: np.flatnonzero(self.width == w) for w in np.unique(self.width).tolist()}
        self.made = {(w, w): np.frombuffer(b"".join(raw[i] for i in r), np.uint8).reshape(len(r), w).astype(np.int16) for w, r in self.rows.items()}
        self.capped = np.array([255 in x for x in raw])

    def folded(self, w: int, to: int) -> np.ndarray:
        if (w, to) not in self.made:
            x = self.made[w, w]
            self.made[w, to] = x.reshape(len(x), w // to, to).sum(1, dtype=np.int32)
        return self.made[w, to]

    def least(self, one: bytes) -> np.ndarray:
        """least_difference of one sketch against all."""
        x = np.frombuffer(one, np.uint8).astype(np.int32)
        out = np.zeros(len(self.width), np.int64)
        for w, r in self.rows.items():
            to = min(w, len(x))
            ours, theirs = self.folded(w, to), x.reshape(-1, to).sum(0, dtype=np.int32)
            d, step = np.zeros(len(r), np.int64), max(1, (1 << 18) // to)
            for i in range(0, len(r), step):
                part = ours[i : i + step] - theirs
                d[i : i + step] = np.abs(part, out=part).sum(1)
            if w != len(x):
                d = np.where(self.capped[r] | (255 in one), 0, d)
            out[r] = d
        return out


def _outer(percent: int):
    """Pairs of outer sets and members of other components that may be within eps."""
    eps = (100 - percent) / 100 + 1e-9

    def run(table: pa.Table) -> pa.Table:
        member = np.asarray(table["member"])
        m, o = table.filter(pa.array(member)), table.filter(pa.array(~member))
        found = [np.zeros((6, 0), np.int64)]
        if m.num_rows and o.num_rows:
            cid, root, n, d, settled = (np.asarray(m[c]) for c in ("cid", "root", "n", "d", "settled"))
            sk = _Sketches(m["sketch"].to_pylist())
            for x in o.to_pylist():
                ok = (root != x["root"]) & (100 * np.minimum(n, x["n"]) >= percent * np.maximum(n, x["n"]))
                ok &= ~(settled & (x["d"] > d + eps)) & ~(x["settled"] & (d > x["d"] + eps))
                most = np.minimum(np.minimum(n, x["n"]), (n + x["n"] - sk.least(x["sketch"])) // 2)
                ok &= 100 * most >= percent * (n + x["n"] - most)
                hit, size, own = cid[ok], n[ok], np.full(int(ok.sum()), x["cid"])
                less = hit < x["cid"]
                found.append(np.stack([np.minimum(hit, own), np.maximum(hit, own), np.where(less, size, x["n"]), np.where(less, x["n"], size), own, most[ok] * 1_000_000 // (size + x["n"])]))
        pair = np.concatenate(found, axis=1)
        return pa.table(dict(zip(("a", "b", "na", "nb", "x", "score"), pair, strict=True)))

    return run


def _row_hash(doc_id, text):
    """Hash of a row's text, and of whether it has an id."""
    return F.xxhash64(text, (F.col(doc_id) if isinstance(doc_id, str) else doc_id).isNull())


class Join:
    """The steps of one join, which share its materialised tables."""

    def __init__(self, docs: DataFrame, percent: int = PERCENT, k: int = WORDS):
        self.percent, self.k = percent, k
        self.docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
        self.made: list[DataFrame] = []

    def keep(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        self.made.append(C.materialize(df, name, codec, BATCH))
        return self.made[-1]

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no later step reads; without tables, all."""
        tables = tables or tuple(self.made)
        self.made = [x for x in self.made if all(x is not t for t in tables)]
        C.remove(*tables)

    def near(self, slack: int = 0):
        """SQL: the pair's shared shingles reach the threshold less slack percent."""
        return f"100 * shared >= {self.percent - slack} * (na + nb - shared)"

    def prepare(self) -> None:
        made = self.docs.select("doc_id", "text", _row_hash("doc_id", "text").alias("th")).mapInArrow(_sets(_order(self.docs, self.k), self.percent, self.k), _SETS)
        self.sets = self.keep(made.withColumn("uid", F.monotonically_increasing_id()), "sets")
        members = self.sets.where("n > 0").select("uid", "doc_id", "n", "s1", "s2")
        self.classes = self.keep(members.groupBy("n", "s1", "s2").agg(F.min("uid").alias("cid"), F.min("doc_id").alias("doc_id")), "classes")
        self.rows = self.keep(members.drop("doc_id").join(self.classes.drop("doc_id"), ["n", "s1", "s2"]).select("uid", "cid"), "rows")

    def candidates(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Pairs of classes that share a region, the members of large regions: (h, cid), and the table behind the pairs."""
        total = self.sets.agg(F.sum(F.length("prefix"))).first()[0] or 0
        bits = max(8, int(total // 8 // BUCKET).bit_length())
        post = self.sets.where("n > 0").select("uid", "n", "s1", "s2", "prefix").mapInArrow(_postings(bits), _POST)
        shared = post.where("kind = 0").groupBy("bucket").applyInArrow(_regions(self.percent), _POST)
        both = self.keep(post.where("kind > 0").unionByName(shared), "regions")
        prefixed, self.sets = self.sets, self.keep(self.sets.drop("prefix"), "sets")
        self.drop(prefixed)
        pairs = both.where("kind = 1").mapInArrow(_unpack, "h bigint, a bigint, b bigint").select("a", "b").distinct()
        large = both.where("kind = 2").mapInArrow(_unpack, "h bigint, a bigint, b bigint")
        large = large.select("h", F.col("a").alias("uid")).unionByName(large.select("h", F.col("b").alias("uid"))).distinct()
        large = large.join(self.rows, "uid").select("h", "cid").distinct()
        return self.named(pairs), self.keep(large, "large"), both

    def named(self, pairs: DataFrame) -> DataFrame:
        """Pairs of rows as distinct pairs of classes."""
        left = self.rows.select(F.col("uid").alias("a"), F.col("cid").alias("ca"))
        right = self.rows.select(F.col("uid").alias("b"), F.col("cid").alias("cb"))
        out = pairs.join(left, "a").join(right, "b").where("ca != cb")
        return out.select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct()

    def bounded(self, pairs: DataFrame) -> DataFrame:
        """Pairs of classes with an upper bound of their shared shingles."""
        s = self.sets.select("uid", "n", "sketch")
        left = s.select(F.col("uid").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("ka"))
        right = s.select(F.col("uid").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("kb"))
        return pairs.join(left, "a").join(right, "b").where(f"100 * least(na, nb) >= {self.percent - 25} * greatest(na, nb)").mapInArrow(_bounds, _BOUND)

    def full(self, pairs: DataFrame) -> DataFrame:
        """(cid, h): the shingle sets of the pairs' classes."""
        need = pairs.select(F.col("a").alias("cid")).unionByName(pairs.select(F.col("b").alias("cid"))).distinct().join(self.classes, "cid")
        spot = F.pmod(F.xxhash64("doc_id"), F.lit(MAP))
        need = self.keep(need.withColumn("spot", spot), "need")
        words = need.groupBy(F.shiftright("spot", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(spot & 63 as int))")).alias("x")).toArrow()  # MAP / 64 rows at most
        bits = np.zeros(MAP // 64, np.int64)
        bits[np.asarray(words["w"])] = np.asarray(words["x"])
        made = self.docs.select("doc_id", "text", spot.alias("spot")).mapInArrow(_full(self.k, bits), "n bigint, s1 bigint, s2 bigint, h binary")
        made = made.hint("merge").join(need.select("n", "s1", "s2", "cid").hint("merge"), ["n", "s1", "s2"]).select("cid", "h").dropDuplicates(["cid"])
        return self.keep(made, "full", "none")

    def exact(self, pairs: DataFrame, full: DataFrame) -> DataFrame:
        """The pairs that reach the threshold, of pairs with na and nb."""
        left = full.select(F.col("cid").alias("a"), F.col("h").alias("ha"))
        right = full.select(F.col("cid").alias("b"), F.col("h").alias("hb"))
        joined = pairs.hint("merge").join(left.hint("merge"), "a").hint("merge").join(right.hint("merge"), "b")
        return self.keep(joined.mapInArrow(_intersections, _BOUND), "met")

    def apart(self, pairs: DataFrame, edges: DataFrame) -> DataFrame:
        """Pairs whose classes are not connected yet."""
        roots = C.components(edges)
        left = roots.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        right = roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        joined = pairs.join(left, "a", "left").join(right, "b", "left")
        return self.keep(joined.where("coalesce(ra, a) != coalesce(rb, b)").drop("ra", "rb"), "apart")

    def linked(self, met: DataFrame) -> DataFrame:
        return met.where(self.near()).select("a", "b")

    def edges(self) -> DataFrame:
        self.prepare()
        pairs, large, both = self.candidates()
        # the most central set of a large region is its pivot, and regions are named by pivots
        degree = large.groupBy("cid").agg(F.count("*").alias("degree"))
        pivot = large.join(degree, "cid").groupBy("h").agg(F.max(F.struct("degree", F.expr("-cid").alias("c"))).alias("m")).select("h", F.expr("-m.c").alias("p"))
        region = self.keep(large.join(pivot, "h").select("p", "cid").distinct(), "region")
        star = region.where("p != cid").select(F.least("p", "cid").alias("a"), F.greatest("p", "cid").alias("b"))
        bounds = self.keep(self.bounded(pairs.unionByName(star).distinct()).where(self.near(25)), "bounds")
        self.drop(both, large)
        near = bounds.where(self.near())
        full = self.full(near)
        # first each set with its pivot, or its first partner, then the pairs that are still apart
        centre = region.select(F.col("p").alias("c")).distinct()
        ranked = near.join(centre.withColumn("pa", F.lit(0)), F.col("a") == F.col("c"), "left").drop("c").join(centre.withColumn("pb", F.lit(0)), F.col("b") == F.col("c"), "left").drop("c")
        own = ranked.select("a", "b", "na", "nb", F.coalesce("pa", F.lit(1)).alias("pa"), F.coalesce("pb", F.lit(1)).alias("pb"))
        picks = own.select(F.col("b").alias("x"), F.struct("pa", "a", "b", "na", "nb").alias("f")).unionByName(own.where("pb = 0").select(F.col("a").alias("x"), F.struct(F.col("pb").alias("pa"), "a", "b", "na", "nb").alias("f")))
        first = self.keep(picks.groupBy("x").agg(F.min("f").alias("f")).select("f.a", "f.b", "f.na", "f.nb").distinct(), "first")
        met = self.exact(first, full)
        edges = self.keep(self.linked(met), "links")
        rest = self.apart(near.join(first.select("a", "b"), ["a", "b"], "left_anti").select("a", "b", "na", "nb"), edges)
        more = self.exact(rest, full)
        self.drop(full)
        edges = self.keep(edges.unionByName(self.linked(more)), "links")
        if region.isEmpty():
            return edges
        # sets outside the largest component of their region, against its other components
        settled = met.unionByName(more).withColumn("settled", F.lit(True))
        known = bounds.join(settled.select("a", "b"), ["a", "b"], "left_anti").withColumn("settled", F.lit(False)).unionByName(settled)
        known = known.select("a", "b", F.expr("1 - shared / (na + nb - shared)").alias("d"), "settled")
        roots = C.components(edges)
        of = region.join(roots, region["cid"] == roots["node"], "left").select("p", "cid", F.coalesce("root", "cid").alias("root"))
        of = of.withColumns({"a": F.least("p", "cid"), "b": F.greatest("p", "cid")}).join(known, ["a", "b"], "left")
        self_ = F.col("p") == F.col("cid")
        of = self.keep(of.select("p", "cid", "root", F.when(self_, 0.0).otherwise(F.coalesce("d", F.lit(0.5))).alias("d"), (self_ | F.coalesce("settled", F.lit(False))).alias("settled")), "region")
        parts = of.groupBy("p", "root").agg(F.count("*").alias("n"))
        main = parts.groupBy("p").agg(F.max(F.struct("n", "root")).alias("m"), F.sum("n").alias("all"), F.count("*").alias("parts")).where("parts > 1")
        main = main.select("p", F.col("m.root").alias("main"), F.ceil(F.col("all") / MEMBERS).cast("int").alias("mc"), F.ceil((F.col("all") - F.col("m.n")) / OUTER).cast("int").alias("oc"))
        rows = of.join(main, "p").join(self.sets.select(F.col("uid").alias("cid"), "n", "sketch"), "cid")
        cols = ["cid", "root", "n", "d", "settled", "sketch"]
        ours = rows.select("p", F.expr("cast(pmod(xxhash64(cid), mc) as int)").alias("mi"), F.explode(F.expr("sequence(0, oc - 1)")).alias("oi"), F.lit(True).alias("member"), *cols)
        theirs = rows.where("root != main").select("p", F.explode(F.expr("sequence(0, mc - 1)")).alias("mi"), F.expr("cast(pmod(xxhash64(cid, 1), oc) as int)").alias("oi"), F.lit(False).alias("member"), *cols)
        tasks = ours.unionByName(theirs).groupBy("p", "mi", "oi").applyInArrow(_outer(self.percent), "a bigint, b bigint, na bigint, nb bigint, x bigint, score bigint")
        last = self.keep(tasks.join(settled.select("a", "b"), ["a", "b"], "left_anti"), "outer")
        # again each with its likeliest partner first, then what is still apart
        full = self.full(last)
        best = last.groupBy("x").agg(F.max(F.struct("score", "a", "b", "na", "nb")).alias("f")).select("f.a", "f.b", "f.na", "f.nb").distinct()
        edges = self.keep(edges.unionByName(self.linked(self.exact(best, full))), "links")
        rest = self.apart(last.join(best.select("a", "b"), ["a", "b"], "left_anti").select("a", "b", "na", "nb").distinct(), edges)
        return edges.unionByName(self.linked(self.exact(rest, full)))

    def placed(self) -> DataFrame:
        """doc_id, th, n and root (null: no words) per row."""
        roots = C.components(self.edges())
        of = self.rows.join(roots, self.rows["cid"] == roots["node"], "left").select("uid", F.coalesce("root", "cid").alias("root"))
        out = C.materialize(self.sets.select("uid", "doc_id", "th", "n").join(of, "uid", "left"), "roots")
        self.drop()
        return out

    def result(self) -> DataFrame:
        """doc_id, n_shingles, component_id per row."""
        of = self.placed()
        least = of.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("component"))
        return of.join(least, "root", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def join(docs: DataFrame, percent: int = PERCENT, k: int = WORDS) -> DataFrame:
    return Join(docs, percent, k).result()


def one_of_each(spark: SparkSession, docs: DataFrame, percent: int = PERCENT, k: int = WORDS) -> DataFrame:
    """Exactly one row of each component, with its columns: the smallest id, then hash of text; rows without an id come last.

    One row of repeated equal rows (id and text) stays.  Rows without words are kept."""
    at = [F.coalesce("doc_id", F.lit(0)).alias("i"), F.col("th").alias("t")]
    placed = Join(docs, percent, k).placed()
    of = placed.where("root is not null").select("root", F.struct(F.col("doc_id").isNull().alias("none"), *at).alias("row"))
    best = of.groupBy("root").agg(F.min("row").alias("best"))
    marks = of.groupBy("root", "row").agg(F.count("*").alias("n")).join(best, "root")
    marks = marks.withColumn("gone", F.col("row") != F.col("best")).where("gone or n > 1").select("row.i", "row.t", "gone")
    marks = C.materialize(marks, "marks")
    C.remove(placed)
    flat = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # no column of the caller can clash
    id_, text = F.col(f"c{docs.columns.index('doc_id')}").cast("bigint"), F.col(f"c{docs.columns.index('text')}").cast("string")
    own = flat.withColumns({"i": F.coalesce(id_, F.lit(0)), "t": _row_hash(id_, text)})
    # never broadcast: the number of dropped rows follows the input
    left = own.hint("merge").join(marks.hint("merge"), ["i", "t"], "left").where("NOT coalesce(gone, false)")
    # equal rows lie together after the join
    left = left.withColumn("nth", F.row_number().over(Window.partitionBy("i", "t").orderBy("i"))).where("gone is null or nth = 1")
    return left.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)))
