"""LM scoring with a probabilistic suffix tree over tokens.

Symbols are the lower-cased white-space tokens and one end mark.  The root's distribution is the
add-half unigram over the V training types and one class of unknown tokens, which is the base
score.  A context is the one to `DEPTH` tokens before a place; with n its occurrences in training
and n_x those that x follows, it is kept as a state where

- n is at least `LEAST`, and
- what its followers diverge from its parent (the context without its first token) pays for
  naming them: sum over followers seen twice or more of
  n_x log((n_x / n) / (m_x / m)) - log(1 / root(x)) is at least `GAIN` nats, with m_x, m the
  parent's counts (the root's distribution for one token).  The first part is n times the
  followers' share of the Kullback-Leibler divergence.

A state's next-symbol distribution is discounted and smoothed towards the next shorter state's:
P(x) = max(n_x - DISCOUNT, 0) / n for followers seen twice or more, and all mass that is left,
which is that of followers seen once and of the discounts, is spread like the shorter state's
distribution.  A place is scored from its longest kept state.

Documents become blocks of token sequences, written once, bucketed by block.  All numbers come
from exchanges: each block sends its distinct n-grams (64-bit hashes) with its own counts,
bucketed by hash, and gets their sums back; so an n-gram is one row of a block however often it
occurs, and no context is gathered anywhere.  An n-gram is sent only if its two shorter parts
occur twice (its own count is known otherwise).  Three exchanges count 1 to DEPTH + 1 tokens, a
last one adds up what each context's followers gain.

Defined cases: null text is empty (its end alone); null ids count as training documents; repeated
rows count each; without training documents all counts are 0.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

FOLDS, HELD = 5, 1
DEPTH, LEAST, GAIN, DISCOUNT = 2, 2, 3.0, 0.5
#: Bytes of a block, n-grams of blocks that a bucket gathers, and files of blocks at most.
BLOCK_BYTES, BUCKET, FILES = 6 << 20, 1 << 19, 50_000

_U = np.uint64
#: The end mark; as a hash it is one of 2**64.
END = _U(0x51ED2701A9B4C3D7)
_M = _U(0x9E3779B97F4A7C15)
_BLOCKS = "bid bigint, n_docs bigint, n_places bigint, doc_id binary, nulls binary, held binary, size binary, seq binary, token binary"
_NAMES = [x.split()[0] for x in _BLOCKS.split(", ")]


def pack_keys(key: np.ndarray) -> bytes:
    """Ascending keys as differences, byte planes apart, so that compression finds the high bytes' zeros."""
    return C.blob(np.diff(key, prepend=_U(0)).view(np.uint8).reshape(-1, 8).T)


def unpack_keys(raw: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view(np.uint64).reshape(-1), dtype=np.uint64)


def squeeze(raw: bytes) -> bytes:
    return zstandard.compress(raw, 1)


def expand(raw: bytes) -> bytes:
    return zstandard.decompress(raw)


def pack_values(x: np.ndarray) -> bytes:
    """Numbers that are mostly small or zero."""
    return squeeze(C.blob(x.view(np.uint8).reshape(-1, x.itemsize).T))


def unpack_values(raw: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(expand(raw), np.uint8).reshape(size, -1).T).view(kind).reshape(-1)


def _blocks(batches):
    """Blocks of whole documents: each document's symbols as places in the block's ascending distinct symbols."""
    from pyspark import TaskContext

    bid = TaskContext.get().partitionId() << 32
    for b in batches:
        ids, null = C.int64s(b.column(0))
        held = np.asarray(b.column(2))
        data, off = C.buffers(b.column(1))
        for i, j in C.steps(off, BLOCK_BYTES):
            words, bounds = C.word_hashes(data[off[i] : off[j]], off[i : j + 1] - off[i], C.GRAPHIC, 9)
            size = np.diff(bounds) + 1
            last = np.cumsum(size) - 1
            symbols = np.full(len(words) + j - i, END)
            inner = np.ones(len(symbols), bool)
            inner[last] = False
            symbols[inner] = words
            token, of = np.unique(symbols, return_inverse=True)
            made = [squeeze(C.blob(x)) for x in (ids[i:j], null[i:j], held[i:j], size)] + [pack_values(of.astype(np.int32)), squeeze(pack_keys(token))]
            yield pa.RecordBatch.from_pydict({"bid": pa.array([bid]), "n_docs": pa.array([j - i]), "n_places": pa.array([len(of)])} | {k: pa.array([x], pa.binary()) for k, x in zip(_NAMES[3:], made, strict=True)})
            bid += 1


class Block:
    """One block's places, and the counts of its n-grams as far as they are known."""

    def __init__(self, row: dict):
        of = lambda c, t: np.frombuffer(expand(row[c]), t)
        self.doc_id, self.nulls, self.held, self.size = of("doc_id", np.int64), of("nulls", bool), of("held", bool), of("size", np.int64)
        self.seq = unpack_values(row["seq"], np.int32)
        self.token = unpack_keys(expand(row["token"]))
        self.doc = np.repeat(np.arange(len(self.size)), self.size)
        self.train = ~self.held[self.doc]
        #: Place within the document.
        self.at = np.arange(len(self.seq)) - np.repeat(np.cumsum(self.size) - self.size, self.size)
        self.grams = [self.token[self.seq]]
        #: Training counts of the n-gram that ends at each place, for n = 1, 2, ...
        self.counts: list[np.ndarray] = []

    def gram(self, n: int) -> np.ndarray:
        """Hash of the n-gram that ends at each place (for places with n - 1 before them)."""
        while len(self.grams) < n:
            last, out = self.grams[-1], np.zeros(len(self.seq), np.uint64)
            out[1:] = C.mix(last[:-1] * _M + self.grams[0][1:] + _U(len(self.grams)))
            self.grams.append(out)
        return self.grams[n - 1]

    def before(self, x: np.ndarray) -> np.ndarray:
        """x of the place before."""
        return np.concatenate([x[:1] * 0, x[:-1]])

    def asked(self, n: int) -> np.ndarray:
        """Places whose n-gram's count does not follow from shorter ones."""
        if n == 1:
            return np.arange(len(self.seq))
        own, head = self.counts[n - 2], self.before(self.counts[n - 2])
        return np.flatnonzero((self.at >= n - 1) & (head >= 2) & (own >= np.where(self.train, 2, 1)))

    def keys(self, n: int):
        """(distinct n-grams asked for, which of them each asked place holds, the places)."""
        place = self.asked(n)
        if n == 1:
            return self.token, self.seq, place
        key, of = np.unique(self.gram(n)[place], return_inverse=True)
        return key, of, place

    def ask(self, n: int):
        """Distinct n-grams and their training counts in this block."""
        key, of, place = self.keys(n)
        return key, [np.bincount(of[self.train[place]], minlength=len(key)).astype(np.int32)]

    def learn(self, n: int, total: np.ndarray) -> None:
        """Take the sums of what ask sent."""
        _, of, place = self.keys(n)
        out = np.where(self.train & (self.at >= n - 1), 1, 0)
        out[place] = total[of]
        self.counts.append(out)

    def contexts(self, depth: int):
        """(places, distinct contexts, context of each place) where a context of `depth` tokens may be a state."""
        place = np.flatnonzero((self.at >= depth) & (self.before(self.counts[depth - 1]) >= LEAST))
        key, of = np.unique(self.gram(depth)[place - 1], return_inverse=True)
        return place, key, of

    def root(self, whole: float) -> np.ndarray:
        return (self.counts[0] + 0.5) / whole

    def gains(self, depth_most: int, whole: float):
        """Contexts of all lengths with what their followers in this block gain, and n_x - DISCOUNT over them."""
        keys, gain, mass = [], [], []
        root = self.root(whole)
        for d in range(1, depth_most + 1):
            place, key, of = self.contexts(d)
            own, n = self.counts[d][place], self.counts[d - 1][place - 1]
            told = self.train[place] & (own >= 2)
            place, of, own, n = place[told], of[told], own[told], n[told]
            parent = root[place] if d == 1 else self.counts[d - 1][place] / self.counts[d - 2][place - 1]
            # each of a follower's n_x occurrences brings its share of the costs
            bits = np.log(own / n / parent) + np.log(root[place]) / own
            keys.append(C.mix(key + _U(d)))
            gain.append(np.bincount(of, bits, len(key)))
            mass.append(np.bincount(of, 1 - DISCOUNT / own, len(key)))
        keys, gain, mass = np.concatenate(keys), np.concatenate(gain), np.concatenate(mass)
        order = np.argsort(keys)
        return keys[order], [gain[order].astype(np.float32), mass[order].astype(np.float32)], order

    def score(self, depth_most: int, whole: float, mass: np.ndarray):
        """(base, score) of each document; mass: of contexts as `gains` sorts them, 0 for those that are no states."""
        root = self.root(whole)
        p, order = root.copy(), self.gains(depth_most, whole)[2]
        own = np.empty(len(order))
        own[order] = mass
        at = 0
        for d in range(1, depth_most + 1):
            place, key, of = self.contexts(d)
            held = own[at : at + len(key)][of]
            at += len(key)
            place, held = place[held > 0], held[held > 0]
            n, follows = self.counts[d - 1][place - 1], self.counts[d][place]
            p[place] = np.where(follows >= 2, follows - DISCOUNT, 0) / n + (1 - held / n) * p[place]
        sums = lambda x: np.bincount(self.doc, np.log10(x), len(self.size))
        return sums(root), sums(p)


#: What an exchange sends: sorted keys and the values of each.
_SENT = "bucket int, bid bigint, key binary, x binary, y binary"
_BACK = "bucket int, bid bigint, x binary, distinct bigint, total bigint"


def _rows(batch):
    """The rows of a batch, one at a time."""
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


def _known(row: dict, lists: list, kinds: int) -> Block:
    """A block with the counts that earlier exchanges returned."""
    block = Block(row)
    for n in range(1, kinds + 1):
        block.learn(n, np.concatenate([np.zeros(0, np.int64), *(unpack_values(x["x"], np.int64) for x in lists[n - 1] or [])]))
    return block


def _send(n: int, bits: int, whole: float, depth: int):
    """Blobs of keys and values for each bucket; n = 0 sends gains."""

    def run(batches):
        for b in batches:
            for row in _rows(b):
                block = _known(row, [row.get(f"l{k}") for k in range(1, depth + 2)], n - 1 if n else depth + 1)
                key, values = block.ask(n) if n else block.gains(depth, whole)[:2]
                edge = np.searchsorted(key >> _U(64 - bits), np.arange((1 << bits) + 1).astype(np.uint64))
                k = np.flatnonzero(np.diff(edge))
                part = lambda x: pa.array([pack_values(x[edge[y] : edge[y + 1]]) for y in k], pa.binary())  # noqa: B023, E731
                packed = pa.array([pack_keys(key[edge[y] : edge[y + 1]]) for y in k], pa.binary())
                yield pa.RecordBatch.from_pydict({"bucket": pa.array(k.astype(np.int32)), "bid": pa.array(np.full(len(k), row["bid"])), "key": packed, "x": part(values[0]), "y": part(values[1] if len(values) > 1 else values[0][:0])})

    return run



def _answer(counting: bool):
    """One bucket: sums over all blocks, in each block's order."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("bid")
        keys = [unpack_keys(x) for x in table["key"].to_pylist()]
        flat = lambda c, t: np.concatenate([unpack_values(x, t) for x in table[c].to_pylist()])
        key, of = np.unique(np.concatenate(keys), return_inverse=True)
        if counting:
            sums = back = np.bincount(of, flat("x", np.int32), len(key)).astype(np.int64)
        else:
            sums = np.bincount(of, flat("x", np.float32), len(key))
            back = np.where(sums >= GAIN, np.bincount(of, flat("y", np.float32), len(key)), 0).astype(np.float32)
        edge = np.cumsum([0, *map(len, keys)])
        rest = [0] * (len(keys) - 1)
        return pa.table({
            "bucket": table["bucket"], "bid": table["bid"], "x": pa.array([pack_values(back[of[a:b]]) for a, b in zip(edge[:-1], edge[1:], strict=True)], pa.binary()),
            "distinct": pa.array([int((sums > 0).sum()), *rest], pa.int64()), "total": pa.array([int(sums.sum()), *rest], pa.int64()),
        })

    return run


_SCORES = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def _scored(depth: int, whole: float, train_tokens: int):
    def run(batches):
        for b in batches:
            for row in _rows(b):
                block = _known(row, [row[f"l{k}"] for k in range(1, depth + 2)], depth + 1)
                mass = np.concatenate([np.zeros(0, np.float32), *(unpack_values(x["x"], np.float32) for x in row["l0"] or [])])
                base, score = block.score(depth, whole, mass)
                known = np.bincount(block.doc, block.counts[0] > 0, len(block.size)).astype(np.int64)
                yield pa.RecordBatch.from_pydict({"doc_id": C.nullable(block.doc_id, block.nulls), "held_out": block.held, "n_tokens": block.size, "n_known": known, "train_tokens": np.full(len(known), train_tokens), "base_score": base, "score": score})

    return run


def score(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document; held-out documents teach nothing."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), (C.fold("doc_id", FOLDS) == HELD).alias("held"))
    made = C.materialize(rows.mapInArrow(_blocks, _BLOCKS), "blocks", "none")
    n_blocks, places = made.agg(F.count("*"), F.sum("n_places")).first()
    if not n_blocks:
        return spark.createDataFrame([], _SCORES)
    # blocks lie bucketed, so that what comes back to them moves and they do not
    table = f"suffix_blocks_{uuid.uuid4().hex}"
    files = min(FILES, n_blocks)
    with C.tidy(spark):
        made.repartition(files, "bid").write.bucketBy(files, "bid").option("path", f"{C.shared_dir(spark)}/{table}").option("compression", "none").saveAsTable(table)
    C.remove(made)
    blocks, lists, whole, train = spark.table(table), {}, 0.0, 0
    bits = max(4, int(places // BUCKET).bit_length())
    for n in [*range(1, depth + 2), 0]:
        sent = _joined(blocks, lists, files).mapInArrow(_send(n, bits, whole, depth), _SENT)
        back = C.materialize(sent.groupBy("bucket").applyInArrow(_answer(n > 0), _BACK), "counts")
        lists[n] = back
        if n == 1:
            distinct, train = back.agg(F.sum("distinct"), F.sum("total")).first()
            whole = train + 0.5 * (distinct + 1)
    out = C.materialize(_joined(blocks, lists, files).mapInArrow(_scored(depth, whole, train), _SCORES), "scores")
    spark.sql(f"DROP TABLE {table}")
    C.remove(f"{C.shared_dir(spark)}/{table}", *lists.values(), spark=spark)
    return out


def _joined(blocks: DataFrame, lists: dict, files: int) -> DataFrame:
    """Blocks with what came back to each, as columns l1, l2, ... (counts) and l0 (masses)."""
    out = blocks
    for n, back in lists.items():  # dealt like the blocks' buckets
        own = back.repartition(files, "bid").groupBy("bid").agg(F.sort_array(F.collect_list(F.struct("bucket", "x"))).alias(f"l{n}"))  # one block's own n-grams
        out = out.hint("merge").join(own.hint("merge"), "bid", "left")
    return out
