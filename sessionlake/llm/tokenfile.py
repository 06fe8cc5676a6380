"""Token-id files: adaptive context mixing and a range coder in independent blocks.

A file is a table of segments.  A segment holds the ids of consecutive documents; its stream is
cut into equal blocks.  Every block starts from a reset model, has its own code words and its own
CRC-32, and can be decoded alone.

The model predicts each id three ways: the id that last followed the two ids before it (order 2,
in slots checked by a 16-bit tag), the one that last followed the id before it (order 1, checked by
that id; where the block has not met it, the follower that was frequent in the segment's beginning)
and the frequencies of ids in the segment (order 0).  These are mixed into one distribution: the
guess of order 1 and that of order 2 get weights that adapt to how often either was right in the
same situation (order 1 met in the block or not; order 2 unknown, agreeing, differing), and order 0
shares the rest over all ids.  One range coder step codes an id under the mixture: 48-bit low, 16-bit
words, carries resolved in the output.

The order-0 frequencies and first guesses of a segment are stored in its header; every block starts
from them with empty tables, so a block needs the header and its own code words only.

All blocks of a segment advance together, an id of each a step, so numpy works on whole columns
of blocks.  Blocks are `BLOCK` ids, shorter in small segments.

Defined cases: null text is empty (its end id alone); null ids of documents sort first; rows that
repeat an id lie in the order of their texts, equal rows are documents of their own; a document lies in one segment whatever its length; an empty
table gives an empty file.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as C
from . import tokens as T

END, VOCABULARY = 2, "byte_bpe_50k.json"
BLOCK, LEAST_BLOCK, LANES = 2048, 256, 2048
#: Ids of a segment about; a longer document makes a longer one.  Those of over BLOCK * LANES ids have more blocks, so no more steps.
SEGMENT = 1 << 23
MAGIC = b"TIDS2\0"

_RENORM, _LOW, _ALL = 1 << 32, (1 << 32) - 1, (1 << 48) - 1
#: Slots of the order-1 and order-2 tables of a block.
_SLOTS1, _SLOTS2 = 256, 512
#: Weights are kept in 16 bits and used in 8; their sum stays under _FULL, so order 0 always has a share.
_WEIGHT_BITS, _FULL, _RATE = 8, 65000, 5
_NONE = 0xFFFF
#: Steps of the encoder that are looked up together.
_STEPS = 4
#: Ids from whose neighbours the first order-1 guesses are taken; only the compression depends on it.
_LEARN = 1 << 18


class Prior:
    """What every block of a segment starts from: its ids, their order-0 frequencies, a first guess of each id's follower."""

    def __init__(self, known: np.ndarray, freq: np.ndarray, follower: np.ndarray):
        self.known, self.freq, self.follower = known.astype(np.int64), freq.astype(np.int64), follower.astype(np.int64)
        self.bits = int(self.freq.sum()).bit_length() - 1
        self.cum = np.append(0, np.cumsum(self.freq))
        self.symbol = np.repeat(np.arange(len(freq)), self.freq)

    @classmethod
    def of(cls, ids: np.ndarray) -> tuple[Prior, np.ndarray]:
        """The prior of ids, and the ids as places in it."""
        n = np.bincount(ids, minlength=1)
        known = np.flatnonzero(n) if len(ids) else np.zeros(1, np.int64)
        place = np.zeros(len(n), np.int64)
        place[known] = np.arange(len(known))
        n, x = n[known], place[ids]
        size = 1 << max(10, len(known).bit_length() + 2)
        freq = 1 + n * (size - len(known)) // max(1, n.sum())
        freq[n.argmax()] += size - freq.sum()
        head = x[:_LEARN]
        pair, times = np.unique(head[:-1] * len(known) + head[1:], return_counts=True)
        pair = pair[np.argsort(times, kind="stable")]  # the most frequent follower is written last
        follower = np.zeros(len(known), np.int64)
        follower[pair // len(known)] = pair % len(known)
        return cls(known, freq, follower), x

    def pack(self) -> bytes:
        raw = self.known.astype("<u2").tobytes() + self.freq.astype("<u4").tobytes() + self.follower.astype("<u2").tobytes()
        return zlib.compress(raw, 1)

    @classmethod
    def unpack(cls, raw: bytes) -> Prior:
        try:
            raw = zlib.decompress(raw)
        except zlib.error as e:
            raise ValueError("header: not readable") from e
        n = len(raw) // 8
        return cls(np.frombuffer(raw, "<u2", n), np.frombuffer(raw, "<u4", n, 2 * n), np.frombuffer(raw, "<u2", n, 6 * n))


def _same(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """-1 where two arrays of values from 0 on are equal, else 0: masks of 32 bits cost no conversions."""
    return ((a ^ b) - 1) >> 31


class _Model:
    """Prediction state of many blocks, one lane each; a lane knows nothing of the others.

    Methods take one step of all lanes, or rows of steps; where orders 1 and 2 are treated alike, the
    last axis but one has both.  Lanes lie side by side in each slot, as contexts that are frequent in
    one are in others: what is in use stays in the cache."""

    def __init__(self, prior: Prior, lanes: int):
        self.follower = prior.follower.astype(np.int32)
        self.lanes, self.lane = lanes, np.arange(lanes)
        # id before and id after, then hash of the two ids before and id after
        self.slots = np.full((_SLOTS1 + _SLOTS2) * lanes, _NONE << 16, np.uint32).view(np.int32)
        # by context: whether order 1 was seen in the block; no order 2, it agrees, it differs
        self.weights = np.repeat(np.array([0, 0, 12000] * 2 + [16000, 30000, 16000] * 2, np.int32), lanes)
        self.orders = np.array([[0], [6 * lanes]])

    def places(self, before: np.ndarray, earlier: np.ndarray):
        """Slots of both orders, and what has to stand there."""
        shape = (*before.shape[:-1], 2, before.shape[-1])
        at, key = np.empty(shape, np.int64), np.empty(shape, np.int32)
        h = before * 40503 + earlier * 30011
        key[..., 0, :] = before
        np.bitwise_and(h, _NONE, out=key[..., 1, :])
        at[..., 0, :] = before & (_SLOTS1 - 1)
        at[..., 1, :] = ((h >> 4) & (_SLOTS2 - 1)) + _SLOTS1
        at *= self.lanes
        at += self.lane
        return at, key

    def guess(self, key: np.ndarray, slot: np.ndarray):
        """Guesses of both orders, whether they differ, the places of their weights."""
        same = _same((slot.view(np.uint32) >> 16).view(np.int32), key)
        both = slot & _NONE
        one, two, seen, known = both[..., 0, :], both[..., 1, :], same[..., 0, :], same[..., 1, :]
        one ^= (one ^ self.follower.take(key[..., 0, :])) & ~seen
        two ^= (two ^ one) & ~known
        apart = ~_same(one, two)
        at = self.lane - (seen * 3 + known + apart) * self.lanes
        return both, apart, at[..., None, :] + self.orders

    @staticmethod
    def moved(held: np.ndarray, hit: np.ndarray, apart: np.ndarray) -> np.ndarray:
        """Weights after a step: they move towards the orders that were right."""
        aim = hit & _FULL
        aim[..., 0, :] &= apart
        return held + ((aim - held) >> _RATE)


def encode(x: np.ndarray, prior: Prior, block: int) -> list[bytes]:
    """Code words of each block of places in the prior.

    The ids are known, so all that does not need the step before is done for `_STEPS` steps at once."""
    lanes = -(-len(x) // block)
    wide = np.zeros(lanes * block, np.uint16)
    wide[: len(x)] = x
    cols = np.ascontiguousarray(wide.reshape(lanes, block).T)
    m, cum, freq = _Model(prior, lanes), prior.cum.astype(np.int32), prior.freq.astype(np.int32)
    slots, weights = m.slots, m.weights
    total = prior.bits + _WEIGHT_BITS
    low, rng = np.zeros(lanes, np.int64), np.full(lanes, _ALL)
    past = np.zeros((_STEPS + 2, lanes), np.int32)  # two steps before these, and these
    slot, held = np.empty((_STEPS, 2, lanes), np.int32), np.empty((_STEPS, 2, lanes), np.int32)
    who, what = [], []  # lanes and their code words; bit 16 of a word is a carry to the word before

    def emit(live: np.ndarray, part: np.ndarray):
        who.append(live.astype(np.uint32))
        what.append((part >> 32).astype(np.uint32))

    for t in range(0, block, _STEPS):
        n = min(_STEPS, block - t)
        past[2 : n + 2] = cols[t : t + n]
        s, before, earlier = past[2 : n + 2], past[1 : n + 1], past[:n]
        at, key = m.places(before, earlier)
        put = (key << 16) | s[:, None]
        for k in range(n):
            slot[k] = slots.take(at[k])
            slots[at[k]] = put[k]
        both, apart, at = m.guess(key, slot[:n])
        hit = _same(both, s[:, None])
        for k in range(n):
            held[k] = weights.take(at[k])
            weights[at[k]] = m.moved(held[k], hit[k], apart[k])
        share = held[:n] >> _WEIGHT_BITS
        w = (1 << _WEIGHT_BITS) - share[:, 0] - share[:, 1]
        less, own = ((both - s[:, None]) >> 31) & share, hit & share
        start = (w * cum.take(s) + ((less[:, 0] + less[:, 1]) << prior.bits)).astype(np.int64)
        size = (w * freq.take(s) + ((own[:, 0] + own[:, 1]) << prior.bits)).astype(np.int64)
        for k in range(n):
            r = rng >> total
            low += r * start[k]
            rng = r * size[k]
            live = np.flatnonzero(rng < _RENORM)
            while len(live):
                part, wider = low.take(live), rng.take(live) << 16
                emit(live, part)
                low[live], rng[live] = (part & _LOW) << 16, wider
                live = live[wider < _RENORM]
        past[:2] = past[n : n + 2].copy()
    for _ in range(3):
        emit(np.arange(lanes), low)
        low = (low & _LOW) << 16
    return _words(np.concatenate(who), np.concatenate(what), lanes)


def _words(lane: np.ndarray, word: np.ndarray, lanes: int) -> list[bytes]:
    """The words of each lane in the order given, carries added to the words before."""
    word = word[np.argsort(lane.astype(np.uint16) if lanes <= 1 << 16 else lane, kind="stable")]
    out = word & _NONE
    out[:-1] += word[1:] >> 16
    over = np.flatnonzero(out > _NONE)
    while len(over):
        out[over] &= _NONE
        over -= 1
        out[over] += 1
        over = over[out[over] > _NONE]
    raw = memoryview(out.astype("<u2").tobytes())
    edge = 2 * np.append(0, np.cumsum(np.bincount(lane, minlength=lanes)))
    return [bytes(raw[a:b]) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]


def decode(words: list[bytes], prior: Prior, total_ids: int, block: int) -> np.ndarray:
    """The ids of all blocks."""
    lanes = len(words)
    m, cum, freq, symbol = _Model(prior, lanes), prior.cum.astype(np.int32), prior.freq.astype(np.int32), prior.symbol.astype(np.int32)
    slots, weights = m.slots, m.weights
    bits, total = prior.bits, prior.bits + _WEIGHT_BITS
    length = np.array([len(w) // 2 for w in words], np.int64)
    data = np.concatenate([np.frombuffer(b"".join(words), "<u2"), np.zeros(8, np.uint16)])
    pos = np.cumsum(length) - length
    # whole numbers below 2**48 as floats, which hold them and the quotients below 2**26 exactly
    code = data[pos] * 2.0**32 + data[pos + 1] * 2.0**16 + data[pos + 2]
    pos += 3
    rng = np.full(lanes, float(_ALL))
    cols = np.empty((block, lanes), np.uint16)
    before, earlier = np.zeros(lanes, np.int32), np.zeros(lanes, np.int32)
    for t in range(block):
        live = np.flatnonzero(rng < _RENORM)
        while len(live):
            at, wider = pos.take(live), rng.take(live) * 2.0**16
            code[live] = code.take(live) * 2.0**16 + data.take(at, mode="clip")
            pos[live], rng[live] = at + 1, wider
            live = live[wider < _RENORM]
        at, key = m.places(before, earlier)
        both, apart, spot = m.guess(key, slots.take(at))
        one, two = both
        held = weights.take(spot)
        share = held >> _WEIGHT_BITS
        w = (1 << _WEIGHT_BITS) - share[0] - share[1]
        share <<= bits
        r = np.floor(rng * 0.5**total)
        value = np.minimum(code / r, float((1 << total) - 1)).astype(np.int32)
        # where each guess begins and ends in the code range; order 0 lies around them
        begin = w * cum.take(both)
        after = (two - one) >> 31
        begin[0] += after & share[1]
        begin[1] += ~after & share[0]  # guesses that agree give order 1 no share
        end = begin + w * freq.take(both) + share
        value = ~value
        past = (end + value) >> 31
        hit = ((begin + value) >> 31) ^ past
        own, less = hit & share, past & share
        less = less[0] + less[1]
        x = symbol.take((~value - less) // w, mode="clip")
        x ^= (x ^ one) & hit[0]
        x ^= (x ^ two) & hit[1]
        code -= r * (w * cum.take(x) + less)
        rng = r * (w * freq.take(x) + own[0] + own[1])
        cols[t] = x
        weights[spot] = m.moved(held, hit, apart)
        slots[at] = (key << 16) | x
        before, earlier = x, before
    return prior.known.astype(np.uint16)[cols.T.reshape(-1)[:total_ids]].astype(np.uint32)


# ---------------------------------------------------------------- segments


def pack_segment(doc_id: np.ndarray, null: np.ndarray, bounds: np.ndarray, ids: np.ndarray) -> bytes:
    """Header, documents (id, null, ids each), blocks (length, checksum), the prior, code words."""
    if len(ids) and int(ids.max()) >= _NONE:
        raise ValueError(f"ids reach {int(ids.max())}; the format holds ids below {_NONE}")
    block = int(min(BLOCK, max(LEAST_BLOCK, -(-len(ids) // LANES))))
    prior, x = Prior.of(ids)
    words, held = encode(x, prior, block), prior.pack()
    raw = memoryview(ids.astype("<u4").tobytes())
    crcs = [zlib.crc32(raw[i * 4 * block : (i + 1) * 4 * block]) for i in range(len(words))]
    head = struct.pack("<6sIQIQI", MAGIC, len(doc_id), len(ids), block, len(words), len(held))
    table = np.array([[len(w) for w in words], crcs], "<u4").tobytes()
    return b"".join([head, doc_id.astype("<i8").tobytes(), null.astype("u1").tobytes(), np.diff(bounds).astype("<i8").tobytes(), table, held, *words])


def unpack_segment(raw: bytes, only: int | None = None):
    """(doc ids, nulls, bounds, ids); with only, the ids of that block alone."""
    magic, docs, total, block, n, prior_size = struct.unpack_from("<6sIQIQI", raw)
    if magic != MAGIC:
        raise ValueError("not a token-id segment")
    at = struct.calcsize("<6sIQIQI")

    def take(kind, count):
        nonlocal at
        x = np.frombuffer(raw, kind, count, at)
        at += x.nbytes
        return x

    doc_id, null, size = take("<i8", docs), take("u1", docs).astype(bool), take("<i8", docs)
    length, crc = take("<u4", n), take("<u4", n)
    prior = Prior.unpack(raw[at : at + prior_size])
    edge = at + prior_size + np.append(0, np.cumsum(length, dtype=np.int64))
    chosen = range(n) if only is None else [only]
    words = [raw[edge[k] : edge[k + 1]] for k in chosen]
    ids = decode(words, prior, total if only is None else min(block, total - only * block), block)
    view = memoryview(ids.astype("<u4").tobytes())
    for i, k in enumerate(chosen):
        if zlib.crc32(view[i * 4 * block : (i + 1) * 4 * block]) != crc[k]:
            raise ValueError(f"block {k}: checksum differs")
    return doc_id, null, np.append(0, np.cumsum(size)), ids


_FILE = "shard int, seq int, n_ids bigint, segment binary"


def _write(end: int, path: str, drops_space: bool, marks: bool):
    def run(batches):
        from pyspark import TaskContext

        shard, seq = TaskContext.get().partitionId(), 0
        enc = T.encoder(path, drops_space, marks)
        held: list = []
        size = 0

        def flush():
            nonlocal seq, held, size
            doc, null, ids = (np.concatenate(x) for x in zip(*((d, n, i) for d, n, _, i in held), strict=True))
            bounds = np.append(0, np.cumsum(np.concatenate([np.diff(b) for _, _, b, _ in held])))
            row = pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "seq": pa.array([seq], pa.int32()), "n_ids": pa.array([len(ids)], pa.int64()), "segment": pa.array([pack_segment(doc, null, bounds, ids)], pa.binary())})
            seq, held, size = seq + 1, [], 0
            return row

        for b in batches:
            ids, null = C.int64s(b.column(0))
            data, off = C.buffers(b.column(1))
            for i, j in C.steps(off, C.ENCODE_BYTES):
                tok, bounds = T.with_end(*enc.encode(data[off[i] : off[j]], off[i : j + 1] - off[i]), end)
                held.append((ids[i:j], null[i:j], bounds, tok))
                size += len(tok)
                if size >= SEGMENT:
                    yield flush()
        if held:
            yield flush()

    return run


def _read(batches):
    for b in batches:
        for shard, seq, raw in zip(b["shard"].to_pylist(), b["seq"].to_pylist(), b["segment"].to_pylist(), strict=True):
            doc_id, null, bounds, ids = unpack_segment(raw)
            view = memoryview(ids.astype("<u4").tobytes())
            crc = [zlib.crc32(view[x * 4 : y * 4]) for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            n = len(doc_id)
            yield pa.RecordBatch.from_pydict({"shard": pa.array(np.full(n, shard, np.int32)), "seq": pa.array(np.full(n, seq, np.int32)), "doc_id": C.nullable(doc_id, null), "before": bounds[:-1], "n_tokens": np.diff(bounds), "ids_crc32": pa.array(crc, pa.int64())})


def write(docs: DataFrame, end: int = END, path: str = VOCABULARY, drops_space: bool = False, marks: bool = True) -> DataFrame:
    """The token file of all documents in ascending doc_id order, as a table in the shared folder.

    marks: whether a special token's string in a text is that token, as in the library, or ordinary text."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # rows of one id are ordered by text; ranges are cut by its hash too, so one id or null does not go to one task
    place = rows.withColumn("th", F.xxhash64("text"))
    ordered = place.repartitionByRange("doc_id", "th").sortWithinPartitions("doc_id", "th", "text").drop("th")
    return C.materialize(ordered.mapInArrow(_write(end, path, drops_space, marks), _FILE), "token-file", "none")


def index(file: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the decoded file."""
    shards = file.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    shards = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("shard_start"))  # one row per file partition
    segments = file.select("shard", "seq", (F.sum("n_ids").over(Window.partitionBy("shard").orderBy("seq")) - F.col("n_ids")).alias("seg_start"))
    docs = file.select("shard", "seq", "segment").mapInArrow(_read, "shard int, seq int, doc_id bigint, before bigint, n_tokens bigint, ids_crc32 bigint")
    out = docs.join(segments, ["shard", "seq"]).join(shards, "shard")
    return out.select("doc_id", (F.col("shard_start") + F.col("seg_start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
