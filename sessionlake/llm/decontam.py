"""Benchmark decontamination over a distributed positional inverted index.

`build_index` stores the postings of every training word: a segment is a block of whole
documents with its sorted term table, and per term the ascending word positions (compressed
sparse rows), written as Parquet in the shared folder.  Segments are document-partitioned, so
building shuffles nothing and a hot term or source only makes its own postings longer.

`search` sends blocks of test phrases to the segments.  Global collection frequencies of the
test terms order each phrase from its rarest term; candidate starts come from that term's
postings and are intersected with the offset-adjusted postings of the next rarest, and so on.
With slop > 0 it returns proximity matches instead: places of the rarest term with every other
term within (phrase length + slop) words, in any order.

Terms are 64-bit hashes: a false hit needs a place that matches in all but one word and whose
odd word collides, odds of 2**-64 a place.

Defined cases: null text has no words; null ids of documents are kept; test items with null id
or no words match nothing; repeated rows are separate documents; an empty benchmark or corpus
gives rows with no hits, or no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Words of a segment (a longer document has its own) and of a block of test phrases that is sent to the segments at once.
SEGMENT_WORDS, BLOCK_WORDS = 1 << 20, 1 << 21

SEGMENT = "docs binary, nulls binary, bounds binary, terms binary, rows binary, places binary"
_SEGMENT = pa.schema([(x.split()[0], pa.binary()) for x in SEGMENT.split(", ")])
HITS = "doc_id bigint, segment bigint, slot bigint, n_words bigint, hits array<bigint>, items array<string>"
_HITS = pa.schema([("doc_id", pa.int64()), ("segment", pa.int64()), ("slot", pa.int64()), ("n_words", pa.int64()), ("hits", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])


def _segments(batches):
    for b in batches:
        ids, null = C.int64s(b.column(0))
        data, off = C.buffers(b.column(1))
        for i, j in C.steps(off, 6 * SEGMENT_WORDS):
            words, bounds = C.word_hashes(data[off[i] : off[j]], off[i : j + 1] - off[i], C.ALNUM)
            order = np.argsort(words, kind="stable")
            terms, rows = np.unique(words[order], return_index=True)
            made = [ids[i:j], null[i:j], bounds, terms, np.append(rows, len(words)), order.astype(np.int32 if len(words) < 2**31 else np.int64)]
            yield pa.RecordBatch.from_pydict({f.name: [C.blob(x)] for f, x in zip(_SEGMENT, made, strict=True)}, schema=_SEGMENT)


def build_index(docs: DataFrame) -> DataFrame:
    """One row per segment, in the shared folder."""
    return C.materialize(docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(_segments, SEGMENT), "postings")


class Phrases:
    """A block of test phrases as term hashes: windows of `n` words of each item, or the whole shorter item."""

    def __init__(self, items: list[tuple[str, str]], n: int):
        texts = pa.array([t for _, t in items], pa.large_string())
        words, bounds = C.word_hashes(*C.buffers(texts), C.ALNUM)
        size = np.diff(bounds)
        count = np.where(size == 0, 0, np.maximum(size - n + 1, 1))
        self.names = np.array([i for i, _ in items], object)
        self.item = np.repeat(np.arange(len(size)), count)
        start = C.ragged(bounds[:-1], count)
        self.length = np.minimum(size, n)[self.item]
        self.terms, code = np.unique(words, return_inverse=True)
        at = start[:, None] + np.arange(n)
        self.used = np.arange(n) < self.length[:, None]
        self.codes = code[np.minimum(at, max(len(words) - 1, 0))] if len(words) else np.zeros((0, n), np.int64)
        # the same phrase of several items is searched once
        key = np.where(self.used, self.codes, -1)
        _, one, self.phrase = np.unique(key, axis=0, return_index=True, return_inverse=True) if len(key) else (0, np.zeros(0, int), np.zeros(0, int))
        self.phrase, self.codes, self.used = self.phrase.reshape(-1), self.codes[one], self.used[one]

    def order(self, frequency: np.ndarray) -> None:
        """Offsets of each phrase from its rarest term to its commonest."""
        rank = np.where(self.used, frequency[self.codes] if len(frequency) else 0, np.iinfo(np.int64).max)
        self.offsets = np.argsort(rank, axis=1, kind="stable")


def _load(row) -> dict:
    kinds = {"docs": np.int64, "nulls": bool, "bounds": np.int64, "terms": np.uint64, "rows": np.int64}
    out = {k: np.frombuffer(row[k], t) for k, t in kinds.items()}
    words = int(out["bounds"][-1]) if len(out["bounds"]) else 0
    out["places"] = np.frombuffer(row["places"], np.int32 if words < 2**31 else np.int64)
    return out


def match(seg: dict, ph: Phrases, slop: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(phrase, word position of its start) of every match in a segment; with slop, the rarest term's position."""
    terms, rows, places = seg["terms"], seg["rows"], seg["places"]
    none = np.zeros(0, np.int64)
    if not len(terms) or not len(ph.codes):
        return none, none
    at = np.searchsorted(terms, ph.terms)
    at = np.where((at < len(terms)) & (terms[np.minimum(at, len(terms) - 1)] == ph.terms), at, -1)
    local = at[ph.codes]
    live = np.flatnonzero(((local >= 0) | ~ph.used).all(1))
    if not len(live):
        return none, none
    keys = np.repeat(np.arange(len(terms)), np.diff(rows)) * np.int64(2**40) + places  # ascending: (term, position)
    first = local[live, ph.offsets[live, 0]]
    size = rows[first + 1] - rows[first]
    phrase = np.repeat(live, size)
    start = places[C.ragged(rows[first], size)].astype(np.int64)
    lead = ph.offsets[phrase, 0]
    doc = np.searchsorted(seg["bounds"], start, "right") - 1
    lo, hi = seg["bounds"][doc], seg["bounds"][doc + 1]
    n = ph.used.sum(1)
    if not slop:
        start = start - lead
        ok = (start >= lo) & (start + n[phrase] <= hi)
        phrase, start = phrase[ok], start[ok]
    for step in range(1, ph.codes.shape[1]):
        if not len(phrase):
            break
        off = ph.offsets[phrase, step]
        skip = step >= n[phrase]
        term = np.where(skip, 0, local[phrase, off])
        if slop:
            reach = n[phrase] + slop
            want = term * np.int64(2**40) + np.maximum(start - reach, lo)
            hit = np.searchsorted(keys, want)
            ok = skip | ((hit < len(keys)) & (keys[np.minimum(hit, len(keys) - 1)] <= term * np.int64(2**40) + np.minimum(start + reach, hi - 1)))
            lo, hi = lo[ok], hi[ok]
        else:
            want = term * np.int64(2**40) + start + off
            hit = np.searchsorted(keys, want)
            ok = skip | ((hit < len(keys)) & (keys[np.minimum(hit, len(keys) - 1)] == want))
        phrase, start = phrase[ok], start[ok]
    return phrase, start


def _hits(ph: Phrases, slop: int):
    """Per document: hit word positions within it, and the items found."""
    n = ph.used.sum(1)
    by_phrase = np.argsort(ph.phrase, kind="stable")
    bounds = np.searchsorted(ph.phrase[by_phrase], np.arange(len(ph.codes) + 1))

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                seg = _load(row)
                docs, nulls, edge = seg["docs"], seg["nulls"], seg["bounds"]
                phrase, start = match(seg, ph, slop)
                doc = np.searchsorted(edge, start, "right") - 1
                size = np.ones(len(start), np.int64) if slop else n[phrase]
                place = np.unique(C.ragged(start, size))
                where = np.searchsorted(edge, place, "right") - 1
                pair = np.unique(np.stack([np.repeat(doc, np.diff(bounds)[phrase]), ph.item[by_phrase[C.ragged(bounds[phrase], np.diff(bounds)[phrase])]]]), axis=1) if len(phrase) else np.zeros((2, 0), np.int64)
                m = len(docs)
                hits = pa.ListArray.from_arrays(np.searchsorted(where, np.arange(m + 1)).astype(np.int32), pa.array(place - edge[where]))
                items = pa.ListArray.from_arrays(np.searchsorted(pair[0], np.arange(m + 1)).astype(np.int32), pa.array(ph.names[pair[1]], pa.string()))
                yield pa.RecordBatch.from_arrays([C.nullable(docs, nulls), pa.array(np.full(m, row["segment"])), pa.array(np.arange(m)), pa.array(np.diff(edge)), hits, items], schema=_HITS)

    return run


def _frequencies(ph: Phrases):
    def run(batches):
        total = np.zeros(len(ph.terms), np.int64)
        for b in batches:
            for row in b.to_pylist():
                terms, rows = np.frombuffer(row["terms"], np.uint64), np.frombuffer(row["rows"], np.int64)
                at = np.searchsorted(terms, ph.terms)
                ok = np.flatnonzero(at < len(terms))
                ok = ok[terms[at[ok]] == ph.terms[ok]]
                total[ok] += np.diff(rows)[at[ok]]
        term = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"term": term, "n": total[term]})

    return run


def blocks(benchmark: DataFrame, words: int = BLOCK_WORDS):
    """The test items in blocks of a bounded number of characters; a longer item is a block of its own."""
    block, size = [], 0
    rows = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("i"), F.col("text").cast("string").alias("t"))
    for r in rows.toLocalIterator():
        if block and size + len(r.t) > 6 * words:
            yield block
            block, size = [], 0
        block.append((r.i, r.t))
        size += len(r.t)
    yield block


def search(index: DataFrame, benchmark: DataFrame, n: int = 10, slop: int = 0) -> DataFrame:
    """One row per indexed document: doc_id, n_words, hits (word positions), items (ids of the items found).

    slop 0 finds exact phrases of n words; slop s finds their words near each other."""
    index = index.withColumn("segment", F.monotonically_increasing_id())
    found = None
    for block in blocks(benchmark):
        ph = Phrases(block, n)
        sums = index.select("terms", "rows").mapInArrow(_frequencies(ph), "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
        frequency = np.zeros(len(ph.terms), np.int64)
        for r in sums.collect():  # at most the terms of one block
            frequency[r.term] = r.n
        ph.order(frequency)
        part = index.mapInArrow(_hits(ph, slop), HITS)
        if found is None:
            found = part
        else:  # each further block may add hits to a document
            key = ["segment", "slot", "doc_id", "n_words"]
            found = C.materialize(found.unionByName(part).groupBy(key).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("hits")))).alias("hits"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items")).select(part.columns), "hits")
    return found.drop("segment", "slot")


def contamination(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every document."""
    found = search(build_index(docs), benchmark, n)
    return found.select(
        "doc_id",
        "n_words",
        F.size("hits").cast("bigint").alias("n_hit"),
        F.size(F.array_distinct("items")).cast("bigint").alias("n_items"),
        C.join_hash(F.array_join(F.array_sort(F.array_distinct("items")), ",")).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def items_digest(items) -> str:
    return hashlib.sha256(",".join(sorted(set(items))).encode()).hexdigest()


def drop_contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """The documents that hold no window of a benchmark item, with all their columns, whatever these are called.

    Rows are judged by (doc_id, text), through a 64-bit hash of both: equal rows share a verdict, a row with another
    text under the same id does not.  Null and empty texts stay; an empty benchmark drops nothing."""
    flat = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    id_, text = (F.col(f"c{docs.columns.index(x)}") for x in ("doc_id", "text"))
    keyed = flat.withColumn("row", F.xxhash64(id_.cast("bigint"), id_.isNull(), text.cast("string")))
    found = search(build_index(keyed.select(F.col("row").alias("doc_id"), text.alias("text"))), benchmark, n)
    bad = found.where(F.size("hits") > 0).select(F.col("doc_id").alias("row")).distinct()
    return keyed.join(bad, "row", "left_anti").select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)))
