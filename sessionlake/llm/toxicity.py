"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents (P) and unlabelled text (U) train a linear classifier under the
class-prior-corrected risk  pi E_P[l(f)] + max(0, E_U[l(-f)] - pi E_P[l(-f)]);  when the
corrected negative part goes below zero its gradient is reversed, which keeps the estimate
non-negative.  The prior is the share of toxic rows among the labelled training rows, or less where
the most significant keys are rarer in U than that share of P explains.

Inputs of a score are the text alone: the presence of whole words, of beginnings of words (5 to 8
bytes, so inflected forms of a rare stem count together) and of 4-byte pieces of words, and whether
a text is dense with them (twice at least, and once in `DENSE` words); the at most `features` keys
of these significantly more frequent in P than in U by documents, and LIFT times as frequent as
in the negatives, by the prior-corrected frequency of U.  These frequencies in U are those of all
documents of the training folds: the keys that occur in `AGREE` positives or more, at most
`CANDIDATES`, are counted in one pass over them.

The gradient steps use at most `positives` + `unlabelled` documents, the ones with the smallest id
hashes in the training folds (documented bounds); the model (at most `features` keys) is what the
executors get.  Every whole text is scored; nothing is shuffled for that.

Defined cases: null or empty texts score as a text without features; a null toxic label is no
label; a document labelled twice is toxic if any label says so; without confirmed examples the
score is the prior.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

FOLDS, HELD, THRESHOLD = 4, 2, 0.3
POSITIVES, UNLABELLED, FEATURES, PIECE = 4096, 12288, 2048, 4
#: Bytes of a word's beginnings; positives that must agree on a key, and keys that are counted in all documents at most.
BEGINNINGS, AGREE, CANDIDATES = (5, 6, 7, 8), 3, 1 << 18
#: Words of a text for each occurrence of a key that the text is dense with.
DENSE = 200
#: The most significant keys, whose frequencies in U and P bound the prior in U.
TELLING = 32
#: Standard deviations by which a feature's document frequency in P must exceed that in U.
SIGNIFICANT = 6.0
#: Times the frequency in the others at least, which is that in U less the prior's share of that in P.
LIFT = 30.0
_BLOOM = 20
#: The bit that is set in plain keys and clear in those of dense texts.
DENSELY = np.uint64(1)


@dataclass
class Model:
    keys: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def __post_init__(self):
        self.order = np.argsort(self.keys)
        self.sorted = self.keys[self.order]

    def score(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        out = np.full(len(off) - 1, float(self.bias))
        for i, j in C.steps(off):
            feature, doc = self.present(data[off[i] : off[j]], off[i : j + 1] - off[i])
            out[i:j] += np.bincount(doc, self.weights[feature], j - i)
        return 1 / (1 + np.exp(-np.clip(out, -60, 60)))

    @cached_property
    def lookup(self):
        return Lookup(self.sorted)

    def present(self, data, off):
        """Distinct (feature, document) pairs."""
        key, doc = self.lookup.held(data, off)
        return self.order[key], doc


class Lookup:
    """Ascending keys, to be found in texts.

    A key's upper form, one bit flipped, stands for a document that is dense with it."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.plain = keys, np.unique(keys | DENSELY)
        self.bloom = np.zeros(1 << _BLOOM, bool)
        self.bloom[self.plain >> np.uint64(64 - _BLOOM)] = True

    def held(self, data, off):
        """(place in the keys, document) of every key that a document holds, by documents."""
        keys, plain = self.keys, self.plain
        if not len(keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        found, doc, words = features(data, off)
        hit = np.flatnonzero(self.bloom[found >> np.uint64(64 - _BLOOM)])
        found, doc = found[hit], doc[hit]
        at = np.minimum(np.searchsorted(plain, found), len(plain) - 1)
        ok = plain[at] == found
        pair, n = np.unique(doc[ok] * np.int64(len(plain)) + at[ok], return_counts=True)
        doc, found = pair // len(plain), plain[pair % len(plain)]
        dense = dense_with(n, words[doc])
        found, doc = np.append(found, found[dense] ^ DENSELY), np.append(doc, doc[dense])
        at = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
        ok = np.flatnonzero(keys[at] == found)
        ok = ok[np.argsort(doc[ok], kind="stable")]
        return at[ok], doc[ok]


def dense_with(n: np.ndarray, words: np.ndarray) -> np.ndarray:
    return (n >= 2) & (n * DENSE >= words)


def features(data: np.ndarray, off: np.ndarray):
    """(key, document) of every word, its beginnings and every PIECE-byte piece inside it, lower-cased; words of each document."""
    low = C.LOWER[data]
    start, end, first = C.spans(low, off, C.ALNUM)
    words = C.hash_spans(low, start, end, 3)
    size = np.maximum(end - start - PIECE + 1, 0)
    at = C.ragged(start, size)
    packed = np.zeros(len(at), np.uint64)
    for k in range(PIECE):
        packed = (packed << np.uint64(8)) | low[at + k]
    doc = np.repeat(np.arange(len(off) - 1), np.diff(first))
    keys, docs = [words, C.mix(packed + np.uint64(1 << 40))], [doc, np.repeat(doc, size)]
    for n in BEGINNINGS:
        long = np.flatnonzero(end - start > n)
        keys.append(C.hash_spans(low, start[long], start[long] + n, 20 + n))
        docs.append(doc[long])
    return np.concatenate(keys) | DENSELY, np.concatenate(docs), np.diff(first)


def _agreed(batches):
    """(key, documents) of all keys, plain and dense."""
    for b in batches:
        data, off = C.buffers(b.column(0))
        for i, j in C.steps(off):
            keys, doc, words = features(data[off[i] : off[j]], off[i : j + 1] - off[i])
            key, at = np.unique(keys, return_inverse=True)
            pair, n = np.unique(doc * np.int64(len(key) + 1) + at, return_counts=True)
            doc, at = pair // (len(key) + 1), pair % (len(key) + 1)
            dense = np.bincount(at[dense_with(n, words[doc])], minlength=len(key))
            yield pa.RecordBatch.from_pydict({"key": np.concatenate([key, key ^ DENSELY]).view(np.int64), "n": np.concatenate([np.bincount(at, minlength=len(key)), dense])})


def _frequencies(candidates: np.ndarray):
    """(candidate, documents that hold it): one row for each in a task."""

    def run(batches):
        total, lookup = np.zeros(len(candidates), np.int64), Lookup(candidates)
        for b in batches:
            data, off = C.buffers(b.column(0))
            for i, j in C.steps(off):
                total += np.bincount(lookup.held(data[off[i] : off[j]], off[i : j + 1] - off[i])[0], minlength=len(candidates))
        if total.any():
            yield pa.RecordBatch.from_pydict({"key": candidates[total > 0].view(np.int64), "n": total[total > 0]})
        C.trim()

    return run


def _rows(model: Model):
    def run(batches):
        for b in batches:
            data, off = C.buffers(b.column(1))
            for i, j in C.steps(off):
                feature, doc = model.present(data[off[i] : off[j]], off[i : j + 1] - off[i])
                bounds = np.searchsorted(doc, np.arange(j - i + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0)[i:j].cast(pa.int32()), pa.ListArray.from_arrays(bounds, pa.array(feature.astype(np.int32)))], names=["kind", "x"])
        C.trim()

    return run


def nnpu(p: list[np.ndarray], u: list[np.ndarray], n: int, prior: float, epochs: int = 400, rate: float = 0.05, decay: float = 1e-4, slack: float = 0.0) -> tuple[np.ndarray, float]:
    """Full-batch Adam on the non-negative risk, logistic loss; p, u: feature indices of each document."""
    flat = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (p, u)]
    row = [np.repeat(np.arange(len(x)), [len(i) for i in x]) for x in (p, u)]
    w, b = np.zeros(n), np.log(prior / (1 - prior))
    m, v = np.zeros(n + 1), np.zeros(n + 1)

    def f(k, x):
        return b + np.bincount(row[k], w[flat[k]], len(x)) if len(x) else np.zeros(0)

    def back(k, x, g):
        return np.append(np.bincount(flat[k], g[row[k]], n) if len(flat[k]) else np.zeros(n), g.sum()) / max(1, len(x))

    sig = lambda x: 1 / (1 + np.exp(-np.clip(x, -60, 60)))
    for t in range(1, epochs + 1):
        fp, fu = f(0, p), f(1, u)
        negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        grad_neg = back(1, u, sig(fu)) - prior * back(0, p, sig(fp))
        grad_pos = prior * back(0, p, sig(fp) - 1)
        g = grad_pos + grad_neg if negative >= -slack else -grad_neg
        g[:n] += decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:n], b - step[n]
    return w, float(b)


def fit(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED, features: int = FEATURES) -> Model:
    """A model learnt from the training folds of docs and labels."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where(C.fold("doc_id", FOLDS) != HELD)
    marks = labels.where("toxic is not null and doc_id is not null").where(C.fold("doc_id", FOLDS) != HELD).groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    share = marks.agg(F.avg("toxic")).first()[0]
    prior = float(min(max(share if share is not None else 0.01, 0.001), 0.9))
    order = F.xxhash64("doc_id", F.lit("sample"))
    chosen = marks.where("toxic = 1").orderBy(order, "doc_id").limit(positives).select("doc_id", F.lit(1).alias("kind"))
    rest = docs.where("doc_id is not null").select("doc_id").orderBy(order, "doc_id").limit(unlabelled).select("doc_id", F.lit(0).alias("kind"))
    ids = C.materialize(chosen.unionByName(rest).distinct(), "sample")
    sample = docs.join(F.broadcast(ids), "doc_id").select("kind", "text")  # ids: positives + unlabelled rows at most
    sample = C.materialize(sample, "sample-text", batch=C.BATCH)
    size = {r.kind: r.n for r in sample.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    p, u = max(size.get(1, 0), 1), max(docs.count(), 1)
    count = F.sum("n").alias("n")
    agreed = sample.where("kind = 1").select("text").mapInArrow(_agreed, "key bigint, n bigint").groupBy("key").agg(count)
    agreed = C.materialize(agreed.where(F.col("n") >= AGREE), "agreed", batch=C.BATCH)
    ours = agreed.orderBy(F.desc("n"), "key").limit(CANDIDATES).toArrow()
    keys, own = np.asarray(ours["key"]).view(np.uint64), np.asarray(ours["n"]).astype(float)
    order = np.argsort(keys)
    keys, own = keys[order], own[order]
    counts = C.materialize(docs.select("text").mapInArrow(_frequencies(keys), "key bigint, n bigint").groupBy("key").agg(count), "frequencies", batch=C.BATCH)
    seen = counts.toArrow()  # at most CANDIDATES rows
    C.remove(agreed, counts)
    everywhere = np.zeros(len(keys))
    everywhere[np.searchsorted(keys, np.asarray(seen["key"]).view(np.uint64))] = np.asarray(seen["n"])
    r = (everywhere + 1) / (u + 2)
    z = (own - p * r) / np.sqrt(p * r * (1 - r))
    # r holds prior * (P's rate) of toxic documents; the rest is the negatives'
    others = (r - prior * own / p) / (1 - prior)
    good = np.flatnonzero((z >= SIGNIFICANT) & (own >= LIFT * p * others))
    top = keys[good[np.lexsort((keys[good], -z[good]))][:features]]
    model = Model(top, np.zeros(len(top)), np.log(prior / (1 - prior)), prior)
    if not size.get(1) or not size.get(0) or not len(top):
        return model
    rows = sample.mapInArrow(_rows(model), "kind int, x array<int>").toArrow()
    kind = np.asarray(rows["kind"])
    x = [np.asarray(i.values, np.int64) for i in rows["x"]]
    # U may hold fewer toxic documents than the labelled rows: keys that others hardly use tell its prior
    tell = np.searchsorted(keys, top[:TELLING])
    prior = min(prior, max(0.001, r[tell].sum() / (own[tell] / p).sum()))
    w, b = nnpu([x[i] for i in np.flatnonzero(kind == 1)], [x[i] for i in np.flatnonzero(kind == 0)], len(top), prior, decay=0.05 / p)
    return Model(model.keys, w, b, prior)


def _scores(model: Model):
    def run(batches):
        for b in batches:
            data, off = C.buffers(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(model.score(data, off))], names=["doc_id", "held_out", "score"])

    return run


def score(model: Model, docs: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).select("doc_id", "text", (C.fold("doc_id", FOLDS) == HELD).alias("held_out"))
    out = rows.mapInArrow(_scores(model), "doc_id bigint, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def drop_toxic(spark: SparkSession, docs: DataFrame, labels: DataFrame, all_docs: DataFrame | None = None) -> DataFrame:
    """The documents scored below the threshold, with all their columns, whatever these are called; the model is fitted on all_docs (docs by default).

    Null and empty texts are judged as texts without features, repeated rows alike; without confirmed labels the score is the prior."""
    model = fit(docs if all_docs is None else all_docs, labels)
    width = len(docs.columns)
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            data, off = C.buffers(b.column(at))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(width)), pa.array(model.score(data, off))], names=[*(f"c{i}" for i in range(width)), "score"])
        C.trim()

    schema = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema)) + ", score double"
    out = docs.toDF(*(f"c{i}" for i in range(width))).mapInArrow(run, schema)
    return out.where(F.col("score") < THRESHOLD).select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)))
