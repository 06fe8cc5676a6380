"""Line dedup by pairwise alignment.

A common block is worth deleting from `min_words` words on.  The link keys name whole such
blocks: the shortest runs of consecutive lines that reach `min_words` words, forward from each
line and backward.  Each key's earliest document is its owner, and every later document that
holds the key is aligned with that owner: n - 1 pairs for a key of n documents, whatever its
size, never all pairs.  These runs cover every common block, so a document loses every line of a
block that any earlier document holds.

Alignment is patience diff: match lines unique in both, take the longest increasing chain, grow
each match up and down and repeat between the matches.  Runs of consecutive matched lines with
`min_words` words are deleted from the later document; alignment repeats on what is left until
it finds no further block, so moved blocks are found too.  Patience has no anchor where no line
is unique in both; so every line of the later document that lies in a run of at least `min_words`
words which also stands in the earlier one goes as well.  Such a run is covered by shortest runs
of that many words, forward from its lines or backward, so looking these up is exact and linear;
of a passage that is repeated in the later document every copy goes.

Only line hashes travel, and the masks of deleted lines; texts meet the masks in one join.

An owner that very many documents share a key with is copied to `SALT` pairs each, so its pairs are
aligned in many tasks.

Defined cases: the order of documents is (doc_id, hash of text); rows without id or text pass
unchanged and own nothing; rows that repeat id and text are one document and are edited alike;
empty lines are neither matched nor deleted; a document that loses all its non-empty lines
keeps an empty text in `dedup` and goes in `drop_repeats`; an empty table gives no rows; columns
other than doc_id and text (and n_chars) play no part, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

MIN_WORDS = 20
#: Pairs with one owner that are aligned in one task.
SALT = 512

_SEQ = "doc_id bigint, th bigint, h array<bigint>, w array<int>, at array<int>"


def _sequences(batches):
    """Hash, words and place of every non-empty line of a document."""
    for b in batches:
        data, off = C.buffers(b.column(2))
        for i, j in C.steps(off):
            part, o = data[off[i] : off[j]], off[i : j + 1] - off[i]
            s, e, first = C.spans(part, o, C.LINE)
            h = C.hash_spans(part, s, e, 5)
            ws, _, _ = C.spans(part, o, C.GRAPHIC)
            words = np.searchsorted(ws, e) - np.searchsorted(ws, s)
            newline = np.flatnonzero(part == 10)
            doc = np.repeat(np.arange(j - i), np.diff(first))
            at = np.searchsorted(newline, s) - np.searchsorted(newline, o[doc])
            keep = words > 0
            bounds = pa.array(np.append(0, np.cumsum(np.bincount(doc[keep], minlength=j - i))).astype(np.int32))
            cols = [pa.ListArray.from_arrays(bounds, pa.array(x[keep])) for x in (h.view(np.int64), words.astype(np.int32), at.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([b.column(0)[i:j], b.column(1)[i:j], *cols], names=["doc_id", "th", "h", "w", "at"])


def _run_hashes(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the sequences h[start:end]; equal sequences have equal hashes."""
    _, up, down = C._tables(len(h) + 1, 5)
    total = np.append(np.uint64(0), np.cumsum(h * up[: len(h)]))
    return C.mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def _keys(min_words: int):
    """Distinct hashes of the shortest runs of min_words words of each document, forward and backward."""

    def run(batches):
        for b in batches:
            h, w = b.column(2), b.column(3)
            off = np.asarray(h.offsets).astype(np.int64)
            off, h, w = off - off[0], np.asarray(h.flatten()).view(np.uint64), np.asarray(w.flatten()).astype(np.int64)
            for i, j in C.steps(off, C.STEP_BYTES // 8):
                x, y = off[i], off[j]
                doc = np.repeat(np.arange(i, j), np.diff(off[i : j + 1]))
                total = np.append(0, np.cumsum(w[x:y]))
                at = np.arange(y - x)
                end = np.searchsorted(total, total[:-1] + min_words)
                start = np.searchsorted(total, total[1:] - min_words, "right") - 1
                ahead, back = end <= off[doc + 1] - x, start >= off[doc] - x
                s, e = np.append(at[ahead], start[back]), np.append(end[ahead], at[back] + 1)
                key, doc = _run_hashes(h[x:y], s, e), np.append(doc[ahead], doc[back])
                order = np.lexsort((key, doc))
                key, doc = key[order], doc[order]
                new = np.append(True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])) if len(key) else np.zeros(0, bool)
                of = pa.array(doc[new])
                yield pa.RecordBatch.from_arrays([b.column(0).take(of), b.column(1).take(of), pa.array(key[new].view(np.int64))], names=["doc_id", "th", "key"])

    return run


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Matched (index in a, index in b), ascending in both."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i0, i1, j0, j1 = todo.pop()
        while i0 < i1 and j0 < j1 and a[i0] == b[j0]:
            out.append((i0, j0))
            i0, j0 = i0 + 1, j0 + 1
        while i0 < i1 and j0 < j1 and a[i1 - 1] == b[j1 - 1]:
            i1, j1 = i1 - 1, j1 - 1
            out.append((i1, j1))
        if i0 == i1 or j0 == j1:
            continue
        once: dict = {}
        for k in range(i0, i1):
            once[a[k]] = -1 if a[k] in once else k
        there: dict = {}
        for k in range(j0, j1):
            if b[k] in once:
                there[b[k]] = -1 if b[k] in there else k
        both = [(once[x], j) for x, j in there.items() if j >= 0 and once[x] >= 0]  # ascending in b
        tails: list = []
        ends: list = []
        back: list = []
        for n, (i, _) in enumerate(both):
            k = bisect_left(tails, i)
            back.append(ends[k - 1] if k else -1)
            tails[k : k + 1], ends[k : k + 1] = [i], [n]
        chain, n = [], ends[-1] if ends else -1
        while n >= 0:
            chain.append(both[n])
            n = back[n]
        if not chain:
            continue
        pi, pj = i0, j0
        for i, j in reversed(chain):
            todo.append((pi, i, pj, j))
            out.append((i, j))
            pi, pj = i + 1, j + 1
        todo.append((pi, i1, pj, j1))
    return sorted(out)


def runs(words: list, min_words: int) -> set[tuple[int, int]]:
    """(start, end) of the shortest runs of min_words words, forward and backward from each line."""
    total = [0, *accumulate(words)]
    n = len(words)
    out = set()
    for i in range(n):
        end = bisect_left(total, total[i] + min_words)
        if end <= n:
            out.add((i, end))
        start = bisect_right(total, total[i + 1] - min_words) - 1
        if start >= 0:
            out.add((start, i + 1))
    return out


def unanchored(a: list, b: list, words: list, min_words: int, gone: list[int]) -> list[int]:
    """Indices in b, besides gone, of all common blocks of at least min_words words."""
    holds = set(a)
    ours = [(i, j) for i, j in runs(words, min_words) if b[i] in holds and b[j - 1] in holds]
    done = set(gone)
    ours = [(i, j) for i, j in ours if not done.issuperset(range(i, j))]
    places: dict = {}
    if ours:
        first = {b[i] for i, _ in ours}
        for k, x in enumerate(a):
            if x in first:
                places.setdefault(x, []).append(k)
    theirs: dict = {}
    for i, j in ours:
        if j - i not in theirs:
            theirs[j - i] = {tuple(a[k : k + j - i]) for ks in places.values() for k in ks}
        if tuple(b[i:j]) in theirs[j - i]:
            done.update(range(i, j))
    return sorted(done)


def common_blocks(a: list, b: list, words: list, min_words: int) -> list[int]:
    """Indices in b of common blocks of at least min_words words (words: of b's lines)."""
    ia, ib, gone = list(range(len(a))), list(range(len(b))), []
    while True:
        found, block = [], []
        for i, j in [*patience([a[k] for k in ia], [b[k] for k in ib]), (-1, -1)]:
            i, j = (ia[i], ib[j]) if i >= 0 else (-9, -9)
            if block and (i, j) != (block[-1][0] + 1, block[-1][1] + 1):
                if sum(words[y] for _, y in block) >= min_words:
                    found += block
                block = []
            block.append((i, j))
        if not found:
            return unanchored(a, b, words, min_words, gone)
        gone += [j for _, j in found]
        xa, xb = {i for i, _ in found}, {j for _, j in found}
        ia, ib = [k for k in ia if k not in xa], [k for k in ib if k not in xb]


def _align(min_words: int):
    def run(batches):
        for b in batches:
            rows = b.to_pydict()
            gone = []
            for h, w, at, oh in zip(rows["h"], rows["w"], rows["at"], rows["oh"], strict=True):
                gone.append([at[k] for k in common_blocks(oh, h, w, min_words)])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(gone, pa.list_(pa.int32()))], names=["doc_id", "th", "gone"])

    return run


def _masks(batches):
    for b in batches:
        mask = []
        for gone in b.column(2).to_pylist():
            m = np.zeros(max(gone) + 1, bool)
            m[gone] = True
            mask.append(m)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(mask, pa.list_(pa.bool_()))], names=["doc_id", "th", "mask"])


def repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, th (xxhash64 of text), mask: which lines of the document go; only documents that lose any."""
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("th"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    seq = C.materialize(base.mapInArrow(_sequences, _SEQ), "lines", batch=C.BATCH)
    doc = F.struct("doc_id", "th")
    held = seq.select("doc_id", "th", "h", "w").mapInArrow(_keys(min_words), "doc_id bigint, th bigint, key bigint")
    owners = held.groupBy("key").agg(F.min(doc).alias("owner"), F.max(doc).alias("last")).where("owner != last").select("key", "owner")
    pairs = held.join(owners, "key").where(F.col("owner") != doc).select("doc_id", "th", F.col("owner.doc_id").alias("oid"), F.col("owner.th").alias("oth")).distinct()
    pairs = C.materialize(pairs, "pairs", batch=C.BATCH)
    once = seq.dropDuplicates(["doc_id", "th"])
    theirs = once.select(F.col("doc_id").alias("oid"), F.col("th").alias("oth"), F.col("h").alias("oh"))
    # owners are copied as often as their pairs need tasks, so a line that a third of all documents share is no hot key
    owned = pairs.groupBy("oid", "oth").agg(F.ceil(F.count("*") / SALT).cast("int").alias("parts"))
    copies = theirs.join(owned, ["oid", "oth"]).withColumn("part", F.explode(F.expr("sequence(0, parts - 1)"))).drop("parts")
    dealt = pairs.join(owned, ["oid", "oth"]).withColumn("part", F.expr("cast(pmod(xxhash64(doc_id, th), parts) as int)")).drop("parts")
    both = dealt.join(copies, ["oid", "oth", "part"]).join(once, ["doc_id", "th"]).select("doc_id", "th", "h", "w", "at", "oh")
    gone = both.mapInArrow(_align(min_words), "doc_id bigint, th bigint, gone array<int>").where(F.size("gone") > 0)
    gone = gone.groupBy("doc_id", "th").agg(F.array_distinct(F.flatten(F.collect_set("gone"))).alias("gone"))
    return C.materialize(gone.mapInArrow(_masks, "doc_id bigint, th bigint, mask array<boolean>"), "masks", batch=C.BATCH)


def _edited(docs: DataFrame, min_words: int):
    """docs with columns c0, c1, ..., the masks of deleted lines and what is left of the text; the text's column."""
    masks = repeats(docs, min_words)
    flat = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    id_, text = (F.col(f"c{docs.columns.index(x)}") for x in ("doc_id", "text"))
    # texts are always shuffled to the masks: their number follows the repeats in the data, so they are never broadcast
    near = (id_.cast("bigint") == masks["doc_id"]) & (F.xxhash64(text.cast("string")) == masks["th"])
    text = text.cast("string")
    kept = F.array_join(F.filter(F.split(text, "\n", -1), lambda x, i: ~F.coalesce(F.get("mask", i), F.lit(False))), "\n")
    out = flat.hint("merge").join(masks.hint("merge"), near, "left")
    return out.withColumn("left", F.when(F.col("mask").isNull(), text).otherwise(kept)), text


def dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, text without the deleted lines, n_lines and n_deleted of every row; emptied: nothing is left of a text that lost lines."""
    out, text = _edited(docs, min_words)
    lines = F.coalesce(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("bigint")
    gone = F.coalesce(F.size(F.filter("mask", lambda x: x)), F.lit(0)).cast("bigint")
    emptied = F.col("mask").isNotNull() & _blank(F.col("left"))
    return out.select(F.col(f"c{docs.columns.index('doc_id')}").alias("doc_id"), F.col("left").alias("text"), lines.alias("n_lines"), gone.alias("n_deleted"), emptied.alias("emptied"))


def _blank(text):
    return F.trim(F.regexp_replace(text, "\n", "")) == ""


def drop_repeats(spark: SparkSession, docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents with repeated blocks deleted, with all their columns, whatever these are called; those left empty by it go.

    n_chars, where there is one, is set anew for edited texts.  Rows without id or text stay as they are."""
    edited = F.col("mask").isNotNull()
    out = _edited(docs, min_words)[0].where(~(edited & _blank(F.col("left"))))

    def column(i, name):
        if name == "text":
            return F.col("left").cast(docs.schema[i].dataType).alias(name)
        if name == "n_chars":
            return F.when(edited, F.length("left")).otherwise(F.col(f"c{i}")).cast(docs.schema[i].dataType).alias(name)
        return F.col(f"c{i}").alias(name)

    return out.select(*(column(i, c) for i, c in enumerate(docs.columns)))
