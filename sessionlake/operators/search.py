"""Ranked full-text recall: folded tokens, BM25 with floored idf, expressions of AND, OR, NOT, parentheses and phrases, policy before limit."""

from __future__ import annotations

import math
import re
import unicodedata
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

K1, B, FLOOR = 1.2, 0.75, 1e-6

#: Latin letters whose canonical decomposition begins with an ASCII letter, and that letter.
_FOLDS = {c: base for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]) if (base := unicodedata.normalize("NFD", c.lower())[0]).isascii() and base.isalpha()}
_FROM, _TO = "".join(_FOLDS), "".join(_FOLDS.values())
_TOKEN = r"[\p{L}\p{N}]+"


def tokens(content: Column) -> Column:
    """Runs of letters and digits, without case and diacritics."""
    ascii_only = F.octet_length(content) == F.length(content)
    folded = F.translate(F.regexp_replace(F.lower(content), r"\p{Mn}+", ""), _FROM, _TO)
    # ASCII texts need no folding and a plainer class
    return F.regexp_extract_all(F.when(ascii_only, F.lower(content)).otherwise(folded), F.when(ascii_only, F.lit("([a-z0-9]+)")).otherwise(F.lit(f"({_TOKEN})")), F.lit(1))


def words(text: str) -> list[str]:
    """The tokens of a text on the driver."""
    return [w for w, _, _ in _spans(text)]


def _spans(text: str) -> list[tuple[str, int, int]]:
    out, start, word = [], -1, ""
    for i, c in enumerate([*text, " "]):
        kind = unicodedata.category(c)
        if kind[0] in "LN":
            if start < 0:
                start, word = i, ""
            low = c.lower()
            word += "".join(_FOLDS.get(x, x) for x in low if unicodedata.category(x) != "Mn")
        elif start >= 0 and kind != "Mn":
            out.append((word, start, i))
            start = -1
    return out


@dataclass(frozen=True)
class Node:
    """A phrase (its words), or an operator over two expressions."""

    op: str
    words: tuple[str, ...] = ()
    left: Node | None = None
    right: Node | None = None


class Expression:
    """Phrases, AND (also between bare terms), OR, NOT and parentheses; NOT binds closest, then AND, then OR."""

    def __init__(self, text: str):
        self.parts = re.findall(r'"(?:[^"]|"")*"|[()]|[^\s()"]+', text)
        self.i = 0
        self.tree = self.either() if self.parts else None
        if self.i < len(self.parts):
            raise ValueError(f"search expression: {text!r}")

    def next(self) -> str | None:
        return self.parts[self.i] if self.i < len(self.parts) else None

    def either(self) -> Node | None:
        return self.chain(self.both, lambda: self.taken("OR"), "or")

    def both(self) -> Node | None:
        return self.chain(self.without, lambda: self.taken("AND") or self.next() not in (None, ")", "OR", "NOT"), "and")

    def without(self) -> Node | None:
        return self.chain(self.atom, lambda: self.taken("NOT"), "not")

    def chain(self, part, more, op: str) -> Node | None:
        left = part()
        while more():
            right = part()
            left = left if right is None else right if left is None and op != "not" else Node(op, (), left, right)
        return left

    def taken(self, word: str) -> bool:
        if self.next() != word:
            return False
        self.i += 1
        return True

    def atom(self) -> Node | None:
        x = self.next()
        if x is None or x in (")", "AND", "OR", "NOT"):
            raise ValueError("search expression: a term is missing")
        self.i += 1
        if x == "(":
            inner = self.either()
            if not self.taken(")"):
                raise ValueError("search expression: ) is missing")
            return inner
        found = tuple(words(x.replace('""', " ")))
        return Node("phrase", found) if found else None


def phrases(tree: Node | None) -> list[tuple[str, ...]]:
    if tree is None:
        return []
    if tree.op == "phrase":
        return [tree.words]
    return list(dict.fromkeys(phrases(tree.left) + phrases(tree.right)))


def terms(query: str, most: int = 10) -> list[list[str]]:
    """Phrases of a query without operators: quoted parts, else words."""
    out: list[list[str]] = []
    for quoted, word in re.findall(r'"([^"]*)"|(\S+)', query):
        phrase = words(quoted or word)
        if phrase and phrase not in out:
            out.append(phrase)
    return out[:most]


def any_of(query: str) -> Node | None:
    """The terms of a query, any of which is enough."""
    tree = None
    for p in terms(query):
        one = Node("phrase", tuple(p))
        tree = one if tree is None else Node("or", (), tree, one)
    return tree


def occurrences(toks: Column, phrase: tuple[str, ...]) -> Column:
    """How often the phrase occurs in a token array."""
    if len(phrase) == 1:
        return F.size(F.filter(toks, lambda x: x == phrase[0]))

    def here(x, i):
        out = x == phrase[0]
        for k, word in enumerate(phrase[1:], 1):
            out = out & F.coalesce(F.get(toks, i + k) == word, F.lit(False))
        return out

    return F.size(F.filter(toks, here))


def _holds(tree: Node, counts: dict) -> Column:
    if tree.op == "phrase":
        return counts[tree.words] > 0
    left = F.lit(False) if tree.left is None else _holds(tree.left, counts)
    right = _holds(tree.right, counts)
    return left & right if tree.op == "and" else left | right if tree.op == "or" else left & ~right


def search(docs: DataFrame, query: str | Node, limit: int, content: str = "content", mode: str = "and", keep: Column | None = None, order: tuple[str, ...] = ()) -> DataFrame:
    """The best rows by BM25 with `score`; statistics are those of all rows, `keep` filters before the limit.

    mode "and" reads the query as an expression, "or" takes any of its terms.  One pass counts, and the statistics join it as one row."""
    tree = query if isinstance(query, Node) else any_of(query) if mode == "or" else Expression(query).tree
    ps = phrases(tree)
    size, count = "_len", {p: F.col(f"_f{k}") for k, p in enumerate(ps)}
    rows = docs.where(F.length(content) > 0).withColumn("_t", tokens(F.col(content)))
    rows = rows.withColumns({size: F.size("_t"), **{f"_f{k}": occurrences(F.col("_t"), p) for k, p in enumerate(ps)}}).drop("_t")
    stats = rows.agg(F.count("*").alias("_n"), F.avg(size).alias("_mean"), *(F.count_if(F.col(f"_f{k}") > 0).alias(f"_d{k}") for k in range(len(ps))))
    hits = rows.where(_holds(tree, count) if tree else F.lit(False))
    hits = (hits.where(keep) if keep is not None else hits).withColumn("_one", F.lit(1)).join(F.broadcast(stats.withColumn("_one", F.lit(1))), "_one")  # one row
    score = F.lit(0.0)
    for k, p in enumerate(ps):
        n, d, tf = F.col("_n"), F.col(f"_d{k}"), count[p]
        idf = F.greatest(F.log((n - d + 0.5) / (d + 0.5)), F.lit(FLOOR))
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col(size) / F.col("_mean")))
    return hits.withColumn("score", score).orderBy(F.desc(F.round("score", 9)), *order).limit(limit).drop("_one", "_n", "_mean", size, *(f"_f{k}" for k in range(len(ps))), *(f"_d{k}" for k in range(len(ps))))


# ---------------------------------------------------------------- what is shown of a hit


def _hits(found: list[tuple[str, int, int]], ps: list[tuple[str, ...]]) -> list[tuple[int, int, int]]:
    """(first token, last token + 1, phrase) of every occurrence."""
    plain = [w for w, _, _ in found]
    return sorted((i, i + len(p), k) for k, p in enumerate(ps) for i in range(len(plain) - len(p) + 1) if tuple(plain[i : i + len(p)]) == p)


def shown(text: str, ps: list[tuple[str, ...]], most: int | None = None, marks: tuple[str, str] = ("[", "]"), gap: str = " … ") -> str:
    """The text with its hits in marks; with most, the window of that many tokens that holds most different phrases, then most hits, then comes first."""
    found = _spans(text)
    hits = _hits(found, ps)
    lo, hi = 0, len(found)
    if most is not None and len(found) > most:
        starts = {0, *(max(0, min(i, len(found) - most)) for i, _, _ in hits)}
        inside = lambda s: [h for h in hits if h[0] >= s and h[1] <= s + most]
        lo = min(starts, key=lambda s: (-len({k for _, _, k in inside(s)}), -len(inside(s)), s))
        hi = lo + most
    marked = set()
    for i, j, _ in hits:
        if i >= lo and j <= hi:
            marked |= set(range(i, j))
    begin = 0 if lo == 0 else found[lo][1]
    end = len(text) if hi == len(found) else found[hi - 1][2]
    out, at, i = [gap] if lo else [], begin, lo
    while i < hi:
        j = i
        while j < hi and j in marked:
            j += 1
        if j > i:  # neighbouring hits share one pair of marks
            out += [text[at : found[i][1]], marks[0], text[found[i][1] : found[j - 1][2]], marks[1]]
            at = found[j - 1][2]
            i = j
        else:
            i += 1
    return "".join([*out, text[at:end], *([gap] if hi < len(found) else [])])


def snippets(rows: DataFrame, query: str | Node, most: int | None = 28, content: str = "content", mode: str = "and") -> DataFrame:
    """Rows (a bounded number of hits) with `snippet`."""
    tree = query if isinstance(query, Node) else any_of(query) if mode == "or" else Expression(query).tree
    ps = phrases(tree)

    def cut(text: pd.Series) -> pd.Series:
        return text.map(lambda t: None if t is None else shown(t, ps, most))

    return rows.withColumn("snippet", F.pandas_udf(cut, StringType())(F.col(content)))
