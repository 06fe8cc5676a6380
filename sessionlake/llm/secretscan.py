"""Secret scan with one combined deterministic automaton.

Rules are byte regexes.  Their reversed forms go into one NFA with a loop at its start; subset
construction and partition refinement turn it into a minimal DFA of transition arrays over byte
classes, whose states carry a bit for each rule.  One pass over a text from its end then marks
every position where a match of some rule starts.  A rule's own small DFA, anchored at a start,
gives the longest match; leftmost starts win and matches do not overlap within a kind, matches
that fail the kind's test are dropped after that.  All quantities a rule leaves open are single
classes, so longest and greedy matches agree.

Many texts advance side by side, one byte of each a step, and the last few long texts of a batch
go on by themselves, so a very long text costs a plain loop and no padding.

A match is read once forward, up to where its rule can match no more, so a text costs time in
proportion to its length.

Defined cases: null is the empty text; null ids are kept; repeated rows are scanned like others.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: Shortest whole match that counts, and shortest part after the prefix, the longest match of `prefix`.
    least: int = 1
    prefix: str | None = None
    least_value: int = 1


#: The base kinds, in the order in which they are listed.  Runs of 32 hex digits or more are the maximal runs that pass.
BASE = (
    Rule("assign", r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]+", prefix=r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?", least_value=8),
    Rule("access", r"AKIA[A-Z0-9]+", least=16),
    Rule("hex", r"[0-9a-f]{32,}"),
)
#: Further public credential shapes.
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{20,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
RULES = BASE + MORE


# ---------------------------------------------------------------- regexes to automata


class _Parser:
    """Byte regexes: literals, classes, groups, |, ?, *, +, {m}, {m,}, {m,n}.  Trees of (op, ...)."""

    def __init__(self, text: str):
        self.t, self.i = text, 0

    def parse(self):
        tree = self.either()
        if self.i != len(self.t):
            raise ValueError(f"regex: {self.t!r} at {self.i}")
        return tree

    def either(self):
        parts = [self.chain()]
        while self.t[self.i : self.i + 1] == "|":
            self.i += 1
            parts.append(self.chain())
        return parts[0] if len(parts) == 1 else ("or", parts)

    def chain(self):
        parts = []
        while self.i < len(self.t) and self.t[self.i] not in "|)":
            parts.append(self.repeated())
        return ("cat", parts)

    def repeated(self):
        x = self.atom()
        while self.i < len(self.t) and self.t[self.i] in "?*+{":
            c = self.t[self.i]
            self.i += 1
            if c == "{":
                end = self.t.index("}", self.i)
                low, comma, high = self.t[self.i : end].partition(",")
                self.i = end + 1
                x = ("rep", x, int(low), None if comma and not high else int(high or low))
            else:
                x = ("rep", x, int(c == "+"), 1 if c == "?" else None)
        return x

    def byte(self) -> int:
        c = self.t[self.i]
        self.i += 1
        if c != "\\":
            return ord(c)
        c = self.t[self.i]
        self.i += 1
        if c == "x":
            self.i += 2
            return int(self.t[self.i - 2 : self.i], 16)
        return ord(c)

    def atom(self):
        c = self.t[self.i]
        if c == "(":
            self.i += 1
            x = self.either()
            self.i += 1
            return x
        if c != "[":
            return ("set", frozenset([self.byte()]))
        self.i += 1
        chosen: set[int] = set()
        while self.t[self.i] != "]":
            low = self.byte()
            if self.t[self.i] == "-" and self.t[self.i + 1] != "]":
                self.i += 1
                chosen |= set(range(low, self.byte() + 1))
            else:
                chosen.add(low)
        self.i += 1
        return ("set", frozenset(chosen))


def _reversed(x):
    if x[0] == "cat":
        return ("cat", [_reversed(y) for y in reversed(x[1])])
    if x[0] == "or":
        return ("or", [_reversed(y) for y in x[1]])
    return ("rep", _reversed(x[1]), *x[2:]) if x[0] == "rep" else x


class _Nfa:
    def __init__(self):
        self.empty: list[list[int]] = []
        self.step: list[tuple[frozenset, int] | None] = []

    def node(self) -> int:
        self.empty.append([])
        self.step.append(None)
        return len(self.empty) - 1

    def add(self, x, at: int) -> int:
        """Build x after node `at`; its last node."""
        if x[0] == "set":
            to, mid = self.node(), self.node()
            self.empty[at].append(mid)
            self.step[mid] = (x[1], to)
            return to
        if x[0] == "cat":
            for y in x[1]:
                at = self.add(y, at)
            return at
        if x[0] == "or":
            end = self.node()
            for y in x[1]:
                self.empty[self.add(y, at)].append(end)
            return end
        _, y, low, high = x
        for _ in range(low):
            at = self.add(y, at)
        if high is None:
            loop = self.node()
            self.empty[at].append(loop)
            self.empty[self.add(y, loop)].append(loop)
            return loop
        end = self.node()
        for _ in range(high - low):
            self.empty[at].append(end)
            at = self.add(y, at)
        self.empty[at].append(end)
        return end

    def closure(self, nodes) -> frozenset:
        seen, todo = set(nodes), list(nodes)
        while todo:
            for y in self.empty[todo.pop()]:
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        return frozenset(seen)


@dataclass
class Dfa:
    """State 0 is the start; accepting states come last, from `accepting` on."""

    table: np.ndarray  # states x classes
    classes: np.ndarray  # class of each byte
    bits: np.ndarray  # rules accepted in each state
    accepting: int


def compile_rules(trees: list, loop: bool) -> Dfa:
    nfa, ends = _Nfa(), {}
    start = nfa.node()
    for k, x in enumerate(trees):
        ends[nfa.add(x, start)] = 1 << k
    sets = sorted({s for s, _ in filter(None, nfa.step)}, key=sorted)
    member = np.array([[b in s for s in sets] for b in range(256)])
    kinds, classes = np.unique(member, axis=0, return_inverse=True)
    classes = classes.reshape(-1)
    of_set = {s: set(np.flatnonzero(kinds[:, k]).tolist()) for k, s in enumerate(sets)}
    # subset construction
    first = nfa.closure([start])
    index, todo, rows = {first: 0}, [first], []
    for state in todo:
        moves: list[set] = [set([start]) if loop else set() for _ in kinds]
        for n in state:
            if nfa.step[n]:
                s, to = nfa.step[n]
                for c in of_set[s]:
                    moves[c].add(to)
        row = []
        for m in moves:
            to = nfa.closure(m)
            if to not in index:
                index[to] = len(todo)
                todo.append(to)
            row.append(index[to])
        rows.append(row)
    table = np.array(rows)
    bits = np.array([sum(ends.get(n, 0) for n in state) for state in todo])
    # minimisation by refinement of the partition
    _, part = np.unique(bits, return_inverse=True)
    while True:
        _, finer = np.unique(np.column_stack([part, part[table]]), axis=0, return_inverse=True)
        finer = finer.reshape(-1)
        if finer.max() == part.max():
            break
        part = finer
    _, one = np.unique(part, return_index=True)
    order = np.lexsort((part[one] != part[0], bits[one] > 0))
    new = np.empty(len(order), np.int64)
    new[order] = np.arange(len(order))
    table, bits = new[part[table[one]]][order], bits[one][order]
    return Dfa(table, classes, bits, int((bits == 0).sum()))


class Scanner:
    #: Texts that go on one by one.
    FEW = 48

    def __init__(self, rules=RULES):
        self.rules = rules
        trees = [_Parser(r.pattern).parse() for r in rules]
        self.starts = compile_rules([_reversed(x) for x in trees], loop=True)
        self.single = [self.plain(compile_rules([x], loop=False)) for x in trees]
        self.prefix = [self.plain(compile_rules([_Parser(r.prefix).parse()], loop=False)) if r.prefix else None for r in rules]
        d = self.starts
        self.flat = (d.table * len(d.table[0])).astype(np.int32).reshape(-1)
        self.width = len(d.table[0])
        self.wide = d.table[:, d.classes].tolist()

    @staticmethod
    def plain(d: Dfa):
        """(moves by byte, whether a state accepts, whether a match can still come)."""
        stuck = (d.table == np.arange(len(d.table))[:, None]).all(1) & (d.bits == 0)
        return d.table[:, d.classes].tolist(), (d.bits > 0).tolist(), (~stuck).tolist()

    def marks(self, data: np.ndarray, off: np.ndarray):
        """(text, byte position in it, rule bits) of every position where a match starts."""
        d, size = self.starts, np.diff(off)
        order = np.argsort(-size, kind="stable")
        last, size = off[1:][order] - 1, size[order]
        cls = d.classes.astype(np.int32)[data] if len(data) else np.zeros(0, np.int32)
        state = np.zeros(len(order), np.int32)
        limit = d.accepting * self.width
        found, t, active = [], 0, int((size > 0).sum())
        few = min(self.FEW, len(order))
        until = int(size[few - 1]) if active >= self.FEW else 0
        # sizes descend, so the texts still active at step t are a prefix
        ends = np.searchsorted(-size, -np.arange(until + 1), "left") if until else np.zeros(1, np.int64)
        while t < until:
            active = int(ends[t])
            state = state[:active]
            state = self.flat[state + cls[last[:active] - t]]
            if state.max() >= limit:
                hit = np.flatnonzero(state >= limit)
                found.append((order[hit], size[hit] - 1 - t, d.bits[state[hit] // self.width]))
            t += 1
        for k in range(min(few, int((size > 0).sum()))):
            if size[k] <= t:
                continue
            text, s, wide, first = data[last[k] - size[k] + 1 : last[k] - t + 1].tobytes(), int(state[k]) // self.width if t else 0, self.wide, d.accepting
            at, bits = [], []
            for p in range(len(text) - 1, -1, -1):
                s = wide[s][text[p]]
                if s >= first:
                    at.append(p)
                    bits.append(int(d.bits[s]))
            if at:
                found.append((np.full(len(at), order[k]), np.array(at), np.array(bits)))
        if not found:
            return (np.zeros(0, np.int64),) * 3
        doc, place, bits = (np.concatenate(x) for x in zip(*found, strict=True))
        by = np.lexsort((place, doc))
        return doc[by], place[by], bits[by]

    @staticmethod
    def longest(dfa, text: bytes, start: int) -> int:
        """End of the longest match from start, else -1; reading ends where no match can come any more."""
        table, accepts, alive = dfa
        s, end = 0, -1
        for p in range(start, len(text)):
            s = table[s][text[p]]
            if accepts[s]:
                end = p + 1
            elif not alive[s]:
                break
        return end

    def spans(self, text: bytes, place: np.ndarray, bits: np.ndarray) -> list[tuple[int, int, int]]:
        """(start, rule, end) in bytes, by start and rule, of matches that pass."""
        out = []
        for k, rule in enumerate(self.rules):
            done = 0
            for p in place[(bits >> k) & 1 == 1].tolist():
                if p < done:
                    continue
                done = self.longest(self.single[k], text, p)
                value = done - self.longest(self.prefix[k], text, p) if rule.prefix else done - p
                if done - p >= rule.least and value >= rule.least_value:
                    out.append((p, k, done))
        return sorted(out)

    def scan(self, data: np.ndarray, off: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
        """Texts with spans: (start, rule, end) in code points."""
        doc, place, bits = self.marks(data, off)
        out = {}
        for i in np.unique(doc).tolist():
            lo, hi = np.searchsorted(doc, [i, i + 1])
            raw = data[off[i] : off[i + 1]]
            found = self.spans(raw.tobytes(), place[lo:hi], bits[lo:hi])
            if found:
                point = np.append(0, np.cumsum((raw & 0xC0) != 0x80))
                out[i] = [(int(point[s]), k, int(point[e])) for s, k, e in found]
        return out


_scanner: list = []


def _rows(rules):
    base = len([r for r in rules if r in BASE])

    def run(batches):
        if not _scanner or _scanner[0].rules != rules:
            _scanner[:] = [Scanner(rules)]
        scanner = _scanner[0]
        empty = hashlib.sha256(b"").hexdigest()
        for b in batches:
            data, off = C.buffers(b.column(1))
            n = len(off) - 1
            counts = np.zeros((base, n), np.int64)
            digest, text = [empty] * n, [""] * n
            for i, j in C.steps(off, 32 << 20):
                for k, spans in scanner.scan(data[off[i] : off[j]], off[i : j + 1] - off[i]).items():
                    told = [(r < base, f"{rules[r].kind}:{s}:{e}") for s, r, e in spans]
                    for _, r, _ in spans:
                        if r < base:
                            counts[r, i + k] += 1
                    digest[i + k] = hashlib.sha256(",".join(x for own, x in told if own).encode()).hexdigest()
                    text[i + k] = ",".join(x for _, x in told)
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, counts), pa.array(digest), pa.array(text)], names=["doc_id", *(f"n_{r.kind}" for r in rules[:base]), "base_sha256", "spans"])

    return run


def scan(docs: DataFrame, rules=RULES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every document; rules start with BASE."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_rows(tuple(rules)), "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")
