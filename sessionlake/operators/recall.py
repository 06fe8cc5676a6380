"""Recall beyond plain search: terms of questions, selection of candidates, reranking by a given function.

Candidates are at most 200 ranked hits, so their selection runs on the driver.  Reranking calls a
function `(query, [(id, text)]) -> [(id, score, reason)]`; no network is used unless a caller's
function does, and only redacted, cut texts and opaque ids are passed to it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from pathlib import Path

from ..functions import rules as R
from ..store import files as S

Scorer = Callable[[str, list[tuple[str, str]]], list[tuple[str, float, str]]]

# ---- fixed values: bounds of what a scorer gets, and of what is kept ----

MOST_CANDIDATES, MOST_TEXT, MOST_QUERY, MOST_REASON = 50, 600, 800, 180
LEAST_SCORE, BELOW_BEST = 60, 20

# ---- end of fixed values ----


def ask_terms(question: str, most: int = 8) -> list[str]:
    plain = re.sub(r"(?i)what did (?:i|we) try last time for", "", question, count=1)
    words = [w for w in re.findall(r"[a-z][a-z0-9_-]{2,}", plain.lower()) if w not in R.ASK_STOP]
    return list(dict.fromkeys(words))[:most]


def quoted(words: list[str]) -> str:
    return " ".join('"' + w.replace('"', '') + '"' for w in words)


def redact(text: str) -> str:
    for pattern, marker in R.REDACTIONS:
        text = re.sub(pattern, marker.replace("$1", r"\1"), text, flags=re.ASCII)
    return text


def selected(hits: list[dict], wanted: int) -> list[dict]:
    """The first `wanted` hits in rank order: at most two of a conversation, no text twice."""
    out, per, seen = [], {}, set()
    for h in hits:
        text = re.sub(r"\s+", " ", re.sub(r"[\[\]]", "", h["snippet"])).strip()[:240]
        if text in seen or per.get(h["conv_id"], 0) >= 2:
            continue
        seen.add(text)
        per[h["conv_id"]] = per.get(h["conv_id"], 0) + 1
        out.append(h)
        if len(out) == wanted:
            break
    return out


def overlap(query: str, candidates: list[tuple[str, str]]) -> list[tuple[str, float, str]]:
    """A local scorer for tests and offline use: share of the query's terms that a text holds, out of 100."""
    words = ask_terms(query)
    found = lambda text: [w for w in words if w in text.lower()]
    return [(i, 100 * len(found(t)) / max(1, len(words)), "terms: " + " ".join(found(t))) for i, t in candidates]


def checked(rows, ids: list[str]) -> list[tuple[str, float, str]]:
    """Scores clamped to 0..100, one per known id, best first; ids without one score 0."""
    out: dict[str, tuple[str, float, str]] = {}
    for row in rows:
        try:
            i, score, reason = row[0], float(row[1]), str(row[2] if len(row) > 2 else "")
        except (TypeError, ValueError, IndexError, KeyError):
            continue
        if i in ids and i not in out and score == score and abs(score) != float("inf"):
            out[i] = (i, max(0.0, min(100.0, score)), redact(reason)[:MOST_REASON])
    for i in ids:
        out.setdefault(i, (i, 0.0, "not ranked"))
    return sorted(out.values(), key=lambda r: (-r[1], r[0]))


def loose_json(text: str) -> dict:
    """The JSON object in a model's answer, fenced or between other words."""
    start, end = text.find("{"), text.rfind("}")
    if start < 0 or end < start:
        raise ValueError("the answer holds no JSON object")
    return json.loads(text[start : end + 1])


def rerank(query: str, candidates: list[tuple[str, str]], scorer: Scorer, name: str, root: str | None = None) -> dict:
    """rankings, request hash and what was passed on; answers are kept under the root by request hash."""
    if not candidates:
        raise ValueError("reranking needs a candidate")
    query = redact(query)[:MOST_QUERY]
    given = [(i, re.sub(r"\s+", " ", redact(t)).strip()[:MOST_TEXT]) for i, t in candidates[:MOST_CANDIDATES]]
    request = S.sha256(S.canonical({"scorer": name, "query": query, "candidates": given}))
    passed = {"query_characters": len(query), "candidates": len(given), "candidate_characters": sum(len(t) for _, t in given)}
    path = Path(root) / "rerank" / request[:2] / f"{request}.json" if root else None
    if path is not None and path.exists():
        held = S.unseal(path)
        if held["request"] == request:
            return {"rankings": [tuple(r) for r in held["rankings"]], "request": request, "cached": True, "passed": passed}
    ranked = checked(scorer(query, given), [i for i, _ in given])
    if path is not None:
        S.write(path, S.seal({"request": request, "scorer": name, "rankings": ranked}))
    return {"rankings": ranked, "request": request, "cached": False, "passed": passed}


def qualified(hits: list[dict]) -> tuple[list[dict], float | None]:
    """Hits within 20 of the best score and of at least 60; all, without a threshold, where none is."""
    floor = max(LEAST_SCORE, max((h["score"] for h in hits), default=0) - BELOW_BEST)
    good = [h for h in hits if h["score"] >= floor]
    return (good, floor) if good else (hits, None)
