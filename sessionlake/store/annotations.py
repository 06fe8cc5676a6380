"""Reviews of workflow patterns: append-only records behind a sealed manifest, with optimistic revisions."""

from __future__ import annotations

import json
import re
import time
from pathlib import Path

from . import files as S

# ---- fixed values: bounds, dispositions and refused characters ----

HANDLE = 24
MOST_LABEL, MOST_NOTE, MOST_HISTORY = 120, 1000, 10_000
DISPOSITIONS = ["unreviewed", "confirmed", "contextual", "dismissed"]
REFUSED = re.compile(r"[\u0000-\u0008\u000B\u000C\u000E-\u001F\u007F-\u009F\u061C\u200B\u200E\u200F\u2028\u2029\u202A-\u202E\u2060-\u206F\uFEFF]")
WRITES_A_MINUTE = 30

# ---- end of fixed values ----


class Stale(RuntimeError):
    """Written against another revision or snapshot than the current ones."""


def handle(kind: str, signal: str, role: str) -> str:
    return S.sha256(f"pattern:{S.canonical([kind, signal, role])}")[:HANDLE]


def text(value: str | None, label: str, most: int, one_line: bool = False) -> str | None:
    if value is None:
        return None
    if not isinstance(value, str):
        raise ValueError(f"{label} must be text")
    value = value.strip()
    if not value:
        return None
    if len(value) > most:
        raise ValueError(f"{label} exceeds {most} characters")
    if REFUSED.search(value) or (one_line and re.search(r"[\t\r\n]", value)):
        raise ValueError(f"{label} contains unsupported control characters")
    return value


class RateLimit:
    """At most n calls in any 60 seconds before now."""

    def __init__(self, n: int = WRITES_A_MINUTE, clock=time.monotonic):
        self.n, self.clock, self.seen = n, clock, []

    def allow(self) -> bool:
        t = self.clock()
        self.seen = [x for x in self.seen if x > t - 60]
        if len(self.seen) >= self.n:
            return False
        self.seen.append(t)
        return True


def _manifest(root) -> Path:
    return Path(root) / "annotations" / "manifest.json"


def _object(root, digest: str) -> Path:
    return Path(root) / "annotations" / "objects" / digest[:2] / f"{digest}.json"


def _record(root, digest: str) -> dict:
    path = _object(root, digest)
    try:
        raw = path.read_text()
    except FileNotFoundError:
        raise S.IntegrityError(f"{path}: missing record") from None
    if S.sha256(raw) != digest:
        raise S.IntegrityError(f"{path}: content differs from its hash")
    return json.loads(raw)


def state(root) -> dict:
    """revision and current {handle: digest}; an empty store where nothing was written."""
    path = _manifest(root)
    return S.unseal(path) if path.exists() else {"revision": 0, "current": {}}


def history(root, of: str) -> list[dict]:
    """Records of a handle, newest first; a gap, a cycle or another identity in the chain is an error."""
    digest, out, seen = state(root)["current"].get(of), [], set()
    while digest is not None:
        if digest in seen or len(out) >= MOST_HISTORY:
            raise S.IntegrityError("annotation history has a cycle or is too long")
        seen.add(digest)
        r = _record(root, digest)
        expected = out[-1]["revision"] - 1 if out else r["revision"]
        if r["handle"] != of or r["revision"] != expected or (out and r["pattern"] != out[-1]["pattern"]):
            raise S.IntegrityError("annotation history is broken")
        out.append(r)
        digest = r["previous"]
    if out and out[-1]["revision"] != 1:
        raise S.IntegrityError("annotation history does not start at revision 1")
    return out


def write(root, patterns: list[dict], snapshot: str, of: str, expected: int, disposition: str, label: str | None = None, note: str | None = None, observed: str | None = None) -> dict:
    """Append a review of an active pattern (kind, signal, role); Stale if it was made against older state."""
    active = {handle(p["kind"], p["signal"], p["role"]): p for p in patterns}
    if of not in active:
        raise ValueError("the pattern is not active")
    if disposition not in DISPOSITIONS:
        raise ValueError("unknown disposition")
    if not isinstance(expected, int) or expected < 0:
        raise ValueError("the expected revision is invalid")
    label, note = text(label, "label", MOST_LABEL, True), text(note, "note", MOST_NOTE)
    with S.lock(Path(root) / "annotations" / "lock", tries=400):
        now = state(root)
        digest = now["current"].get(of)
        held = _record(root, digest) if digest else None
        if (observed is not None and observed != snapshot) or (held["revision"] if held else 0) != expected:
            raise Stale(f"revision {held['revision'] if held else 0} of snapshot {snapshot} is current")
        p = active[of]
        body = {"handle": of, "pattern": {k: p[k] for k in ("kind", "signal", "role")}, "previous": digest, "revision": expected + 1, "snapshot": snapshot, "created": S.now(), "disposition": disposition, "label": label, "note": note}
        raw = S.canonical(body)
        S.write(_object(root, S.sha256(raw)), raw)
        S.write(_manifest(root), S.seal({"revision": now["revision"] + 1, "current": now["current"] | {of: S.sha256(raw)}}))
        return body


def view(root, patterns: list[dict]) -> dict:
    """Reviews of active patterns, counts by disposition, and how many belong to patterns that are gone."""
    active = {handle(p["kind"], p["signal"], p["role"]) for p in patterns}
    held = {h: _record(root, d) for h, d in state(root)["current"].items()}
    live = {h: r for h, r in held.items() if h in active}
    counts = {d: sum(r["disposition"] == d for r in live.values()) for d in DISPOSITIONS}
    counts["unreviewed"] += len(active) - len(live)
    return {"annotations": live, "summary": counts, "inactive": len(held) - len(live)}
