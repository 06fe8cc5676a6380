"""Operation intents: what an operation is about to make current, so that a crash can be resolved.

The snapshot pointer alone decides: it names the snapshot before (the operation is aborted), the one
after (the rest of the operation is done), or neither (a conflict that nothing resolves by itself).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from pathlib import Path

from . import files as S

STEPS = ["prepared", "committed", "derived", "receipted", "completed"]
#: Bounds of pending operations and of an intent's size.
MOST_PENDING, MOST_BYTES = 1000, 16 << 20


class Conflict(RuntimeError):
    """The current snapshot is on neither side of an operation."""


def _path(root: str | Path, state: str, op: str) -> Path:
    return Path(root) / "operations" / state / f"{op}.json"


def _save(root, state: str, body: dict) -> None:
    S.write(_path(root, state, body["operation"]), S.seal(body), MOST_BYTES)


def create(root, kind: str, before: str, after: str, detail: dict | None = None, op: str | None = None) -> dict:
    body = {"operation": op or uuid.uuid4().hex, "kind": kind, "status": "prepared", "before": before, "after": after, "detail": detail or {}, "created": S.now(), "updated": S.now()}
    _save(root, "pending", body)
    return body


def advance(root, intent: dict, status: str, **more) -> dict:
    """The intent one or more steps on; steps never go back."""
    if STEPS.index(status) < STEPS.index(intent["status"]):
        raise ValueError(f"operation {intent['operation']} cannot go from {intent['status']} to {status}")
    intent = intent | {"status": status, "updated": S.now(), "detail": intent["detail"] | more}
    _save(root, "pending", intent)
    return intent


def finish(root, intent: dict, status: str = "completed") -> dict:
    if status not in ("completed", "aborted"):
        raise ValueError(f"{status} does not end an operation")
    done = intent | {"status": status, "updated": S.now()}
    _save(root, status, done)
    S.remove(_path(root, "pending", intent["operation"]))
    return done


def pending(root) -> list[dict]:
    folder = Path(root) / "operations" / "pending"
    names = sorted(folder.glob("*.json")) if folder.is_dir() else []
    if len(names) > MOST_PENDING:
        raise RuntimeError(f"{len(names)} pending operations exceed {MOST_PENDING}")
    out = [S.unseal(p) for p in names]
    for p, x in zip(names, out, strict=True):
        if p.stem != x["operation"]:
            raise S.IntegrityError(f"{p}: holds operation {x['operation']}")
    return out


def settle(root, intent: dict, current: str) -> str:
    """aborted or committed, by the current snapshot; Conflict if it is neither."""
    if current == intent["after"]:
        return "committed"
    if current == intent["before"]:
        return "aborted"
    raise Conflict(f"operation {intent['operation']}: the current snapshot is on neither side")


def recover(root, current: Callable[[], str], resume: Callable[[dict], None]) -> dict[str, int]:
    """Resolve all pending operations; counts of discovered, completed and aborted ones."""
    found = pending(root)
    count = {"discovered": len(found), "completed": 0, "aborted": 0}
    for intent in found:
        done = _path(root, "completed", intent["operation"])
        if done.exists():
            if S.unseal(done)["status"] != "completed":
                raise S.IntegrityError(f"{done}: not completed")
            S.remove(_path(root, "pending", intent["operation"]))
            count["completed"] += 1
        elif settle(root, intent, current()) == "aborted":
            finish(root, intent, "aborted")
            count["aborted"] += 1
        else:
            resume(intent)
            finish(root, intent)
            count["completed"] += 1
    return count


# ---------------------------------------------------------------- receipts


def receipt(root, body: dict) -> str:
    """Write an import receipt; its id is its content's hash, repeated writes are one."""
    text = S.canonical(body)
    name = f"{body['completed'].replace(':', '-')}-{S.sha256(text)[:16]}"
    path = Path(root) / "receipts" / f"{name}.json"
    if not path.exists():
        S.write(path, S.seal(body))
    return name


def receipts(root, limit: int = 20) -> list[dict]:
    """Newest first, 1 to 200; a changed receipt is an error."""
    limit = max(1, min(200, int(limit)))
    folder = Path(root) / "receipts"
    names = sorted(folder.glob("*.json"), key=lambda p: p.name, reverse=True) if folder.is_dir() else []
    return [S.unseal(p) | {"id": p.stem} for p in names[:limit]]


# ---------------------------------------------------------------- invalidation of derived state


def _mark(root) -> Path:
    return Path(root) / "derived" / "_invalid.json"


def invalidate(root, snapshot: str, reason: str) -> None:
    S.write(_mark(root), S.seal({"snapshot": snapshot, "reason": reason, "at": S.now()}))


def validate(root) -> None:
    """Take the mark away."""
    if _mark(root).exists():
        S.remove(_mark(root))


def assert_valid(root) -> None:
    if _mark(root).exists():
        raise S.IntegrityError(f"derived state is invalid: {S.unseal(_mark(root))['reason']}")
