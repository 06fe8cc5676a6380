"""Durable small files and exclusive locks on the driver."""

from __future__ import annotations

import contextlib
import hashlib
import json
import os
import time
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime
from pathlib import Path

STALE_SECONDS = 6 * 60 * 60


class IntegrityError(RuntimeError):
    """Stored bytes are not what was written."""


class Locked(RuntimeError):
    """Another live process holds the lock."""


def sha256(data: str | bytes) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def canonical(value) -> str:
    """The one JSON text of a value."""
    return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def now() -> str:
    return datetime.now(UTC).isoformat(timespec="milliseconds").replace("+00:00", "Z")


def sync_folder(path: Path) -> None:
    fd = os.open(path, os.O_RDONLY)
    try:
        os.fsync(fd)
    finally:
        os.close(fd)


def write(path: str | Path, text: str, most: int | None = None) -> None:
    """Replace a file at once and for good: private, synced, never half written."""
    path, data = Path(path), text.encode()
    if most is not None and len(data) > most:
        raise ValueError(f"{path}: {len(data)} bytes exceed {most}")
    path.parent.mkdir(parents=True, exist_ok=True, mode=0o700)
    temp = path.with_name(f"{path.name}.{uuid.uuid4().hex}.tmp")
    fd = os.open(temp, os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o600)
    try:
        with os.fdopen(fd, "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        os.replace(temp, path)
    except BaseException:
        temp.unlink(missing_ok=True)
        raise
    sync_folder(path.parent)


def seal(body: dict) -> str:
    return json.dumps(body | {"integrity": sha256(canonical(body))}, ensure_ascii=False, indent=2) + "\n"


def unseal(path: str | Path) -> dict:
    body = json.loads(Path(path).read_text())
    if not isinstance(body, dict) or body.pop("integrity", None) != sha256(canonical(body)):
        raise IntegrityError(f"{path}: integrity check failed")
    return body


def remove(path: Path) -> None:
    path.unlink(missing_ok=True)
    sync_folder(path.parent)


def _stale(path: Path) -> bool:
    try:
        pid = json.loads(path.read_text())["pid"]
    except FileNotFoundError:
        return True
    except (ValueError, KeyError, TypeError):
        with contextlib.suppress(FileNotFoundError):
            return time.time() - path.stat().st_mtime > STALE_SECONDS
        return True
    try:
        os.kill(pid, 0)
    except ProcessLookupError:
        return True
    except PermissionError:
        return False
    return False


@contextlib.contextmanager
def lock(path: str | Path, tries: int = 1, wait: float = 0.005) -> Iterator[None]:
    """Exclusive between processes; a dead holder's lock is taken over once, a live one's is waited for `tries` times."""
    path, run = Path(path), uuid.uuid4().hex
    path.parent.mkdir(parents=True, exist_ok=True, mode=0o700)
    taken_over = False
    while True:
        try:
            fd = os.open(path, os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o600)
        except FileExistsError:
            if not taken_over and _stale(path):
                taken_over = True
                path.unlink(missing_ok=True)
                continue
            tries -= 1
            if tries <= 0:
                raise Locked(f"{path} is held") from None
            time.sleep(wait)
            continue
        with os.fdopen(fd, "w") as f:
            json.dump({"pid": os.getpid(), "run": run, "started": now()}, f)
        break
    try:
        yield
    finally:
        with contextlib.suppress(FileNotFoundError, ValueError):
            if json.loads(path.read_text()).get("run") == run:
                path.unlink()
