"""Content-addressed derived artifacts, each bound to the inputs it was made from.

One helper serves every artifact: JSON of bounded reports.  Loading checks that the bytes are those
recorded, that the path stays inside the store, that the inputs are still current and that nothing
marked derived state invalid.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from pathlib import Path

from . import files as S
from . import journal as J

#: Fixed value: the most bytes of an artifact.
MOST_BYTES = 64 << 20


def _manifest(root, name: str) -> Path:
    if not name or any(c not in "abcdefghijklmnopqrstuvwxyz0123456789-" for c in name):
        raise ValueError(f"{name!r} is no artifact name")
    return Path(root) / "derived" / f"{name}-manifest.json"


def get_or_build(root, name: str, inputs: str, recipe: str, build: Callable[[], object]) -> tuple[dict, bool]:
    """(manifest entry, whether it was built now)."""
    path = _manifest(root, name)
    if path.exists():
        entry = S.unseal(path)
        if (entry["inputs"], entry["recipe"]) == (inputs, recipe) and (Path(root) / entry["path"]).exists():
            load(root, name, inputs, check_mark=False)
            return entry, False
    text = S.canonical(build()) + "\n"
    digest = S.sha256(text)
    where = f"derived/artifacts/{name}/{digest}.json"
    if not (Path(root) / where).exists():
        S.write(Path(root) / where, text, MOST_BYTES)
    entry = {"name": name, "inputs": inputs, "recipe": recipe, "path": where, "content": digest, "processed": S.now()}
    S.write(path, S.seal(entry))
    return entry, True


def load(root, name: str, inputs: str | None = None, check_mark: bool = True):
    if check_mark:
        J.assert_valid(root)
    entry = S.unseal(_manifest(root, name))
    path, inside = (Path(root) / entry["path"]).resolve(), (Path(root) / "derived").resolve()
    if inside not in path.parents:
        raise S.IntegrityError(f"{name}: path leaves the store")
    if inputs is not None and entry["inputs"] != inputs:
        raise S.IntegrityError(f"{name}: made from other inputs; derive it again")
    data = path.read_bytes()
    if S.sha256(data) != entry["content"]:
        raise S.IntegrityError(f"{name}: content differs from its hash")
    return json.loads(data)
