import json
import multiprocessing
import os

import pytest

from sessionlake.store import annotations as N
from sessionlake.store import artifacts as A
from sessionlake.store import corpus as C
from sessionlake.store import files as S
from sessionlake.store import journal as L


def test_durable_write_and_seal(tmp_path):
    p = tmp_path / "a" / "x.json"
    S.write(p, S.seal({"k": 1}))
    assert S.unseal(p) == {"k": 1} and os.stat(p).st_mode & 0o777 == 0o600 and len(list(p.parent.iterdir())) == 1
    p.write_text(p.read_text().replace('"k": 1', '"k": 2'))
    with pytest.raises(S.IntegrityError):
        S.unseal(p)
    with pytest.raises(ValueError):
        S.write(p, "xxxx", 3)


def test_lock_is_exclusive_and_taken_over_from_the_dead(tmp_path):
    p = tmp_path / "lock"
    with S.lock(p):
        with pytest.raises(S.Locked), S.lock(p):
            pass
    assert not p.exists()
    gone = multiprocessing.Process(target=int)
    gone.start()
    gone.join()
    p.write_text(json.dumps({"pid": gone.pid, "run": "x"}))
    with S.lock(p):
        assert json.loads(p.read_text())["pid"] == os.getpid()


def test_recovery_is_decided_by_the_snapshot(tmp_path):
    a, b = L.create(tmp_path, "ingest", "h0", "h1"), L.create(tmp_path, "ingest", "h1", "h2")
    done = []
    assert L.recover(tmp_path, lambda: "h1", lambda i: done.append(i["operation"])) == {"discovered": 2, "completed": 1, "aborted": 1}
    assert done == [a["operation"]] and L.pending(tmp_path) == []
    assert (tmp_path / "operations" / "aborted" / f"{b['operation']}.json").exists()
    L.create(tmp_path, "ingest", "h5", "h6")
    with pytest.raises(L.Conflict):
        L.recover(tmp_path, lambda: "h1", lambda i: None)


def test_steps_do_not_go_back(tmp_path):
    i = L.advance(tmp_path, L.create(tmp_path, "x", "a", "b"), "derived")
    with pytest.raises(ValueError):
        L.advance(tmp_path, i, "committed")


def test_receipts_newest_first(tmp_path):
    for day in (1, 3, 2):
        L.receipt(tmp_path, {"completed": f"2026-01-0{day}T00:00:00.000Z", "n": day})
    assert [r["n"] for r in L.receipts(tmp_path, 2)] == [3, 2]


def test_artifacts_are_bound_to_inputs(tmp_path):
    made = lambda: A.get_or_build(tmp_path, "report", "in", "r1", lambda: {"v": 1})
    entry, built = made()
    assert built and not made()[1] and A.load(tmp_path, "report", "in") == {"v": 1}
    with pytest.raises(S.IntegrityError):
        A.load(tmp_path, "report", "other")
    L.invalidate(tmp_path, "s", "why")
    with pytest.raises(S.IntegrityError, match="why"):
        A.load(tmp_path, "report", "in")
    L.validate(tmp_path)
    (tmp_path / entry["path"]).write_text("{}")
    with pytest.raises(S.IntegrityError):
        A.load(tmp_path, "report", "in")


def test_artifact_paths_stay_inside(tmp_path):
    A.get_or_build(tmp_path, "report", "in", "r", lambda: 1)
    p = tmp_path / "derived" / "report-manifest.json"
    (tmp_path / "out.json").write_text("1\n")
    S.write(p, S.seal(S.unseal(p) | {"path": "derived/../out.json", "content": S.sha256("1\n")}))
    with pytest.raises(S.IntegrityError, match="leaves"):
        A.load(tmp_path, "report")


P = [{"kind": "autonomy-boundary", "signal": "self-propel", "role": "manager"}]


def test_annotations(tmp_path):
    h = N.handle(**P[0])
    N.write(tmp_path, P, "s1", h, 0, "confirmed", label=" ok ")
    with pytest.raises(N.Stale):
        N.write(tmp_path, P, "s1", h, 0, "dismissed")
    with pytest.raises(N.Stale):
        N.write(tmp_path, P, "s1", h, 1, "dismissed", observed="s0")
    N.write(tmp_path, P, "s1", h, 1, "dismissed")
    chain = N.history(tmp_path, h)
    assert [r["revision"] for r in chain] == [2, 1] and chain[1]["label"] == "ok"
    assert N.view(tmp_path, P)["summary"]["dismissed"] == 1 and N.view(tmp_path, [])["inactive"] == 1
    for bad in ({"label": "a\nb"}, {"note": "\u202E"}, {"label": "x" * 121}):
        with pytest.raises(ValueError):
            N.write(tmp_path, P, "s1", h, 2, "confirmed", **bad)
    obj = next((tmp_path / "annotations" / "objects").rglob("*.json"))
    obj.write_text("{}")
    with pytest.raises(S.IntegrityError):
        N.history(tmp_path, h)


def test_rate_limit_slides():
    t = [0.0]
    limit = N.RateLimit(2, lambda: t[0])
    assert [limit.allow() for _ in range(3)] == [True, True, False]
    t[0] = 60.5
    assert limit.allow()


def _pi(path, n):
    path.parent.mkdir(parents=True, exist_ok=True)
    rows = [{"type": "session", "id": path.stem, "cwd": "/w"}] + [{"type": "message", "timestamp": f"2026-01-01T00:00:0{i}Z", "message": {"role": "user", "content": f"turn {i}"}} for i in range(n)]
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))


def test_ingest_is_incremental_and_the_last_snapshot_is_active(spark, tmp_path):
    logs, root = tmp_path / "logs", str(tmp_path / "root")
    _pi(logs / "a.jsonl", 2)
    _pi(logs / "b.jsonl", 1)
    first = C.ingest(spark, root, {"pi": str(logs)})
    assert first["harnesses"]["pi"] == {"discovered": 2, "ingested": 2, "skipped": 0} and first["changed_during_read"] == 0
    assert C.ingest(spark, root, {"pi": str(logs)})["harnesses"]["pi"]["skipped"] == 2
    _pi(logs / "a.jsonl", 4)
    assert C.ingest(spark, root, {"pi": str(logs)})["harnesses"]["pi"]["ingested"] == 1
    snap = C.check(spark, root)
    c, t = C.current(spark, root)
    assert {(r.id, r.n_turns) for r in c.collect()} == {("a", 4), ("b", 1)} and t.count() == 5
    assert spark.read.parquet(f"{root}/corpus/conversations").count() == 3
    assert [r.content for r in C.turns_view(c, t).where("id = 'a'").orderBy("idx").collect()] == [f"turn {i}" for i in range(4)]
    with pytest.raises(S.IntegrityError):
        C.assert_unchanged(root, snap | {"hash": "x"})
    S.write(C._pointer(root), S.seal(snap | {"hash": "0"}))
    with pytest.raises(S.IntegrityError):
        C.check(spark, root)


def test_import_writes_a_receipt_and_skips_unchanged(spark, tmp_path):
    export, root = tmp_path / "export", str(tmp_path / "root")
    export.mkdir()
    (export / "conversations.json").write_text(json.dumps([{"uuid": "u", "chat_messages": [{"sender": "human", "text": "hi"}]}]))
    assert C.preview_export(spark, root, str(export))["new"] == 1
    assert C.import_export(spark, root, str(export))["new"] == 1
    assert C.import_export(spark, root, str(export))["unchanged"] == 1
    assert C.preview_export(spark, root, str(export), "research")["reclassified"] + C.preview_export(spark, root, str(export), "research")["changed"] == 1
    assert [r["counts"]["new"] for r in L.receipts(root)] == [1]
