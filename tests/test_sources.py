import json
import zipfile

import pytest
from pyspark.errors import PySparkException

from sessionlake.sources import adapters as D
from sessionlake.sources import chat_export as E
from sessionlake.sources import jsonl as J


def write(path, records, tail=""):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join(json.dumps(r) + "\n" for r in records) + tail)


CLAUDE = [
    {"type": "user", "sessionId": "s1", "cwd": "/p", "timestamp": "2026-01-01T00:00:01Z", "message": {"role": "user", "content": "fix it; password=abcdefghijk"}},
    {"type": "assistant", "timestamp": "2026-01-01T00:00:02Z", "message": {"role": "assistant", "model": "m1", "usage": {"input_tokens": 3, "output_tokens": 2, "cache_read_input_tokens": 5}, "content": [{"type": "thinking", "thinking": "hm"}, {"type": "tool_use", "id": "t", "name": "Edit", "input": {"b": 1, "a": "x"}}]}},
    {"type": "user", "message": {"role": "user", "content": [{"type": "tool_result", "content": [{"type": "text", "text": "deep"}]}]}},
    {"type": "mode"},
    {"type": "system", "content": "note"},
    {"type": "result", "result": {"ok": True}},
]


def test_claude_log(spark, tmp_path):
    write(tmp_path / "proj" / "a.jsonl", CLAUDE, tail='\n{"type": "user", "mess')
    c, t = D.read(spark, str(tmp_path), "claude-code")
    c, t = c.collect(), t.orderBy("idx").collect()
    assert (c[0].id, c[0].project, c[0].model, c[0].partial_tail, c[0].n_turns) == ("s1", "/p", "m1", True, 5)
    assert (c[0].started_at, c[0].ended_at) == ("2026-01-01T00:00:01Z", "2026-01-01T00:00:02Z")
    assert [x.content for x in t] == ["fix it; password=[REDACTED_SECRET]", "hm", "deep", "note", '{"ok":true}']
    assert t[1].tokens.total == 10 and t[1].tool_calls[0].arguments == '{"b":1,"a":"x"}'


def test_header_defaults(spark, tmp_path):
    write(tmp_path / "proj" / "b.jsonl", [{"type": "mode", "timestamp": "2026-02-01T00:00:00Z"}])
    c = D.read(spark, str(tmp_path), "claude-code")[0].first()
    assert (c.id, c.resume_id, c.project, c.model, c.n_turns, c.started_at) == ("b", None, "proj", "(unknown)", 0, "2026-02-01T00:00:00Z")


@pytest.mark.parametrize("tail", ["{broken\n", '{broken\n{"type": "mode"}\n'])
def test_broken_line_is_an_error(spark, tmp_path, tail):
    write(tmp_path / "a.jsonl", CLAUDE, tail=tail)
    with pytest.raises(PySparkException, match="invalid JSON"):
        D.read(spark, str(tmp_path), "claude-code")[0].collect()


@pytest.mark.parametrize("record", [{"type": "odd"}, {"no": "type"}, [1], {"type": "user", "message": {"role": "user", "content": [{"type": "odd"}]}}])
def test_unknown_shape_is_an_error(spark, tmp_path, record):
    write(tmp_path / "a.jsonl", [*CLAUDE, record])
    with pytest.raises(PySparkException, match="unknown"):
        D.read(spark, str(tmp_path), "claude-code")[0].collect()


def test_codex_log(spark, tmp_path):
    item = lambda **p: {"type": "response_item", "payload": p}
    count = lambda n: {"type": "event_msg", "payload": {"type": "token_count", "info": {"total_token_usage": {"input_tokens": n, "output_tokens": 1, "total_tokens": n + 1}}}}
    records = [
        {"type": "session_meta", "payload": {"id": "x", "cwd": "/a", "model_provider": "prov"}}, {"type": "turn_context", "payload": {"cwd": "/b", "model": "m"}},
        item(type="message", role="user", content=[{"type": "input_text", "text": "hi"}]), count(5), item(type="function_call", call_id="c", name="exec", arguments="{}"),
        item(type="function_call_output", call_id="c", output={"k": 1}), count(9), item(type="reasoning"),
    ]
    write(tmp_path / "rollout-1.jsonl", records)
    write(tmp_path / "other.jsonl", [{"type": "odd"}])
    c, t = D.read(spark, str(tmp_path), "codex")
    assert [(x.id, x.project, x.provider, x.model, x.resume_id) for x in c.collect()] == [("x", "/b", "prov", "m", "x")]
    rows = t.orderBy("idx").collect()
    assert [(x.role, x.content) for x in rows] == [("user", "hi"), ("assistant", ""), ("tool", '{"k":1}')]
    assert [x.tokens and x.tokens.total for x in rows] == [None, 10, None]


def test_pi_log(spark, tmp_path):
    records = [
        {"type": "session", "id": "p1", "cwd": "/w"}, {"type": "model_change", "modelId": "m", "provider": "local"},
        {"type": "message", "message": {"role": "assistant", "content": [{"type": "text", "text": "go"}, {"type": "toolCall", "id": "1", "name": "read", "arguments": {"p": 1}}], "usage": {"input": 1, "totalTokens": 4}}},
        {"type": "message", "message": {"role": "toolResult", "toolCallId": "1", "toolName": "read", "content": "out"}},
    ]
    write(tmp_path / "s.jsonl", records)
    c, t = D.read(spark, str(tmp_path), "pi")
    assert [(x.id, x.provider, x.model) for x in c.collect()] == [("p1", "local", "m")]
    assert [(x.role, x.content, x.tool_calls[0].name) for x in t.orderBy("idx").collect()] == [("assistant", "go", "read"), ("tool", "out", "read")]


def test_files_in_many_splits_keep_their_order(spark, tmp_path):
    write(tmp_path / "s.jsonl", [{"type": "session", "id": "p1"}] + [{"type": "message", "message": {"role": "user", "content": str(i)}} for i in range(400)])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        assert J.lines(spark, str(tmp_path)).rdd.getNumPartitions() > 4
        c, t = D.read(spark, str(tmp_path), "pi")
        assert [x.content for x in t.orderBy("idx").collect()] == [str(i) for i in range(400)]
        assert c.first().partial_tail is False
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


EXPORT = [
    {"uuid": "u1", "name": "T", "created_at": "2026-01-01", "chat_messages": [
        {"sender": "human", "text": "fallback", "created_at": "2026-01-02", "content": [], "attachments": [{"file_name": "f", "file_type": "txt"}]},
        {"sender": "assistant", "created_at": "2026-01-03", "content": [{"type": "thinking", "text": "no"}, {"type": "text", "text": "yes"}, {"type": "tool_use", "id": "t", "name": "look", "input": {"q": 1}}]},
        {"sender": "assistant", "content": [{"type": "tool_result", "tool_use_id": "t", "content": "r1"}]},
        {"sender": "assistant", "content": [{"type": "tool_result", "tool_use_id": "t", "content": {"z": 2}}]},
    ]},
    {"uuid": "u2", "chat_messages": []},
]


@pytest.mark.parametrize("zipped", [False, True])
def test_export(spark, tmp_path, zipped):
    (tmp_path / E.MEMBER).write_text(json.dumps(EXPORT))
    path = str(tmp_path)
    if zipped:
        path = f"{tmp_path}/data.zip"
        with zipfile.ZipFile(path, "w") as z:
            z.write(tmp_path / E.MEMBER, E.MEMBER)
    c, t = E.adapt(E.items(spark, path), path, " Research ")
    heads = {x.id: x for x in c.collect()}
    assert (heads["u1"].title, heads["u1"].domain, heads["u1"].ended_at, heads["u1"].n_turns) == ("T", "research", "2026-01-03", 2)
    assert (heads["u2"].title, heads["u2"].n_turns, heads["u2"].started_at) == ("Untitled Claude conversation", 0, "1970-01-01T00:00:00.000Z")
    rows = t.orderBy("idx").collect()
    assert [x.content for x in rows] == ["fallback\n[Attachment: f · txt]", "yes"]
    assert rows[0].tool_calls is None and rows[1].tool_calls[0].arguments == '{"q":1}' and rows[1].tool_calls[0].output == '{"z":2}'
    manifest = c.where("id = 'u1'").selectExpr("source_path AS source", "content_hash AS hash", "'other' AS domain")
    p = E.preview(c, t, manifest).first()
    assert (p.conversations, p.new, p.reclassified, p.changed, p.turns) == (2, 1, 1, 0, 2)
