"""Session logs of three harnesses as canonical conversations and turns.

Each line becomes at most one turn and some header values, in Arrow batches: content blocks nest
freely, so their types are only known line by line.  All that depends on the order of lines (the
last header value wins, cumulative usage goes to the last assistant turn, turn numbers) is
aggregates and windows over (path, key).  Secrets are redacted in every text before hashing.

Defined cases: blank lines are skipped; an unknown record, block or shape is an error that names
the file; a file without turns is a conversation without turns.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from . import jsonl as J

# ---- fixed values: record and block types of the three log formats ----

CLAUDE_RECORDS = "assistant user system attachment file-history-snapshot file-history-delta queue-operation mode permission-mode bridge-session custom-title ai-title last-prompt agent-name agent-setting frame-link pr-link started result".split()
CLAUDE_BLOCKS = "text thinking redacted_thinking tool_use tool_result tool_reference advisor_tool_result fallback image document server_tool_use web_search_tool_result web_fetch_tool_result".split()
CODEX_RECORDS = "session_meta turn_context response_item event_msg compacted world_state inter_agent_communication_metadata".split()
CODEX_ITEMS = "message agent_message reasoning function_call function_call_output custom_tool_call custom_tool_call_output web_search_call local_shell_call computer_call".split()
CODEX_BLOCKS = "input_text output_text text encrypted_content input_image image computer_initialize_state computer_screenshot".split()
PI_RECORDS = "session session_info model_change thinking_level_change message compaction branch_summary custom".split()
PI_BLOCKS = "text thinking toolCall toolResult image".split()

# ---- end of fixed values ----

UNKNOWN = "(unknown)"
CALLS = "array<struct<id:string,name:string,arguments:string,output:string>>"
TOKENS = "struct<input:bigint,output:bigint,cached_input:bigint,cache_write:bigint,reasoning:bigint,total:bigint>"
_LINE = f"path string, size bigint, mtime_ms bigint, key struct<block:bigint,seq:bigint>, octets bigint, broken boolean, error string, id string, resume_id string, cwd string, model string, provider string, stamp string, usage {TOKENS}, is_turn boolean, role string, content string, at string, tool_calls {CALLS}, tokens {TOKENS}"
_COUNTERS = ("input", "output", "cached_input", "cache_write", "reasoning", "total")


def _text(value) -> str | None:
    return value if isinstance(value, str) else None


def _said(value) -> str:
    """How a log's own value reads as text."""
    return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def _first(*values):
    return next((v for v in values if v is not None), None)


def flatten(content, allowed) -> str:
    """Text of a string, or of blocks (text, thinking, content; nested too), by lines."""
    if isinstance(content, str):
        return content
    if content is None:
        return ""
    if not isinstance(content, list):
        raise ValueError("unknown content shape")
    parts = []
    for block in content:
        if isinstance(block, str):
            parts.append(block)
            continue
        kind = block.get("type") if isinstance(block, dict) else None
        if not isinstance(kind, str) or kind not in allowed:
            raise ValueError(f"unknown content block type {json.dumps(kind)}")
        held = next((block[k] for k in ("text", "thinking", "content") if isinstance(block.get(k), str)), None)
        if held is None and isinstance(block.get("content"), list):
            held = flatten(block["content"], allowed)
        parts.append(held)
    return "\n".join(p for p in parts if p)


def _count(usage: dict, **names) -> dict:
    return {k: int(float(usage.get(v) or 0)) for k, v in names.items()}


def _call(name, id=None, arguments=None) -> dict:
    return {"id": _text(id), "name": _said(name), "arguments": arguments, "output": None}


def _turn(rec: dict, role: str, content: str, calls=None, tokens=None) -> dict:
    return {"is_turn": True, "role": role, "content": content, "at": _text(rec.get("timestamp")), "tool_calls": calls or None, "tokens": tokens}


def claude(rec: dict) -> dict:
    if rec["type"] not in CLAUDE_RECORDS:
        raise ValueError(f"unknown record type {rec['type']}")
    session = _text(rec.get("sessionId"))
    row = {"id": session, "resume_id": session, "cwd": _text(rec.get("cwd")), "stamp": _text(rec.get("timestamp"))}
    if rec["type"] in ("assistant", "user"):
        said = rec.get("message")
        if not isinstance(said, dict) or not isinstance(said.get("role"), str):
            raise ValueError("malformed message")
        row["model"] = _text(said.get("model"))
        blocks = said.get("content") if isinstance(said.get("content"), list) else []
        used = [b for b in blocks if isinstance(b, dict) and b.get("type") in ("tool_use", "server_tool_use")]
        calls = [_call(_first(b.get("name"), b["type"]), b.get("id"), _said(_first(b.get("input"), {}))) for b in used]
        tokens = None
        if said.get("usage"):
            tokens = _count(said["usage"], input="input_tokens", output="output_tokens", cached_input="cache_read_input_tokens", cache_write="cache_creation_input_tokens")
            tokens["total"] = sum(tokens.values())
        row |= _turn(rec, said["role"], flatten(said.get("content"), CLAUDE_BLOCKS), calls, tokens)
    elif rec["type"] == "system" and isinstance(rec.get("content"), str):
        row |= _turn(rec, "system", rec["content"])
    elif rec["type"] == "result":
        row |= _turn(rec, "assistant", json.dumps(_first(rec.get("result"), {}), ensure_ascii=False, separators=(",", ":")))
    return row


def codex(rec: dict) -> dict:
    if rec["type"] not in CODEX_RECORDS:
        raise ValueError(f"unknown record type {rec['type']}")
    held = rec.get("payload")
    if not isinstance(held, (dict, list)):
        raise ValueError("payload missing")
    held = held if isinstance(held, dict) else {}
    row, kind = {"stamp": _text(rec.get("timestamp"))}, held.get("type")
    if rec["type"] == "session_meta":
        given = _first(held.get("id"), held.get("session_id"))
        provider = held.get("model_provider")
        return row | {"id": None if given is None else _said(given), "cwd": _said(_first(held.get("cwd"), "")), "provider": None if provider is None else _said(provider)}
    if rec["type"] == "turn_context":
        return row | {"cwd": _text(held.get("cwd")), "model": _text(held.get("model"))}
    if rec["type"] == "event_msg":
        info = held.get("info")
        total = info.get("total_token_usage") if kind == "token_count" and isinstance(info, dict) else None
        if total:
            row["usage"] = _count(total, input="input_tokens", output="output_tokens", cached_input="cached_input_tokens", reasoning="reasoning_output_tokens", total="total_tokens")
        return row
    if rec["type"] != "response_item":
        return row
    if kind not in CODEX_ITEMS:
        raise ValueError(f"unknown response item {json.dumps(kind)}")
    if kind in ("message", "agent_message"):
        return row | _turn(rec, _said(_first(held.get("role"), held.get("author"), "assistant")), flatten(held.get("content"), CODEX_BLOCKS))
    if kind in ("function_call", "custom_tool_call"):
        call = _call(_first(held.get("name"), kind), _first(held.get("call_id"), held.get("id")), _said(_first(held.get("arguments"), held.get("input"), "")))
        return row | _turn(rec, "assistant", "", [call])
    if kind in ("function_call_output", "custom_tool_call_output"):
        return row | _turn(rec, "tool", _said(_first(held.get("output"), "")), [_call("tool_result", held.get("call_id"))])
    return row


def pi(rec: dict) -> dict:
    if rec["type"] not in PI_RECORDS:
        raise ValueError(f"unknown record type {rec['type']}")
    row = {"stamp": _text(rec.get("timestamp"))}
    named = lambda key: None if rec.get(key) is None else _said(rec[key])
    if rec["type"] == "session":
        return row | {"id": named("id"), "cwd": _said(_first(rec.get("cwd"), ""))}
    if rec["type"] == "model_change":
        return row | {"model": named("modelId"), "provider": named("provider")}
    if rec["type"] != "message":
        return row
    said = rec.get("message")
    if not isinstance(said, dict) or not isinstance(said.get("role"), str):
        raise ValueError("malformed message")
    result = said["role"] == "toolResult"
    blocks = said.get("content") if isinstance(said.get("content"), list) else []
    calls = [_call(_first(b.get("name"), "tool"), b.get("id"), json.dumps(_first(b.get("arguments"), {}), ensure_ascii=False, separators=(",", ":"))) for b in blocks if isinstance(b, dict) and b.get("type") == "toolCall"]
    if result:
        calls.append(_call(_first(said.get("toolName"), "tool_result"), said.get("toolCallId")))
    tokens = _count(said["usage"], input="input", output="output", cached_input="cacheRead", cache_write="cacheWrite", reasoning="reasoning", total="totalTokens") if said.get("usage") else None
    return row | {"model": _text(said.get("model")), "provider": _text(said.get("provider"))} | _turn(rec, "tool" if result else said["role"], flatten(said.get("content"), PI_BLOCKS), calls, tokens)


@dataclass(frozen=True)
class Adapter:
    """A harness: its parser of one record, file names, and header values where the log has none."""

    harness: str
    parse: Callable[[dict], dict]
    provider: str
    pattern: str = "*.jsonl"
    cwd_from_path: bool = False
    resume_is_id: bool = True


ADAPTERS = {
    "claude-code": Adapter("claude-code", claude, "anthropic", cwd_from_path=True, resume_is_id=False),
    "codex": Adapter("codex", codex, "openai", pattern="rollout-*.jsonl"),
    "pi": Adapter("pi", pi, UNKNOWN),
}


def _parse(adapter: Adapter, schema: pa.Schema):
    def one(value: str) -> dict:
        if not value.strip():
            return {}
        try:
            rec = json.loads(value)
        except ValueError:
            return {"broken": True}
        try:
            if not isinstance(rec, dict) or not isinstance(rec.get("type"), str):
                raise ValueError("unknown record shape (object with string type required)")
            return adapter.parse(rec)
        except (ValueError, TypeError, AttributeError) as e:
            return {"error": str(e)}

    def run(batches):
        for b in batches:
            rows = [
                {"path": r["path"], "size": r["size"], "mtime_ms": r["mtime_ms"], "key": r["key"], "octets": len(r["value"].encode("utf-8", "surrogatepass")) + 1, "broken": False, "is_turn": False} | one(r["value"])
                for r in b.to_pylist()
            ]
            yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def parsed(lines: DataFrame, adapter: Adapter) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    kind = _parse_datatype_string(_LINE)
    assert isinstance(kind, StructType)
    return lines.select("path", "size", "mtime_ms", "key", "value").mapInArrow(_parse(adapter, to_arrow_schema(kind)), _LINE)


def _last(column: str) -> Column:
    return F.max_by(column, F.when(F.col(column).isNotNull(), F.col("key"))).alias(column)


def _iso(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def headers(rows: DataFrame, adapter: Adapter, root: str = "") -> DataFrame:
    """One row per file: header values, partial_tail; an error where a line breaks the format."""
    at = F.when(F.col("is_turn") & (F.col("at") != ""), F.col("at"))
    g = rows.groupBy("path").agg(
        F.first("size").alias("size"), F.first("mtime_ms").alias("mtime_ms"), F.sum("octets").alias("octets"),
        *(_last(c) for c in ("id", "resume_id", "cwd", "model", "provider", "stamp", "usage")),
        F.min(at).alias("began"), F.max(at).alias("ended"),
        F.max("key").alias("last_key"), F.min(F.when(F.col("broken"), F.col("key"))).alias("first_broken"),
        F.min_by("error", F.when(F.col("error").isNotNull(), F.col("key"))).alias("error"),
    )
    partial = F.col("first_broken").isNotNull() & F.col("first_broken").eqNullSafe(F.col("last_key")) & J.unended(F.col("size"), F.col("octets"))
    fault = F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("first_broken").isNotNull() & ~partial, "invalid JSON before the unfinished last line")
    name = F.regexp_extract("path", r"([^/]+?)(\.jsonl)?$", 1)
    cwd = F.nullif(F.col("cwd"), F.lit(""))
    if adapter.cwd_from_path:
        inside = F.when(F.col("path").startswith(root), F.regexp_replace(F.substring(F.col("path"), len(root) + 1, 1 << 20), "^/+", "")).otherwise(F.col("path"))
        cwd = F.coalesce(cwd, F.split(inside, "/")[0])
    cwd, found = F.coalesce(cwd, F.lit("")), F.coalesce("id", name)
    none = lambda c, other: F.coalesce(F.nullif(c, F.lit("")), F.lit(other))
    fallback = F.coalesce("stamp", _iso(F.col("mtime_ms")))
    safe = F.when(fault.isNotNull(), F.raise_error(F.concat("path", F.lit(": "), fault)).cast("string")).otherwise(F.col("path"))
    return g.select(
        safe.alias("source_path"), "size", "mtime_ms", found.alias("id"), (found if adapter.resume_is_id else F.col("resume_id")).alias("resume_id"),
        F.lit(adapter.harness).alias("harness"), F.coalesce("provider", F.lit(adapter.provider)).alias("provider"),
        X.redact(none(cwd, UNKNOWN)).alias("project"), X.redact(cwd).alias("cwd"), X.redact(none(F.col("model"), UNKNOWN)).alias("model"),
        F.coalesce("began", fallback).alias("started_at"), F.coalesce("ended", fallback).alias("ended_at"), partial.alias("partial_tail"), "usage",
    )


def clean_calls(calls: Column) -> Column:
    return F.transform(calls, lambda c: F.struct(c["id"].alias("id"), X.redact(c["name"]).alias("name"), X.redact(c["arguments"]).alias("arguments"), X.redact(c["output"]).alias("output")))


def turns(rows: DataFrame) -> DataFrame:
    """source_path, idx, role, content, at, tool_calls, tokens; cumulative usage is not attached yet."""
    w = Window.partitionBy("path").orderBy("key")
    t = rows.where("is_turn").withColumn("idx", (F.row_number().over(w) - 1).cast("bigint"))
    return t.select(F.col("path").alias("source_path"), "idx", "role", X.redact(F.col("content")).alias("content"), "at", clean_calls(F.col("tool_calls")).alias("tool_calls"), "tokens")


def with_usage(turns: DataFrame, headers: DataFrame) -> DataFrame:
    """Cumulative usage of a file on its last assistant turn, else on its last turn."""
    mark = turns.groupBy("source_path").agg(F.coalesce(F.max(F.when(F.col("role") == "assistant", F.col("idx"))), F.max("idx")).alias("idx"))
    held = headers.where("usage IS NOT NULL").select("source_path", "usage").join(mark, "source_path")
    return turns.join(held, ["source_path", "idx"], "left").withColumn("tokens", F.coalesce("usage", "tokens")).drop("usage")


def with_hash(conversations: DataFrame, turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Content hash of each conversation over its header and the hashes of its turns, on both tables."""
    one = F.sha2(F.to_json(F.struct("idx", "role", "content", "at", "tool_calls", "tokens")), 256)
    g = turns.select("source_path", F.struct("idx", one.alias("h")).alias("t")).groupBy("source_path").agg(F.array_sort(F.collect_list("t")).alias("t"), F.count("*").alias("n_turns"))
    head = [c for c in conversations.columns if c not in ("size", "mtime_ms", "partial_tail")]
    c = conversations.join(g, "source_path", "left").withColumn("n_turns", F.coalesce("n_turns", F.lit(0)))
    digest = F.sha2(F.concat(F.to_json(F.struct(*head)), F.coalesce(F.array_join(F.col("t.h"), ","), F.lit(""))), 256)
    c = c.withColumn("content_hash", digest).drop("t")
    return c, turns.join(c.select("source_path", "content_hash"), "source_path")


def adapt(lines: DataFrame, harness: str, root: str = "") -> tuple[DataFrame, DataFrame]:
    """(conversations, turns) of a harness's log lines."""
    adapter = ADAPTERS[harness]
    rows = parsed(lines, adapter)
    h, t = headers(rows, adapter, root), turns(rows)
    return with_hash(h.drop("usage"), with_usage(t, h))


def read(spark: SparkSession, root: str, harness: str) -> tuple[DataFrame, DataFrame]:
    """(conversations, turns) of all logs below a folder."""
    return adapt(J.lines(spark, root, ADAPTERS[harness].pattern), harness, root)
