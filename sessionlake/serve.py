"""The queries of a corpus for programs: a command line that prints JSON, JSON-RPC over lines, and read-only HTTP.

    python -m sessionlake.serve /data/corpus search "flake input"
    python -m sessionlake.serve /data/corpus rpc
    python -m sessionlake.serve /data/corpus http 127.0.0.1 8765
"""

from __future__ import annotations

import ipaddress
import json
import re
import sys
from collections.abc import Iterable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import DataFrame

from .api import Corpus, Denied

#: Rows of a table that are printed or sent at most.
ROWS = 200
PROTOCOLS = ("2025-06-18", "2025-03-26", "2024-11-05")
_TEXT, _NUMBER, _LIST = {"type": "string"}, {"type": "number", "minimum": 1, "maximum": 20}, {"type": "array", "items": {"type": "string"}}
TOOLS = {
    "search": ("Ranked turns that the policy lets see, with evidence addresses.", {"query": _TEXT, "limit": _NUMBER, "domains": _LIST}, ["query"]),
    "get_evidence": ("One turn by its address, cut to a bounded length.", {"uri": _TEXT, "domains": _LIST}, ["uri"]),
    "recent_work": ("The newest sessions of one project.", {"project": _TEXT, "limit": _NUMBER, "domains": _LIST}, ["project"]),
    "project_brief": ("Activity, outcomes and recent evidence of one project.", {"project": _TEXT, "domains": _LIST}, ["project"]),
}
#: Commands without a table of their own name that the command line offers.
COMMANDS = ("stats", "models", "tokens", "usage_time", "tools", "lengths", "projects", "sessions", "overview", "project", "project_brief", "search", "policy_search", "get", "evidence", "grok", "ask", "ask_lexical", "semantic", "refinery", "candidate", "orchestration_profile", "workflow_evolution", "workflow_summary", "workflow_outcomes", "workflow_patterns", "workflow_pattern", "explore", "insights", "validate", "derive", "ingest", "preview", "import_export", "receipts", "sources", "check", "bridge")


def plain(value):
    """DataFrames as their first ROWS rows, the rest as JSON has it."""
    if isinstance(value, DataFrame):
        return [r.asDict(True) for r in value.limit(ROWS).collect()]
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    if isinstance(value, list | tuple):
        return [plain(v) for v in value]
    return value


def dumped(value) -> str:
    return json.dumps(plain(value), ensure_ascii=False, default=str)


class Rpc:
    """One client's conversation: initialize first, then the four tools."""

    def __init__(self, corpus: Corpus):
        self.corpus, self.greeted, self.ready = corpus, False, False

    def call(self, name: str, given: dict):
        wanted = given.get("domains")
        if name == "search":
            return self.corpus.policy_search(given["query"], given.get("limit", 8), wanted)
        if name == "get_evidence":
            return self.corpus.evidence(given["uri"], wanted)
        if name == "recent_work":
            return {"project": given["project"], "sessions": plain(self.corpus.recent_work(given["project"], given.get("limit", 8)))}
        return self.corpus.project_brief(given["project"], wanted)

    def line(self, text: str) -> str | None:
        """The answer to one line, or None for a notification."""
        try:
            message = json.loads(text)
        except ValueError:
            return self.error(None, -32700, "parse error")
        if not isinstance(message, dict):
            return self.error(None, -32600, "invalid request")
        return self.message(message)

    def error(self, id_, code: int, text: str) -> str:
        return json.dumps({"jsonrpc": "2.0", "id": id_, "error": {"code": code, "message": text}})

    def message(self, m: dict) -> str | None:
        id_, method = m.get("id"), m.get("method")
        if m.get("jsonrpc") != "2.0" or not isinstance(method, str):
            return self.error(id_, -32600, "invalid request") if "id" in m else None
        if method == "notifications/initialized":
            self.ready = self.greeted
        if "id" not in m:
            return None
        answer = lambda result: json.dumps({"jsonrpc": "2.0", "id": id_, "result": result}, ensure_ascii=False, default=str)
        params = m.get("params") if isinstance(m.get("params"), dict) else {}
        if method == "initialize":
            self.greeted = True
            asked = params.get("protocolVersion")
            return answer({"protocolVersion": asked if asked in PROTOCOLS else PROTOCOLS[0], "capabilities": {"tools": {"listChanged": False}}, "serverInfo": {"name": "sessionlake", "version": "1"}})
        if method == "ping":
            return answer({})
        if not self.ready:
            return self.error(id_, -32002, "not initialized")
        if method == "tools/list":
            return answer({"tools": [{"name": n, "description": d, "inputSchema": {"type": "object", "properties": p, "required": r, "additionalProperties": False}} for n, (d, p, r) in TOOLS.items()]})
        if method != "tools/call":
            return self.error(id_, -32601, f"no method {method}")
        name, given = params.get("name"), params.get("arguments") or {}
        if name not in TOOLS:
            return self.error(id_, -32602, "unknown or missing tool name")
        try:
            if not isinstance(given, dict) or set(given) - set(TOOLS[name][1]) or any(k not in given for k in TOOLS[name][2]):
                raise ValueError("the arguments do not fit the tool")
            value, bad = self.call(name, given), False
        except Exception as e:  # noqa: BLE001 - a tool's failure is its answer
            value, bad = str(e), True
        told = {"content": [{"type": "text", "text": value if isinstance(value, str) else dumped(value)}]}
        return answer(told | ({"isError": True} if bad else {"structuredContent": plain(value)}))

    def serve(self, lines: Iterable[str], out) -> None:
        for text in lines:
            if text.strip() and (reply := self.line(text)):
                out.write(reply + "\n")
                out.flush()


def routes(corpus: Corpus, q: dict):
    one = lambda k, d=None: q.get(k, [d])[0]
    n = lambda d: int(one("limit", d))
    return {
        "/api/health": lambda: {"ready": True} | corpus.check(), "/api/overview": corpus.overview, "/api/projects": lambda: corpus.projects(n(50)),
        "/api/sessions": lambda: corpus.sessions(one("project"), one("q"), n(40)), "/api/search": lambda: corpus.search(one("q", ""), min(n(20), ROWS)),
        "/api/insights": corpus.insights, "/api/sources": lambda: corpus.sources({}), "/api/receipts": lambda: corpus.receipts(n(20)), "/api/evidence": lambda: corpus.evidence(one("uri", "")),
        "/api/patterns": lambda: corpus.explore(**{k: one(k) for k in ("query", "kind", "signal", "role", "outcome", "review", "harness", "since", "until") if one(k)}),
    }


def handler(corpus: Corpus):
    class Handler(BaseHTTPRequestHandler):
        def reply(self, code: int, value) -> None:
            body = dumped(value).encode()
            self.send_response(code)
            for k, v in {"Content-Type": "application/json; charset=utf-8", "Content-Length": str(len(body)), "X-Content-Type-Options": "nosniff", "Cache-Control": "no-store", "Content-Security-Policy": "default-src 'none'"}.items():
                self.send_header(k, v)
            self.end_headers()
            if self.command != "HEAD":
                self.wfile.write(body)

        def do_GET(self) -> None:
            url = urlsplit(self.path)
            made = routes(corpus, parse_qs(url.query)).get(url.path)
            if made is None:
                return self.reply(404, {"error": "not found"})
            try:
                self.reply(200, made())
            except LookupError as e:
                self.reply(404, {"error": str(e)})
            except ValueError as e:
                self.reply(400, {"error": str(e)})

        do_HEAD = do_GET

        def refuse(self) -> None:
            self.reply(405, {"error": "read only"})

        do_POST = do_PUT = do_DELETE = do_PATCH = refuse

        def log_message(self, *_) -> None:
            pass

    return Handler


def bind(corpus: Corpus, host: str = "127.0.0.1", port: int = 8765) -> ThreadingHTTPServer:
    """A server on a loopback address; others are refused, as answers hold private text."""
    if host != "localhost" and not ipaddress.ip_address(host).is_loopback:
        raise ValueError("only loopback addresses")
    return ThreadingHTTPServer((host, port), handler(corpus))


def command(corpus: Corpus, name: str, args: list[str]):
    """One command; arguments are texts, whole numbers, or name=value."""
    if name not in COMMANDS:
        raise ValueError(f"no command {name}")
    value = lambda x: int(x) if re.fullmatch(r"-?\d+", x) else x
    given = [value(a) for a in args if not re.match(r"[a-z_]+=", a)]
    named = {a.split("=", 1)[0]: value(a.split("=", 1)[1]) for a in args if re.match(r"[a-z_]+=", a)}
    if name in ("ingest", "sources"):
        return getattr(corpus, name)({k: str(v) for k, v in named.items()})
    return getattr(corpus, name)(*given, **named)


def main(argv: list[str] | None = None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    if len(argv) < 2:
        print(__doc__, file=sys.stderr)
        return 2
    from .session import session

    corpus = Corpus(session("sessionlake"), argv[0])
    try:
        if argv[1] == "rpc":
            Rpc(corpus).serve(sys.stdin, sys.stdout)
        elif argv[1] == "http":
            bind(corpus, *argv[2:3], *map(int, argv[3:4])).serve_forever()
        else:
            print(dumped(command(corpus, argv[1], argv[2:])))
    except (Denied, LookupError, ValueError) as e:
        print(json.dumps({"error": str(e)}), file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
