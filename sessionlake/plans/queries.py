"""Named queries over the driver's tables, each with an independent DuckDB statement of the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import rules as R
from ..functions import text as X
from ..operators import active as A
from ..operators import derive as D
from ..operators import explorer as E
from ..operators import labels as L
from ..operators import outcomes as N
from ..operators import patterns as P
from ..operators import rollups as U
from ..operators import refinery as Y
from ..operators import roles as G
from ..operators import search as S
from ..operators import workflow as W
from ..sources import driver as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_LIST = "[" + ", ".join(map(_q, V.PHRASES)) + "]"
_COUNTED = "role = 'assistant' AND (conv_id + turn) % 11 <> 0"
_PHRASE = f"{_LIST}[(CASE WHEN conv_id % 6 IN (0, 3) THEN (conv_id // 6) * 5 + turn * 3 ELSE conv_id * 7 + turn * 3 END) % {len(V.PHRASES)} + 1]"
_T = f"""WITH t AS (SELECT conv_id, turn AS idx, role, CASE WHEN conv_id % 6 IN (0, 3) THEN {_PHRASE} ELSE text || ' ' || {_PHRASE} END AS content,
 ['claude-code', 'codex', 'pi'][conv_id % 3 + 1] AS harness, ['anthropic', 'openai', 'local'][conv_id % 3 + 1] AS provider,
 '/project-' || (CASE WHEN conv_id % 6 IN (0, 3) AND conv_id // 6 % 2 = 0 THEN conv_id // 6 % 7 WHEN conv_id % 6 IN (1, 2, 5) THEN 3 ELSE conv_id % 7 END) AS project, 'model-' || (conv_id % 4) AS model, ['coding', 'personal', '', 'research', 'coding'][conv_id % 5 + 1] AS domain,
 1704067200 + CASE WHEN conv_id % 6 = 3 THEN (conv_id - 3) * 25200 + 7200 ELSE conv_id * 25200 END + turn * 300 AS at_s, CASE WHEN conv_id % 6 IN (0, 3) THEN 'r' || (conv_id // 6) END AS resume_id,
 CASE WHEN {_COUNTED} THEN length(text) * 2 + conv_id % 50 END AS t_in,
 CASE WHEN {_COUNTED} THEN length(text) + turn END AS t_out,
 CASE WHEN {_COUNTED} THEN (length(text) * 3) % 97 END AS t_cached,
 CASE WHEN {_COUNTED} AND conv_id % 3 = 0 THEN length(text) % 53 END AS t_write,
 CASE WHEN {_COUNTED} AND conv_id % 4 <> 0 THEN length(text) * 3 + conv_id % 50 + turn + (length(text) * 3) % 97 END AS t_total,
 CASE WHEN role = 'assistant' AND (conv_id * 31 + turn) % 6 <> 5 THEN ['exec', 'edit', 'read', 'websearch', 'browser', ''][(conv_id * 31 + turn) % 6 + 1] END AS tool
 FROM conversations)"""
_S = _T + """, s AS (SELECT conv_id, harness, provider, project, model, domain, count(*) AS turns, min(at_s) AS started, max(at_s) AS ended,
 coalesce(sum(t_in), 0) AS t_in, coalesce(sum(t_out), 0) AS t_out, coalesce(sum(t_cached), 0) AS t_cached, coalesce(sum(t_write), 0) AS t_write, coalesce(sum(t_total), 0) AS t_total FROM t GROUP BY ALL),
 u AS (SELECT *, CASE WHEN harness = 'codex' THEN greatest(t_in - t_cached, 0) + t_out ELSE t_in + t_out END AS un FROM s)"""
_SUMS = """count(*) AS sessions, sum(turns)::BIGINT AS turns, sum(t_in)::BIGINT AS input_tokens, sum(t_out)::BIGINT AS output_tokens, sum(un)::BIGINT AS non_cached_tokens,
 sum(t_cached)::BIGINT AS cache_read_tokens, sum(t_write)::BIGINT AS cache_write_tokens, sum(t_cached + t_write)::BIGINT AS cached_tokens, sum(t_total)::BIGINT AS reported_total_tokens"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- rollups


@query(f"{_S} SELECT provider, harness, {_SUMS} FROM u GROUP BY ALL")
def token_usage(spark, sf):
    return U.usage(V.turns(spark, sf), "provider", "harness")


@query(f"{_S} SELECT strftime(make_timestamp(started * 1000000), '%Y-%m') AS period, harness, model, {_SUMS} FROM u GROUP BY ALL")
def usage_by_month(spark, sf):
    return U.usage(V.turns(spark, sf), U.period("yyyy-MM"), "harness", "model")


@query(f"{_S} SELECT strftime(make_timestamp(started * 1000000), '%Y-%m-%d') AS period, harness, model, {_SUMS} FROM u GROUP BY ALL")
def usage_by_day(spark, sf):
    return U.usage(V.turns(spark, sf), U.period("yyyy-MM-dd"), "harness", "model")


@query(f"{_S} SELECT project, harness, model, {_SUMS} FROM u GROUP BY ALL ORDER BY sessions DESC, reported_total_tokens DESC, project, harness, model LIMIT 30")
def model_usage(spark, sf):
    return U.top(U.usage(V.turns(spark, sf), "project", "harness", "model"), 30, F.desc("sessions"), F.desc("reported_total_tokens"), F.col("project"), F.col("harness"), F.col("model"))


@query(f"{_S} SELECT project, provider, harness, {_SUMS} FROM u GROUP BY ALL ORDER BY sessions DESC, reported_total_tokens DESC, project, provider, harness LIMIT 30")
def project_stats(spark, sf):
    return U.top(U.usage(V.turns(spark, sf), "project", "provider", "harness"), 30, F.desc("sessions"), F.desc("reported_total_tokens"), F.col("project"), F.col("provider"), F.col("harness"))


@query(f"{_T} SELECT harness, tool, count(*) AS calls, count(DISTINCT conv_id) AS sessions FROM t WHERE tool IS NOT NULL AND role = 'assistant' GROUP BY ALL")
def tool_frequency(spark, sf):
    return U.tools(V.turns(spark, sf), "harness")


@query(f"{_T} SELECT tool, count(*) AS calls, count(DISTINCT conv_id) AS sessions FROM t WHERE tool IS NOT NULL GROUP BY ALL")
def tool_frequency_all_roles(spark, sf):
    return U.tools(V.turns(spark, sf), assistant_only=False)


@query(f"""{_S}, n AS (SELECT CASE WHEN conv_id % 13 = 5 THEN 0 WHEN conv_id % 29 = 1 THEN turns * 400 WHEN conv_id % 11 = 2 THEN turns * 60 WHEN conv_id % 5 = 3 THEN turns * 20 WHEN conv_id % 7 = 4 THEN turns * 8 ELSE turns END AS turns FROM s)
 SELECT CASE WHEN turns = 0 THEN '0' WHEN turns <= 10 THEN '1-10' WHEN turns <= 50 THEN '11-50' WHEN turns <= 200 THEN '51-200' WHEN turns <= 1000 THEN '201-1000' ELSE '1001+' END AS bucket, count(*) AS sessions, floor(avg(turns) * 10 + 0.5) / 10 AS average, min(turns) AS least, max(turns) AS most FROM n GROUP BY 1""")
def session_lengths(spark, sf):
    """The table's conversations are short, so fixed multiples of their turns reach every bucket."""
    c, n = F.col("conv_id"), F.col("turns")
    long = F.when(c % 13 == 5, 0).when(c % 29 == 1, n * 400).when(c % 11 == 2, n * 60).when(c % 5 == 3, n * 20).when(c % 7 == 4, n * 8).otherwise(n)
    return U.lengths(U.sessions(V.turns(spark, sf)).withColumn("turns", long))


@query(f"{_S} SELECT count(*) AS sessions, count(DISTINCT project) AS projects, sum(turns)::BIGINT AS turns, min(started) AS first, max(ended) AS last, sum(t_in)::BIGINT AS input_tokens FROM s")
def overview_totals(spark, sf):
    return U.overview(V.turns(spark, sf))


@query(f"{_S} SELECT model, {_SUMS} FROM u WHERE project = '/project-3' GROUP BY ALL")
def project_models(spark, sf):
    return U.usage(V.turns(spark, sf).where("project = '/project-3'"), "model")


@query(f"{_T} SELECT tool, count(*) AS calls, count(DISTINCT conv_id) AS sessions FROM t WHERE tool IS NOT NULL AND role = 'assistant' AND project = '/project-3' GROUP BY ALL ORDER BY calls DESC, tool LIMIT 20")
def project_tools(spark, sf):
    return U.top(U.tools(V.turns(spark, sf).where("project = '/project-3'")), 20, F.desc("calls"), F.col("tool"))


@query(f"{_S} SELECT project, count(*) AS sessions, sum(turns)::BIGINT AS turns, min(started) AS first, max(ended) AS last FROM s GROUP BY ALL")
def project_list(spark, sf):
    return U.sessions(V.turns(spark, sf)).groupBy("project").agg(F.count("*").alias("sessions"), F.sum("turns").alias("turns"), F.min("started").alias("first"), F.max("ended").alias("last"))


@query(f"{_S} SELECT conv_id, project, harness, turns, ended FROM s ORDER BY ended DESC, conv_id LIMIT 20")
def recent_work(spark, sf):
    return U.top(U.sessions(V.turns(spark, sf)).select("conv_id", "project", "harness", "turns", "ended"), 20, F.desc("ended"), F.col("conv_id"))


@query(f"{_S} SELECT conv_id, project, model, turns FROM s WHERE contains(project, '-3') OR contains(model, '-3') ORDER BY ended DESC, conv_id LIMIT 40")
def session_list(spark, sf):
    s = U.sessions(V.turns(spark, sf)).where(F.col("project").contains("-3") | F.col("model").contains("-3"))
    return s.orderBy(F.desc("ended"), "conv_id").limit(40).select("conv_id", "project", "model", "turns")


# ---------------------------------------------------------------- active projection

_A = """, live AS (SELECT DISTINCT 'src/' || conv_id AS source, 'h' || conv_id || 'v1' AS hash, conv_id FROM conversations),
 snap AS (SELECT *, true AS active FROM live UNION ALL SELECT source, 'h' || conv_id || 'v0', conv_id, false FROM live WHERE conv_id % 10 = 0)"""


@query(f"{_T}{_A} SELECT source, hash, conv_id FROM snap WHERE (source, hash) IN (SELECT (source, hash) FROM live)")
def active_semi_join(spark, sf):
    snap = V.snapshots(V.turns(spark, sf))
    return A.current(snap, snap.where("active"), "source", "hash").select("source", "hash", "conv_id")


@query(f"{_T}{_A} SELECT source, hash FROM snap WHERE NOT active")
def stale_anti_join(spark, sf):
    snap = V.snapshots(V.turns(spark, sf)).select("source", "hash", "active")
    return A.missing(snap, snap.where("active"), "source", "hash").select("source", "hash")


@query(f"""{_T}{_A}, b AS (SELECT source, CASE WHEN conv_id % 10 = 0 THEN 'h' || conv_id || 'v0' ELSE hash END AS hash FROM live WHERE conv_id % 13 <> 0), a AS (SELECT source, hash FROM live WHERE conv_id % 17 <> 0)
 SELECT coalesce(a.source, b.source) AS source, b.hash AS before, a.hash AS after, CASE WHEN b.hash IS NULL THEN 'added' WHEN a.hash IS NULL THEN 'removed' ELSE 'changed' END AS change
 FROM b FULL JOIN a ON a.source = b.source WHERE a.hash IS DISTINCT FROM b.hash""")
def manifest_full_diff(spark, sf):
    live = V.snapshots(V.turns(spark, sf)).where("active")
    old = F.when(F.col("conv_id") % 10 == 0, F.concat(F.lit("h"), F.col("conv_id").cast("string"), F.lit("v0"))).otherwise(F.col("hash"))
    return A.difference(live.where("conv_id % 13 != 0").select("source", old.alias("hash")), live.where("conv_id % 17 != 0").select("source", "hash")).select("source", "before", "after", "change")


@query(f"""{_S}{_A}, p AS (SELECT live.*, domain FROM live JOIN s USING (conv_id)), m AS (SELECT source, CASE WHEN conv_id % 10 = 0 THEN 'old' ELSE hash END AS old, CASE WHEN conv_id % 9 = 0 THEN 'other' ELSE domain END AS od FROM p WHERE conv_id % 13 <> 0),
 c AS (SELECT CASE WHEN m.old IS NULL THEN 'new' WHEN m.old = p.hash THEN CASE WHEN p.domain = m.od THEN 'unchanged' ELSE 'reclassified' END ELSE 'changed' END AS class FROM p LEFT JOIN m ON p.source = m.source)
 SELECT class, count(*) AS n FROM c GROUP BY ALL""")
def preview_classification(spark, sf):
    t = V.turns(spark, sf)
    p = V.snapshots(t).where("active").join(U.sessions(t).select("conv_id", "domain"), "conv_id")
    m = p.where("conv_id % 13 != 0").select("source", F.when(F.col("conv_id") % 10 == 0, "old").otherwise(F.col("hash")).alias("hash"), F.when(F.col("conv_id") % 9 == 0, "other").otherwise(F.col("domain")).alias("domain"))
    return A.classified(p.select("source", "hash", "domain"), m).groupBy("class").agg(F.count("*").alias("n"))


@query(f"{_T}{_A} SELECT count(*) AS rows, count(DISTINCT hash) AS hashes FROM live")
def coverage_guard(spark, sf):
    live = V.snapshots(V.turns(spark, sf)).where("active")
    n = live.select("hash").distinct().count()
    return A.guarded(live, "hash", n).agg(F.count("*").alias("rows"), F.countDistinct("hash").alias("hashes"))


# ---------------------------------------------------------------- redaction and derived structure


def _redacted(column: str) -> str:
    for pattern, marker in R.REDACTIONS:
        column = f"regexp_replace({column}, {_q(pattern)}, {_q(marker.replace('$1', chr(92) + '1'))}, 'g')"
    return column


def _m(pattern: str, column: str = "content") -> str:
    return f"regexp_matches({column}, {_q(pattern)})"


_SPACES = r"[\t\n\v\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"
_CLEAN = f"regexp_replace(regexp_replace({_redacted('content')}, '{_SPACES}', ' ', 'g'), '^ | $', '', 'g')"


@query(f"{_T} SELECT conv_id, idx, sha256({_redacted('content')}) AS digest FROM t")
def redacted_turns(spark, sf):
    return V.turns(spark, sf).select("conv_id", "idx", F.sha2(X.redact(F.col("content")), 256).alias("digest"))


@query(f"{_T} SELECT harness, count(*) AS turns, count(*) FILTER (WHERE {_redacted('content')} <> content) AS redacted FROM t GROUP BY ALL")
def redact_counts(spark, sf):
    return V.turns(spark, sf).groupBy("harness").agg(F.count("*").alias("turns"), F.count_if(X.redact(F.col("content")) != F.col("content")).alias("redacted"))


@query(f"SELECT doc_id, sha256({_redacted('text')}) AS digest FROM documents".replace("content", "text"))
def redacted_documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.sha2(X.redact(F.col("text")), 256).alias("digest"))


_SIGNAL = f"CASE WHEN {_m(R.STRONG_SUCCESS)} THEN 'success' WHEN {_m(R.FAILURE)} AND NOT {_m(R.SUCCESS)} THEN 'failure' WHEN {_m(R.SUCCESS)} AND NOT {_m(R.FAILURE)} THEN 'success' ELSE 'unknown' END"
_D = f"""{_T}, a AS (SELECT *, coalesce(lag(tool IS NOT NULL) OVER (PARTITION BY conv_id ORDER BY idx), false) AS after_tool, {_SIGNAL} AS signal FROM t),
 d AS (SELECT *, role = 'user' AND NOT after_tool AND {_m(R.PROBLEM)} AS problem, role IN ('assistant', 'system') AND {_m(R.DECISION)} AS decision,
 (role IN ('assistant', 'tool') OR after_tool) AND {_m(R.GATE)} AS gate, CASE WHEN regexp_matches(content, '(?i)\\bexit(?:ed)?(?: code)?\\s*[:=]?\\s*0\\b') AND signal <> 'failure' THEN 'success' ELSE signal END AS result FROM a)"""
_CATS = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {_m(p)} THEN {_q(n)} END" for n, p in R.PROBLEM_CATEGORIES) + "], lambda x: x IS NOT NULL), '|')"


@query(f"{_D}, k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY idx DESC) AS k FROM d WHERE problem) SELECT conv_id, idx, CASE WHEN length({_CLEAN}) > 220 THEN substr({_CLEAN}, 1, 219) || '…' ELSE {_CLEAN} END AS snippet, {_CATS} AS categories FROM k WHERE k <= 40")
def problem_turns(spark, sf):
    return D.problems(V.turns(spark, sf))


@query(f"{_D}, c AS (SELECT project, conv_id, unnest(string_split({_CATS}, '|')) AS category FROM d WHERE problem) SELECT project, category, count(*) AS occurrences, count(DISTINCT conv_id) AS sessions FROM c WHERE category <> '' GROUP BY ALL")
def problem_categories(spark, sf):
    t = D.marked(V.turns(spark, sf)).where("problem").select("project", "conv_id", F.explode(X.categories(F.col("content"))).alias("category"))
    return t.groupBy("project", "category").agg(F.count("*").alias("occurrences"), F.countDistinct("conv_id").alias("sessions"))


@query(f"{_D} SELECT conv_id, idx FROM d WHERE decision")
def decision_turns(spark, sf):
    return D.marked(V.turns(spark, sf)).where("decision").select("conv_id", "idx")


@query(f"{_D} SELECT result, count(*) AS gates, count(DISTINCT conv_id) AS sessions FROM d WHERE gate AND result <> 'unknown' GROUP BY ALL")
def gate_results(spark, sf):
    return D.gates(V.turns(spark, sf)).groupBy("result").agg(F.count("*").alias("gates"), F.countDistinct("conv_id").alias("sessions"))


@query(f"{_D}, n AS (SELECT *, lead(signal) OVER (PARTITION BY conv_id ORDER BY idx) AS nx FROM d) SELECT tool, coalesce(nx, 'unknown') AS outcome, count(*) AS attempts FROM n WHERE role = 'assistant' AND tool IS NOT NULL GROUP BY ALL")
def attempt_outcomes(spark, sf):
    return D.attempts(V.turns(spark, sf)).groupBy("tool", "outcome").agg(F.count("*").alias("attempts"))


_OUT = f"""{_D}, e AS (SELECT conv_id, max(idx) FILTER (WHERE (role = 'assistant' AND signal = 'success') OR (gate AND result = 'success')) AS good, max(idx) FILTER (WHERE (role = 'assistant' AND signal = 'failure') OR (gate AND result = 'failure')) AS bad FROM d GROUP BY ALL),
 o AS (SELECT conv_id, CASE WHEN good IS NOT NULL AND bad IS NOT NULL AND abs(good - bad) <= 5 THEN 'mixed' WHEN good IS NULL AND bad IS NULL THEN 'unknown' WHEN bad IS NULL OR good > bad THEN 'success' ELSE 'failure' END AS status FROM e)"""


@query(f"{_OUT} SELECT conv_id, status FROM o")
def conversation_outcome(spark, sf):
    return D.outcomes(V.turns(spark, sf))


@query(f"{_OUT} SELECT status, count(*) AS sessions FROM o GROUP BY ALL")
def outcome_histogram(spark, sf):
    return D.outcomes(V.turns(spark, sf)).groupBy("status").agg(F.count("*").alias("sessions"))


_STOP = "[" + ", ".join(map(_q, R.STOP_WORDS)) + "]"


@query(f"""{_T}, w AS (SELECT conv_id, idx, list_filter(regexp_extract_all(lower(content), '[a-z][a-z0-9_-]{{3,}}'), lambda x: NOT list_contains({_STOP}, x)) AS l FROM t),
 p AS (SELECT conv_id, idx, unnest(l) AS term, generate_subscripts(l, 1) AS pos FROM w), f AS (SELECT conv_id, idx, term, min(pos) AS pos FROM p GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, idx ORDER BY pos) AS k FROM f),
 g AS (SELECT conv_id, term, count(*) AS turns, array_to_string(list_slice(list_sort(list(idx)), 1, 3), '|') AS first FROM r WHERE k <= 12 GROUP BY ALL), q AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turns DESC, term) AS rank FROM g) SELECT conv_id, term, turns, first, rank::INT AS rank FROM q WHERE rank <= 24""")
def topics_topk(spark, sf):
    return D.topics(V.turns(spark, sf))


# ---------------------------------------------------------------- recall


def _holds(tree) -> str:
    if tree.op == "phrase":
        return f"f{{{' '.join(tree.words)}}} > 0"
    left = "false" if tree.left is None else _holds(tree.left)
    right = _holds(tree.right)
    return f"(({left}) AND NOT ({right}))" if tree.op == "not" else f"(({left}) {tree.op.upper()} ({right}))"


def _bm25(query: str, mode: str, limit: int, keep: str = "true", table: str = "t", key: str = "conv_id, idx", content: str = "content", head: str = _T) -> str:
    tree = S.any_of(query) if mode == "or" else S.Expression(query).tree
    phrases = S.phrases(tree)
    toks = f"regexp_extract_all(strip_accents(lower({content})), '[\\p{{L}}\\p{{N}}]+')"
    hits = []
    for p in phrases:
        same = " AND ".join(f"k[i + {j}] = {_q(w)}" for j, w in enumerate(p))
        hits.append(f"len(list_filter(range(1, len(k) + 1), lambda i: coalesce({same}, false)))")
    n = range(len(phrases))
    f = ", ".join(f"{h} AS f{i}" for i, h in enumerate(hits))
    d = ", ".join(f"count(*) FILTER (WHERE f{i} > 0) AS d{i}" for i in n)
    score = " + ".join(f"greatest(ln((n - d{i} + 0.5) / (d{i} + 0.5)), 1e-6) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * l / mean))" for i in n)
    hit = _holds(tree)
    for i, p in enumerate(phrases):
        hit = hit.replace(f"f{{{' '.join(p)}}}", f"f{i}")
    head = head + ", " if head else "WITH "
    return f"""{head}x AS (SELECT *, {toks} AS k FROM {table} WHERE length({content}) > 0), y AS (SELECT * EXCLUDE (k), len(k) AS l, {f} FROM x), z AS (SELECT count(*) AS n, avg(l) AS mean, {d} FROM y),
 r AS (SELECT y.*, {score} AS score FROM y, z WHERE ({hit}) AND ({keep})) SELECT {key}, round(score, 6) AS score FROM r ORDER BY round(score, 9) DESC, {key} LIMIT {limit}"""


def _ranked(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, F.round("score", 6).alias("score"))


@query(_bm25("build checks", "and", 20))
def fts_and_topk(spark, sf):
    return _ranked(S.search(V.turns(spark, sf), "build checks", 20, order=("conv_id", "idx")), "conv_id", "idx")


@query(_bm25("flake weather merge", "or", 20))
def fts_or_topk(spark, sf):
    return _ranked(S.search(V.turns(spark, sf), "flake weather merge", 20, mode="or", order=("conv_id", "idx")), "conv_id", "idx")


@query(_bm25('"operator review gate"', "and", 25))
def fts_phrase(spark, sf):
    return _ranked(S.search(V.turns(spark, sf), '"operator review gate"', 25, order=("conv_id", "idx")), "conv_id", "idx")


@query(_bm25("checks NOT green", "and", 30))
def fts_not(spark, sf):
    return _ranked(S.search(V.turns(spark, sf), "checks NOT green", 30, order=("conv_id", "idx")), "conv_id", "idx")


@query(_bm25('(flake OR "out of memory") AND (stuck OR dirty) NOT merged', "and", 30))
def fts_nested(spark, sf):
    return _ranked(S.search(V.turns(spark, sf), '(flake OR "out of memory") AND (stuck OR dirty) NOT merged', 30, order=("conv_id", "idx")), "conv_id", "idx")


@query(_bm25("EFIXE weather", "and", 30))
def fts_folded(spark, sf):
    return _ranked(S.search(V.turns(spark, sf), "EFIXE weather", 30, order=("conv_id", "idx")), "conv_id", "idx")


@query(_bm25("gate", "and", 15, "lower(coalesce(nullif(trim(domain), ''), 'coding')) IN ('coding', 'research') AND role IN ('user', 'assistant')"))
def policy_search(spark, sf):
    keep = X.domain(F.col("domain")).isin("coding", "research") & F.col("role").isin("user", "assistant")
    return _ranked(S.search(V.turns(spark, sf), "gate", 15, keep=keep, order=("conv_id", "idx")), "conv_id", "idx")


@query(_bm25("the and", "and", 50, table="documents", key="doc_id", content="text", head=""))
def fts_documents(spark, sf):
    return _ranked(S.search(spark.read.parquet(f"{sf}/documents.parquet"), "the and", 50, content="text", order=("doc_id",)), "doc_id")


@query(f"{_T}, h AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY idx) AS k FROM t WHERE contains(lower(content), 'gate')), g AS (SELECT conv_id, count(*) AS hits, min(idx) AS best FROM h WHERE k <= 3 GROUP BY ALL) SELECT conv_id, hits, best FROM g ORDER BY hits DESC, conv_id LIMIT 10")
def grok_sessions(spark, sf):
    h = V.turns(spark, sf).where(F.lower("content").contains("gate")).withColumn("k", F.row_number().over(Window.partitionBy("conv_id").orderBy("idx")))
    return U.top(h.where("k <= 3").groupBy("conv_id").agg(F.count("*").alias("hits"), F.min("idx").alias("best")), 10, F.desc("hits"), F.col("conv_id"))


@query(f"{_T} SELECT 'session://conversation/h' || conv_id || 'v1/turn/' || idx AS uri, substr(content, 1, 12000) AS text, length(content) > 12000 AS truncated, length(content) AS full_length FROM t WHERE role IN ('user', 'assistant') AND lower(coalesce(nullif(trim(domain), ''), 'coding')) = 'coding'")
def evidence_fetch(spark, sf):
    t = V.turns(spark, sf).where(F.col("role").isin("user", "assistant") & (X.domain(F.col("domain")) == "coding"))
    uri = X.pointer(F.concat(F.lit("h"), F.col("conv_id").cast("string"), F.lit("v1")), F.col("idx"))
    return t.select(uri.alias("uri"), F.substring("content", 1, 12000).alias("text"), (F.length("content") > 12000).alias("truncated"), F.length("content").cast("bigint").alias("full_length"))


# ---------------------------------------------------------------- mining


_THEMES = "list_filter([" + ", ".join(f"CASE WHEN {_m(p, 'snippet')} THEN {_q(n)} END" for n, p in R.THEMES) + "], lambda x: x IS NOT NULL)"
_REFS = r"list_distinct(list_transform(regexp_extract_all(snippet, 'https?://[^\s)\]}>,]+'), lambda u: CASE WHEN regexp_extract(u, '^https?://[^/?#]*/+([^/?#]+)', 1) <> '' THEN regexp_extract(u, '^https?://([^/?#]*)', 1) || '/' || regexp_extract(u, '^https?://[^/?#]*/+([^/?#]+)', 1) ELSE regexp_extract(u, '^https?://([^/?#]*)', 1) END))"
_CUT = f"CASE WHEN length({_CLEAN}) > 220 THEN substr({_CLEAN}, 1, 219) || '…' ELSE {_CLEAN} END"
_OBS = f"""{_D}, nx AS (SELECT *, coalesce(lead(signal) OVER (PARTITION BY conv_id ORDER BY idx), 'unknown') AS outcome, {_CUT} AS snippet, {_CATS} AS cats FROM d),
 ob AS (SELECT 'gotcha-skill' AS type, unnest(string_split(cats, '|')) AS signature, conv_id, project, harness FROM nx WHERE problem AND cats <> ''
 UNION ALL SELECT 'skill', unnest({_THEMES}), conv_id, project, harness FROM nx WHERE role = 'assistant' AND outcome = 'success' AND regexp_matches(tool, {_q(R.ACTION_TOOL)})
 UNION ALL SELECT 'memory-or-adr', project || ':' || unnest({_THEMES}), conv_id, project, harness FROM nx WHERE decision
 UNION ALL SELECT 'claude-md', project || ':' || unnest({_THEMES}), conv_id, project, harness FROM nx WHERE problem
 UNION ALL SELECT 'wiki-page-later', unnest({_REFS}), conv_id, project, harness FROM nx WHERE role = 'assistant' AND regexp_matches(tool, {_q(R.LOOKUP_TOOL)})),
 cd AS (SELECT type, signature, count(*) AS occurrences, count(DISTINCT conv_id) AS sessions, count(DISTINCT project) AS projects, count(DISTINCT harness) AS harnesses FROM ob GROUP BY ALL HAVING count(DISTINCT conv_id) >= 3)"""


@query(f"{_OBS} SELECT *, substr(sha256(type || ':' || signature), 1, 20) AS id, CASE WHEN type = 'wiki-page-later' THEN 'deferred-follow-up' ELSE 'curation-required' END AS status FROM cd")
def refinery_candidates(spark, sf):
    return Y.candidates(V.turns(spark, sf))


@query(f"{_OBS} SELECT type, count(*) AS candidates FROM cd GROUP BY ALL")
def refinery_counts_by_type(spark, sf):
    return Y.candidates(V.turns(spark, sf)).groupBy("type").agg(F.count("*").alias("candidates"))


@query(f"{_OBS} SELECT type, signature, conv_id, rank FROM (SELECT type, signature, conv_id, row_number() OVER (PARTITION BY type, signature ORDER BY conv_id)::INT AS rank FROM (SELECT DISTINCT type, signature, conv_id FROM ob)) WHERE rank <= 6")
def refinery_evidence(spark, sf):
    return Y.evidence(V.turns(spark, sf)).select("type", "signature", "conv_id", "rank")


@query(f"{_D}, e AS (SELECT DISTINCT conv_id, idx, {_CUT} AS snippet FROM d WHERE (role = 'assistant' AND signal <> 'unknown') OR (gate AND result <> 'unknown')) SELECT * FROM (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY idx DESC, snippet)::INT AS rank, idx, snippet FROM e) WHERE rank <= 6")
def outcome_evidence(spark, sf):
    return D.outcome_evidence(V.turns(spark, sf))


@query(f"{_T}, b AS (SELECT conv_id, role, count(*) AS n, sum(length(content)) AS c FROM t GROUP BY ALL) SELECT conv_id, sum(n)::BIGINT AS turns, sum(c)::BIGINT AS characters, array_to_string(list_sort(list(role || '=' || n)), '|') AS roles FROM b GROUP BY ALL")
def conversation_metrics(spark, sf):
    return D.metrics(V.turns(spark, sf))


# ---------------------------------------------------------------- agent roles


def _anchored() -> str:
    return "CASE " + " ".join(f"WHEN {_m(p, 'launch')} THEN {_q(r)}" for r, p in R.ROLE_ANCHORS) + " END"


def _points(role: str) -> str:
    return " + ".join(f"CASE WHEN {_m(p, 'launch')} THEN {n} ELSE 0 END" for r, n, p in R.ROLE_POINTS if r == role)


_R = f"""{_T}, la AS (SELECT *, {_anchored()} AS anchor FROM (SELECT conv_id, idx, substr(content, 1, {R.LAUNCH_CHARACTERS}) AS launch FROM t WHERE idx < {R.LAUNCH_TURNS} AND role = 'user' AND trim(content) <> '' AND NOT {_m(R.NO_LAUNCH)})),
 fa AS (SELECT conv_id, min(idx) AS start, min(idx) FILTER (WHERE anchor IS NOT NULL) AS ai FROM la GROUP BY ALL),
 pt AS (SELECT l.conv_id, l.idx, f.start, r.role, CASE WHEN l.idx = f.ai THEN CASE WHEN l.anchor = r.role THEN {R.ANCHOR_POINTS} ELSE 0 END ELSE CASE r.role {" ".join(f"WHEN {_q(r)} THEN {_points(r)}" for r in R.ROLES)} END END AS p
 FROM la l JOIN fa f USING (conv_id) CROSS JOIN (VALUES {", ".join(f"({_q(r)})" for r in R.ROLES)}) AS r(role) WHERE f.ai IS NULL OR l.idx <= f.ai),
 sc AS (SELECT conv_id, role, sum(p)::BIGINT AS s, min(idx) FILTER (WHERE p > 0) AS e, min(start) AS start FROM pt GROUP BY ALL),
 tc AS (SELECT conv_id, harness, {", ".join(f"count(*) FILTER (WHERE {_m(p, 'tool')}) AS {n}" for n, (_, p, _, _) in zip(("delegations", "mutations", "lookups"), R.ROLE_TOOLS, strict=True))} FROM t GROUP BY ALL),
 bo AS (SELECT tc.*, r.role, r.k, CASE WHEN (r.role = 'manager' AND delegations >= 3) THEN 3 WHEN (r.role = 'worker' AND mutations >= 3) OR (r.role = 'advisor' AND lookups >= 3 AND mutations = 0) THEN 2 ELSE 0 END AS b FROM tc CROSS JOIN (VALUES {", ".join(f"({_q(r)}, {i})" for i, r in enumerate(R.ROLES))}) AS r(role, k)),
 al AS (SELECT bo.*, coalesce(s, 0) + b AS score, coalesce(e, CASE WHEN b > 0 THEN coalesce(st.start, 0) END, st.start) AS ev FROM bo LEFT JOIN sc USING (conv_id, role) LEFT JOIN fa st USING (conv_id)),
 rk AS (SELECT *, row_number() OVER w AS n, score - lead(score) OVER w AS margin FROM al WINDOW w AS (PARTITION BY conv_id ORDER BY score DESC, k)),
 ir AS (SELECT conv_id, harness, CASE WHEN score >= 3 THEN role ELSE 'unclassified' END AS role, CASE WHEN score < 3 THEN 'low' WHEN score >= 7 AND margin >= 3 THEN 'high' ELSE 'medium' END AS confidence, score::BIGINT AS score, margin::BIGINT AS margin, CASE WHEN score >= 3 THEN ev END AS evidence_idx, delegations, mutations, lookups FROM rk WHERE n = 1)"""


@query(f"{_R} SELECT * FROM ir")
def role_inference(spark, sf):
    return G.inferred(V.turns(spark, sf))


@query(f"{_R} SELECT r.role, count(ir.conv_id) AS conversations FROM (VALUES {', '.join(f'({_q(r)})' for r in [*R.ROLES, 'unclassified'])}) AS r(role) LEFT JOIN ir USING (role) GROUP BY ALL")
def role_counts(spark, sf):
    return G.counts(V.turns(spark, sf))


_O = f"""{_T}, b AS (SELECT *, coalesce(lag(tool IS NOT NULL) OVER (PARTITION BY conv_id ORDER BY idx), false) AS after_tool, trim(content) AS c FROM t), o AS (SELECT * EXCLUDE (after_tool, c) FROM b WHERE role = 'user' AND NOT after_tool AND c <> '' AND NOT {_m(R.MACHINE_ENVELOPE, "c")} AND NOT {_m(R.NOTIFICATION, "c")})"""
_SIGS = "list_filter([" + ", ".join(f"CASE WHEN {_m(p)} THEN {_q(n)} END" for n, _, p in R.SIGNALS) + "], lambda x: x IS NOT NULL)"


@query(f"{_O} SELECT conv_id, idx FROM o")
def operator_turns(spark, sf):
    return W.operator_turns(V.turns(spark, sf)).select("conv_id", "idx")


@query(f"{_O}, m AS (SELECT conv_id, unnest({_SIGS}) AS signal FROM o), g AS (SELECT signal, count(*) AS n, count(DISTINCT conv_id) AS c FROM m GROUP BY ALL), names(signal, pole) AS (VALUES " + ", ".join(f"({_q(n)}, {_q(p)})" for n, p, _ in R.SIGNALS) + ") SELECT names.signal, pole, coalesce(n, 0) AS matching_turns, coalesce(c, 0) AS conversations FROM names LEFT JOIN g ON g.signal = names.signal")
def signal_inventory(spark, sf):
    return W.inventory(V.turns(spark, sf))


_IN = lambda names: "[" + ", ".join(map(_q, names)) + "]"
_SAID = f"regexp_replace(regexp_replace(lower({_redacted('content')}), '{_SPACES}', ' ', 'g'), '^ | $', '', 'g')"
_KEPT = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {_m(p)} THEN {_q(n)} END" for n, p in R.RETAINED) + "], lambda x: x IS NOT NULL), '|')"
_EPISODE = "sha256('episode|' || provider || '|' || harness || '|' || CASE WHEN resume_id IS NULL THEN 'conversation' ELSE 'resume' END || '|' || coalesce(resume_id, conv_id::VARCHAR))"
_AT = "strftime(make_timestamp(at_s * 1000000), '%Y-%m-%d')"
_E = f"""{_R}{_O[len(_T):]}, q AS (SELECT *, {_SIGS} AS sg, {_m(R.QUESTION_END)} AND {_m(R.QUESTION_WORD)} AS question FROM o WHERE NOT {_m(R.CONTROL_ENVELOPE)}), v AS (SELECT *, {_m(R.APPROVAL_CHANGE)} AND NOT question AND NOT {_m(R.APPROVAL_PROHIBITION)} AS appr,
 list_sort(list_filter(sg, lambda x: list_contains({_IN(R.AUTONOMY)}, x))) AS au, list_sort(list_filter(sg, lambda x: list_contains({_IN(R.OWNERSHIP)}, x))) AS ow FROM q),
 e0 AS (SELECT * EXCLUDE (sg, question, appr, au, ow), 'approval-gate-changed' AS kind, list_sort(sg) AS signals FROM v WHERE appr UNION ALL
 SELECT * EXCLUDE (sg, question, appr, au, ow), 'autonomy-boundary', au FROM v WHERE NOT appr AND NOT question AND (len(au) > 0 OR {_m(R.AUTONOMOUS_INTEGRATION)}) UNION ALL
 SELECT * EXCLUDE (sg, question, appr, au, ow), 'ownership-boundary', ow FROM v WHERE NOT appr AND len(ow) > 0),
 ev AS (SELECT e0.*, sha256({_SAID}) AS statement, {_EPISODE} AS episode, {_AT} AS day, CASE WHEN length({_CLEAN}) > {R.STATEMENT} THEN substr({_CLEAN}, 1, {R.STATEMENT - 1}) || '…' ELSE {_CLEAN} END AS statement_text,
 CASE WHEN kind = 'approval-gate-changed' THEN {_KEPT} END AS retained FROM e0 WHERE {_SAID} <> ''),
 g0 AS (SELECT kind, statement, episode, day, min(at_s) AS at_s, count(DISTINCT conv_id) AS conversations, list_sort(list(DISTINCT project)) AS projects, list_sort(list(DISTINCT ev.harness)) AS harnesses, list(DISTINCT ir.role) AS agents, list_sort(list_distinct(flatten(list(signals)))) AS signals,
 first(statement_text ORDER BY at_s, conv_id, idx) AS statement_text, first(retained ORDER BY at_s, conv_id, idx) AS retained FROM ev JOIN ir USING (conv_id) GROUP BY kind, statement, episode, day),
 gr AS (SELECT sha256('workflow-event:' || kind || ':' || statement || ':' || episode || ':' || day) AS id, * EXCLUDE (agents), conversations - 1 AS collapsed, list_filter({_IN(R.AGENT_ROLES)}, lambda r: list_contains(agents, r)) AS roles FROM g0)"""


def _groups(spark, sf):
    t = V.turns(spark, sf)
    return W.grouped(W.events(t), G.inferred(t))


@query(f"{_E} SELECT kind, conv_id, idx, array_to_string(signals, '|') AS signals, episode, statement, day FROM ev")
def workflow_events(spark, sf):
    return W.events(V.turns(spark, sf)).select("kind", "conv_id", "idx", F.array_join("signals", "|").alias("signals"), "episode", "statement", "day")


_SETS = ", ".join(f"array_to_string({c}, '|') AS {c}" for c in ("projects", "harnesses", "roles", "signals"))


@query(f"""{_E}, f AS (SELECT kind, statement, episode, day, conv_id, min(at_s) AS at_s, min(idx) AS idx FROM ev GROUP BY ALL),
 n AS (SELECT *, row_number() OVER (PARTITION BY kind, statement, episode, day ORDER BY at_s, conv_id, idx) AS k FROM f), p AS (SELECT kind, statement, episode, day, string_agg(conv_id || '/' || idx, '|' ORDER BY k) AS evidence FROM n WHERE k <= {R.EVENT_EVIDENCE} GROUP BY ALL)
 SELECT id, kind, at_s, conversations, collapsed, {_SETS}, statement_text, retained, evidence FROM gr JOIN p USING (kind, statement, episode, day)""")
def workflow_evolution(spark, sf):
    joined = [F.array_join(c, "|").alias(c) for c in ("projects", "harnesses", "roles", "signals")]
    shown = F.array_join(F.transform("evidence", lambda e: F.concat(e["conversation"].cast("string"), F.lit("/"), e["turn"].cast("string"))), "|")
    return _groups(spark, sf).select("id", "kind", "at_s", "conversations", "collapsed", *joined, "statement_text", "retained", shown.alias("evidence"))


@query(f"{_E} SELECT kind, count(*) AS events, sum(collapsed)::BIGINT AS collapsed, count(DISTINCT episode) AS episodes, max(at_s) AS latest FROM gr GROUP BY ALL")
def events_by_kind(spark, sf):
    return _groups(spark, sf).groupBy("kind").agg(F.count("*").alias("events"), F.sum("collapsed").alias("collapsed"), F.countDistinct("episode").alias("episodes"), F.max("at_s").alias("latest"))


@query(f"""{_E} SELECT 'conversations' AS measure, count(DISTINCT conv_id) AS n FROM t UNION ALL SELECT 'episodes', count(DISTINCT {_EPISODE}) FROM t UNION ALL SELECT 'operator_turns', count(*) FROM q UNION ALL SELECT 'candidates', count(*) FROM ev
 UNION ALL SELECT 'collapsed', coalesce(sum(collapsed), 0)::BIGINT FROM gr {" ".join(f"UNION ALL SELECT '{k}', count(*) FROM gr WHERE kind = '{k}'" for k in R.KINDS)}""")
def workflow_summary(spark, sf):
    t = V.turns(spark, sf)
    return W.summary(t, W.events(t), _groups(spark, sf))


_HALF = lambda x: f"floor(({x}) * 10000 + 0.5) / 10000"
_NEAR = f"""{_E}{_D[len(_T):]}, d2 AS (SELECT *, coalesce(lead(signal) OVER (PARTITION BY conv_id ORDER BY idx), 'unknown') AS nx FROM d),
 o1 AS (SELECT conv_id, max(idx) FILTER (WHERE (role = 'assistant' AND signal = 'success') OR (gate AND result = 'success')) AS good, max(idx) FILTER (WHERE (role = 'assistant' AND signal = 'failure') OR (gate AND result = 'failure')) AS bad,
 count(*) FILTER (WHERE problem) AS problems, count(*) FILTER (WHERE role = 'assistant' AND tool IS NOT NULL AND nx <> 'unknown') AS known, count(*) FILTER (WHERE role = 'assistant' AND tool IS NOT NULL AND nx = 'failure') AS failed FROM d2 GROUP BY conv_id),
 o2 AS (SELECT conv_id, CASE WHEN good IS NOT NULL AND bad IS NOT NULL AND abs(good - bad) <= 5 THEN 'mixed' WHEN good IS NULL AND bad IS NULL THEN 'unknown' WHEN bad IS NULL OR good > bad THEN 'success' ELSE 'failure' END AS status, problems, known, failed FROM o1),
 h AS (SELECT conv_id, {_EPISODE} AS other, provider, harness, project, min(at_s) AS started, max(at_s) AS ended, count(*) AS turns, coalesce(sum(t_total), CASE WHEN count(t_in) + count(t_out) > 0 THEN coalesce(sum(t_in), 0) + coalesce(sum(t_out), 0) END) AS tokens FROM t GROUP BY ALL),
 obs AS (SELECT h.*, {_HALF("(ended - started) / 60")} AS minutes, o2.* EXCLUDE (conv_id) FROM h JOIN o2 USING (conv_id)),
 rep AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY other, project ORDER BY ended DESC, turns DESC, conv_id DESC) AS k FROM obs) WHERE k = 1),
 e1 AS (SELECT id, kind, at_s, episode, unnest(projects) AS project, greatest(0, floor(least({R.WINDOW_DAYS * 86400}, at_s - (SELECT min(ended) FROM obs), (SELECT max(ended) FROM obs) - at_s) / 3600) * 3600) AS radius FROM gr),
 met AS (SELECT e1.id, e1.kind, rep.*, started <= ended AND started >= at_s - radius AND ended < at_s AS pre, started <= ended AND started >= at_s AND ended > at_s AND ended <= at_s + radius AS post, started < at_s AND ended > at_s AS across FROM e1 JOIN rep ON rep.project = e1.project AND rep.other <> e1.episode)"""
_SIDES = ", ".join(
    f"count(*) FILTER (WHERE {s}) AS {s}, " + ", ".join(f"count(*) FILTER (WHERE {s} AND status = '{k}') AS {s}_{k}" for k in N.STATUSES)
    + f", count(*) FILTER (WHERE {s} AND problems > 0) AS {s}_fe, coalesce(sum(problems) FILTER (WHERE {s}), 0)::BIGINT AS {s}_problems, coalesce(sum(known) FILTER (WHERE {s}), 0)::BIGINT AS {s}_known, coalesce(sum(failed) FILTER (WHERE {s}), 0)::BIGINT AS {s}_failed, median(turns) FILTER (WHERE {s}) AS {s}_turns, median(minutes) FILTER (WHERE {s}) AS {s}_m"
    for s in ("pre", "post")
)
_RATES = ", ".join(
    f"CASE WHEN {s}_success + {s}_failure + {s}_mixed >= 3 THEN {_HALF(f'{s}_success / ({s}_success + {s}_failure + {s}_mixed)')} END AS {s}_completion, CASE WHEN {s} >= 3 THEN {_HALF(f'{s}_fe / {s}')} END AS {s}_friction, CASE WHEN {s}_known >= 3 THEN {_HALF(f'{s}_failed / {s}_known')} END AS {s}_rework, CASE WHEN {s} >= 3 THEN {s}_m END AS {s}_minutes"
    for s in ("pre", "post")
)
_MEASURES = ("completion", "friction", "rework", "turns", "minutes")
_CMP = f"""{_NEAR}, sc2 AS (SELECT project, count(*) AS scoped FROM obs GROUP BY project), rc AS (SELECT project, count(*) AS reps FROM rep GROUP BY project),
 hd AS (SELECT e1.id, e1.kind, at_s, radius, sum(scoped)::BIGINT AS scoped, sum(reps)::BIGINT AS reps, count(r.other) AS event_episodes FROM e1 LEFT JOIN sc2 USING (project) LEFT JOIN rc USING (project) LEFT JOIN rep r ON r.project = e1.project AND r.other = e1.episode GROUP BY ALL),
 ag AS (SELECT id, count(*) FILTER (WHERE across) AS spanning, {_SIDES} FROM met GROUP BY id),
 c0 AS (SELECT hd.*, coalesce(spanning, 0) AS spanning, {", ".join(f"coalesce({s}{n}, 0) AS {s}{n}" for s in ("pre", "post") for n in ("", *(f"_{k}" for k in N.STATUSES), "_fe", "_problems", "_known", "_failed"))}, pre_turns, post_turns, pre_m, post_m FROM hd LEFT JOIN ag USING (id)),
 c1 AS (SELECT *, {_RATES}, array_to_string(list_filter([CASE WHEN radius < 86400 THEN 'observation-window-under-24h' END, CASE WHEN pre < 5 THEN 'pre-episodes-below-5' END, CASE WHEN post < 5 THEN 'post-episodes-below-5' END], lambda x: x IS NOT NULL), '|') AS reasons FROM c0),
 cm AS (SELECT id, kind, at_s, CASE WHEN reasons = '' THEN 'observed' ELSE 'insufficient-coverage' END AS status, reasons, (radius / 3600)::BIGINT AS window_hours, scoped, reps - event_episodes AS representatives, event_episodes, spanning, reps - event_episodes - spanning - pre - post AS outside, pre, post,
 {", ".join(f"{s}_{n}" for s in ("pre", "post") for n in (*N.STATUSES, "problems", "known", "failed", *_MEASURES))}, {", ".join(f"CASE WHEN reasons = '' THEN {_HALF(f'post_{n} - pre_{n}')} END AS {n}_change" for n in _MEASURES)} FROM c1)"""


@query(f"{_CMP} SELECT * FROM cm")
def workflow_outcomes(spark, sf):
    return N.comparisons(_groups(spark, sf), N.observations(V.turns(spark, sf)))


@query(f"""{_CMP}, tk AS (SELECT id, provider, harness, count(*) FILTER (WHERE pre) AS pre_samples, median(tokens) FILTER (WHERE pre) AS pre_tokens, count(*) FILTER (WHERE post) AS post_samples, median(tokens) FILTER (WHERE post) AS post_tokens FROM met WHERE tokens IS NOT NULL GROUP BY ALL)
 SELECT *, {_HALF("post_tokens - pre_tokens")} AS change FROM tk WHERE pre_samples >= 3 AND post_samples >= 3 AND id IN (SELECT id FROM cm WHERE status = 'observed')""")
def workflow_token_changes(spark, sf):
    return N.token_changes(_groups(spark, sf), N.observations(V.turns(spark, sf)))


_GENERAL = "CASE kind WHEN 'autonomy-boundary' THEN 'autonomy-general' ELSE 'ownership-general' END"
_MEMBERS = f""", m0 AS (SELECT *, CASE WHEN kind = 'approval-gate-changed' THEN list_distinct(list_prepend('approval-policy', signals)) WHEN len(signals) > 0 THEN signals ELSE [{_GENERAL}] END AS ss FROM gr),
 m1 AS (SELECT * EXCLUDE (ss, roles, signals), len(ss) * len(roles) > 1 AS shared, unnest(ss) AS signal, roles FROM m0), mb AS (SELECT * EXCLUDE (roles), unnest(roles) AS role FROM m1),
 oc0 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY kind, signal, role, episode ORDER BY at_s DESC, id DESC) AS k FROM mb) WHERE k = 1),
 oc AS (SELECT *, CASE WHEN row_number() OVER w = 1 THEN 'introduced' WHEN lag(statement) OVER w = statement THEN 'reinforced' WHEN row_number() OVER (PARTITION BY kind, signal, role, statement ORDER BY at_s, id) > 1 THEN 'returned-to-prior' ELSE 'reformulated' END AS relation, row_number() OVER w AS n, count(*) OVER (PARTITION BY kind, signal, role) AS total FROM oc0 WINDOW w AS (PARTITION BY kind, signal, role ORDER BY at_s, id))"""
_LABELS = "CASE signal " + " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in R.SIGNAL_LABELS.items()) + " END"


def _told(name: str, more: bool) -> str:
    v = f"CASE WHEN status = 'observed' THEN {name}_change END"
    good, bad = (">", "<") if more else ("<", ">")
    return f"count({v}) AS {name}_samples, CASE WHEN count({v}) >= 3 THEN count(*) FILTER (WHERE {v} {good} 0) END AS {name}_favorable, CASE WHEN count({v}) >= 3 THEN count(*) FILTER (WHERE {v} {bad} 0) END AS {name}_unfavorable, CASE WHEN count({v}) >= 3 THEN count(*) FILTER (WHERE {v} = 0) END AS {name}_unchanged, CASE WHEN count({v}) >= 3 THEN {_HALF(f'median({v})')} END AS {name}_median"


@query(f"""{_CMP}{_MEMBERS}, pa AS (SELECT oc.kind, signal, role, count(*) AS episodes, count(DISTINCT day) AS days, count(DISTINCT statement) AS formulations, min(oc.at_s) AS first, max(oc.at_s) AS last, {", ".join(f"count(*) FILTER (WHERE relation = '{r}') AS {r.replace('-', '_')}" for r in P.RELATIONS)},
 first(relation ORDER BY n DESC) AS latest, count(*) FILTER (WHERE status = 'observed') AS observed, count(*) - count(*) FILTER (WHERE status = 'observed') AS sparse, {", ".join(_told(*x) for x in P.ASSOCIATED.items())} FROM oc LEFT JOIN cm ON cm.id = oc.id GROUP BY oc.kind, signal, role HAVING count(*) >= 3 AND count(DISTINCT day) >= 2),
 st AS (SELECT kind, signal, role, count(*) AS memberships, count(*) FILTER (WHERE shared) AS shared, array_to_string(list_sort(list_distinct(flatten(list(projects)))), '|') AS projects, array_to_string(list_sort(list_distinct(flatten(list(harnesses)))), '|') AS harnesses FROM mb GROUP BY ALL)
 SELECT sha256('workflow-pattern:' || kind || ':' || signal || ':' || role) AS id, pa.*, CASE role WHEN 'unclassified' THEN 'Agents' ELSE upper(role[1]) || substr(role, 2) || ' agents' END || ': ' || {_LABELS} AS title, memberships, shared, memberships - episodes AS collapsed, projects, harnesses,
 CASE WHEN list_contains({_IN(R.GUARDRAILS)}, signal) THEN 'guardrail-imposed' WHEN list_contains({_IN(R.AUTONOMY)}, signal) THEN 'operating-latitude-expanded' WHEN kind = 'approval-gate-changed' THEN 'approval-gate-relaxed' WHEN kind = 'autonomy-boundary' THEN 'operating-latitude-expanded' ELSE 'guardrail-imposed' END AS effect,
 CASE WHEN observed >= 3 THEN 'observed' ELSE 'insufficient-coverage' END AS outcome FROM pa JOIN st USING (kind, signal, role)""")
def workflow_patterns(spark, sf):
    return P.patterns(_groups(spark, sf), N.comparisons(_groups(spark, sf), N.observations(V.turns(spark, sf))))


@query(f"""{_E}{_MEMBERS}, x AS (SELECT *, row_number() OVER (PARTITION BY kind, signal, role, relation ORDER BY at_s, id) AS nth FROM oc), y AS (SELECT *, CASE WHEN n = 1 THEN 0 WHEN relation = 'reformulated' AND nth = 1 THEN 1 WHEN relation = 'returned-to-prior' AND nth = 1 THEN 2 WHEN n = total THEN 3 END AS slot FROM x)
 SELECT kind, signal, role, slot, id, relation, at_s, statement_text FROM y WHERE slot IS NOT NULL""")
def pattern_examples(spark, sf):
    return P.examples(_groups(spark, sf))


@query(f"{_E}{_MEMBERS} SELECT kind, signal, role, total - n + 1 AS n, id, episode, at_s, relation, statement FROM oc WHERE total - n < {R.PATTERN_TIMELINE}")
def pattern_timeline(spark, sf):
    return P.timeline(_groups(spark, sf))


@query(f"{_NEAR} SELECT other AS episode, project, conv_id, ended, turns, status, problems, known, failed, tokens, minutes FROM rep")
def representative_episodes(spark, sf):
    return N.representatives(N.observations(V.turns(spark, sf))).select("episode", "project", "conv_id", "ended", "turns", "status", "problems", "known", "failed", "tokens", "minutes")


_WILSON = ", ".join(f"CASE WHEN choices = 0 THEN 0 ELSE round({f}(0 + (r + 1.9208 / n {s} 1.96 * sqrt(r * (1 - r) / n + 0.9604 / (n * n))) / (1 + 3.8416 / n), {b}), 6) END AS {c}" for c, s, f, b in (("low", "-", "greatest", "0"), ("high", "+", "least", "1")))


@query(f"""{_R}{_O[len(_T):]}, sure AS (SELECT conv_id, role AS agent FROM ir WHERE confidence = 'high' AND role <> 'unclassified'), m AS (SELECT conv_id, {_SIGS} AS sg FROM o), p AS (SELECT conv_id, CASE WHEN list_contains(sg, 'stop-and-report') OR list_contains(sg, 'one-writer') OR list_contains(sg, 'spec-freeze') THEN 0 WHEN len(list_filter(sg, lambda x: list_contains({_IN(R.AUTONOMY)}, x))) > 0 THEN 1 ELSE 0 END AS grants FROM m WHERE len(sg) > 0),
 g AS (SELECT agent AS role, count(DISTINCT s.conv_id) AS sessions, count(grants) AS choices, coalesce(sum(grants), 0)::BIGINT AS autonomy FROM sure s LEFT JOIN p USING (conv_id) GROUP BY agent), x AS (SELECT *, autonomy / nullif(choices, 0) AS r, choices::DOUBLE AS n FROM g) SELECT role, sessions, choices, autonomy, {_WILSON} FROM x""")
def role_profiles_wilson(spark, sf):
    return G.profiles(V.turns(spark, sf))


# ---------------------------------------------------------------- labels and views

_PAIRS = [(n, p) for n, p, _ in R.SIGNALS]
_POLE = f"CASE WHEN list_contains(sg, 'stop-and-report') OR list_contains(sg, 'one-writer') OR list_contains(sg, 'spec-freeze') THEN 'determinism-impose' WHEN len(list_filter(sg, lambda x: list_contains({_IN(R.AUTONOMY)}, x))) > 0 THEN 'autonomy-grant' WHEN len(sg) > 0 THEN 'determinism-impose' END"
_LAB = f"""{_O}, lb AS (SELECT CASE WHEN conv_id % 2 = 0 THEN 'calibration' ELSE 'held-out' END AS split, conv_id, idx, {_IN([p for _, p in _PAIRS])}[(conv_id + idx) % {len(_PAIRS)} + 1] AS pole, {_IN([n for n, _ in _PAIRS])}[(conv_id + idx) % {len(_PAIRS)} + 1] AS signal FROM t WHERE role = 'user' AND (conv_id * 3 + idx) % 5 = 0),
 mt AS (SELECT conv_id, idx, sg, {_POLE} AS turn_pole, snippet FROM (SELECT conv_id, idx, {_SIGS} AS sg, {_CUT} AS snippet FROM o) WHERE len(sg) > 0),
 ju AS (SELECT lb.*, coalesce(turn_pole, 'no-signal') AS prediction, coalesce(list_contains(sg, signal), false) AS agrees, coalesce(turn_pole = pole, false) AS correct FROM lb LEFT JOIN mt USING (conv_id, idx))"""


@query(f"{_LAB} SELECT * FROM ju")
def label_judgements(spark, sf):
    t = V.turns(spark, sf)
    return L.judged(t, V.labels(t, _PAIRS))


@query(f"{_LAB}, ba AS (SELECT split, max(n) AS most FROM (SELECT split, pole, count(*) AS n FROM ju GROUP BY ALL) GROUP BY split) SELECT split, count(*) AS labels, round(avg(agrees::INT), 6) AS agreement, round(avg(correct::INT), 6) AS accuracy, round(any_value(most) / count(*), 6) AS base_rate FROM ju JOIN ba USING (split) GROUP BY split")
def label_validation(spark, sf):
    t = V.turns(spark, sf)
    return L.validation(t, V.labels(t, _PAIRS)).select("split", "labels", *(F.round(c, 6).alias(c) for c in ("agreement", "accuracy", "base_rate")))


@query(f"""{_LAB}, ms AS (SELECT conv_id, idx, snippet, unnest(sg) AS signal FROM mt), el AS (SELECT ms.*, lb.conv_id IS NOT NULL AS labelled FROM ms LEFT JOIN (SELECT DISTINCT conv_id, idx FROM lb) lb USING (conv_id, idx)),
 on_ AS (SELECT *, row_number() OVER (PARTITION BY signal, conv_id ORDER BY labelled DESC, length(snippet), idx) AS k FROM el WHERE labelled OR {_m(R.EVIDENCE_START, "snippet")}), rn AS (SELECT signal, row_number() OVER (PARTITION BY signal ORDER BY labelled DESC, length(snippet), conv_id, idx)::INT AS rank, conv_id, idx, snippet FROM on_ WHERE k = 1) SELECT * FROM rn WHERE rank <= 3""")
def label_evidence(spark, sf):
    t = V.turns(spark, sf)
    return L.evidence(t, V.labels(t, _PAIRS))


@query(f"""{_E}{_MEMBERS}, px AS (SELECT kind, signal, role, count(*) AS episodes, count(DISTINCT day) AS days FROM oc GROUP BY ALL HAVING count(*) >= 3 AND count(DISTINCT day) >= 2),
 hs AS (SELECT kind, signal, role, list_distinct(flatten(list(harnesses))) AS harnesses FROM mb GROUP BY ALL)
 SELECT kind, signal, role FROM px JOIN hs USING (kind, signal, role) WHERE list_contains(harnesses, 'codex') AND (kind || ' ' || signal || ' ' || role || ' ' || {_LABELS}) LIKE '%operat%' AND EXISTS (SELECT 1 FROM oc WHERE oc.kind = px.kind AND oc.signal = px.signal AND oc.role = px.role AND {_AT} BETWEEN '2024-01-05' AND '2024-01-20')""")
def pattern_filter(spark, sf):
    groups = _groups(spark, sf)
    p = P.patterns(groups, N.comparisons(groups, N.observations(V.turns(spark, sf))))
    return E.filtered(p, P.occurrences(P.memberships(groups)), query="OPERAT", harness="codex", since="2024-01-05", until="2024-01-20").select(*P.KEY)


@query(f"{_CMP} SELECT cm.* EXCLUDE (id), len(projects) AS project_count FROM cm JOIN gr USING (id)")
def bounded_outcomes(spark, sf):
    groups = _groups(spark, sf)
    return E.bounded_comparisons(N.comparisons(groups, N.observations(V.turns(spark, sf))), groups)


@query(f"""{_T}, f AS (SELECT * FROM t WHERE role IN ('user', 'assistant')), n AS (SELECT *, CASE WHEN role = lag(role) OVER (PARTITION BY conv_id ORDER BY idx) THEN 0 ELSE 1 END AS nw FROM f), p AS (SELECT *, sum(nw) OVER (PARTITION BY conv_id ORDER BY idx)::BIGINT AS part FROM n),
 m AS (SELECT conv_id, part, min(role) AS role, count(*) AS turns, min(at_s) AS own_s, sum(length(content))::BIGINT AS characters FROM p GROUP BY conv_id, part) SELECT conv_id, part, role, turns, own_s, characters, max(own_s - part) OVER (PARTITION BY conv_id ORDER BY part) + part AS at_s FROM m""")
def coalesced_messages(spark, sf):
    return W.coalesced(V.turns(spark, sf))


@query("SELECT event_type, strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) AS n, count(DISTINCT user_id) AS users, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def events_by_day(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    return e.groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 60 SECONDS PRECEDING AND CURRENT ROW) AS recent FROM events")
def sliding_minute(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    w = Window.partitionBy("user_id").orderBy("us").rangeBetween(-60_000_000, 0)
    return e.select("event_id", F.count("*").over(w).alias("recent"))
