"""The named queries over an ingested corpus.

    corpus = Corpus(spark, "/data/corpus")
    corpus.ingest({"codex": "/logs/codex"})
    corpus.search("flake input", limit=10).show()

Every query resolves the snapshot once.  Listings and rollups are DataFrames; cards of a bounded
number of sessions are dictionaries.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import rules as R
from .functions import text as X
from .operators import derive as D
from .operators import explorer as E
from .operators import handoff as H
from .operators import labels as B
from .operators import outcomes as N
from .operators import patterns as P
from .operators import recall as Q
from .operators import refinery as Y
from .operators import roles as G
from .operators import rollups as U
from .operators import search as S
from .operators import workflow as W
from .store import artifacts as A
from .store import corpus as C
from .store import derived as V
from .store import files
from .store import journal as L

DOMAIN = r"[a-z0-9][a-z0-9_-]{0,63}"
STATUSES = ["success", "failure", "mixed", "unknown"]
MOST_EVIDENCE = 12_000
_CARD = ["conv_id", "id", "project", "harness", "model", "started_at", "ended_at"]


class Denied(LookupError):
    """No such evidence, or none that may be seen: both read alike."""


def domains(value: str | None) -> list[str]:
    """A comma list of domains: trimmed, once each, sorted; empty is coding; no wildcard."""
    names = sorted({v.strip().lower() for v in (value or "").split(",") if v.strip()}) or ["coding"]
    for n in names:
        if not re.fullmatch(DOMAIN, n):
            raise ValueError(f"{n!r} is no domain")
    return names


def bounded(value, default: int, most: int) -> int:
    """An integer argument: the default where absent, cut to 1..most."""
    if value is None:
        return default
    if isinstance(value, bool) or not isinstance(value, int | float) or value != value:
        raise ValueError("a number is needed")
    return max(1, min(most, int(value)))


class Corpus:
    def __init__(self, spark: SparkSession, root: str, policy: str | None = None):
        self.spark, self.root, self.policy = spark, root, domains(policy)

    # ------------------------------------------------------------ ingest

    def ingest(self, sources: dict[str, str]) -> dict:
        return C.ingest(self.spark, self.root, sources)

    def preview(self, path: str, domain: str = "general") -> dict:
        return C.preview_export(self.spark, self.root, path, domain)

    def import_export(self, path: str, domain: str = "general") -> dict:
        return C.import_export(self.spark, self.root, path, domain)

    def receipts(self, limit: int = 20) -> list[dict]:
        return L.receipts(self.root, limit)

    def sources(self, configured: dict[str, str] | None = None) -> list[dict]:
        return C.catalog(self.root, configured)

    def check(self) -> dict:
        return C.check(self.spark, self.root)

    def turns(self) -> DataFrame:
        return C.turns_view(*C.current(self.spark, self.root))

    # ------------------------------------------------------------ rollups

    def stats(self) -> dict[str, DataFrame]:
        t = self.turns()
        rows = U.usage(t, "project", "provider", "harness")
        return {"providers": U.usage(t, "provider", "harness"), "projects": U.top(rows, 30, F.desc("sessions"), F.desc("reported_total_tokens"), F.col("project"), F.col("provider"), F.col("harness"))}

    def models(self) -> DataFrame:
        return U.top(U.usage(self.turns(), "project", "harness", "model"), 30, F.desc("sessions"), F.desc("reported_total_tokens"), F.col("project"), F.col("harness"), F.col("model"))

    def tokens(self) -> DataFrame:
        return U.usage(self.turns(), "provider", "harness")

    def usage_time(self, bucket: str = "month", limit: int = 60) -> DataFrame:
        form = {"month": "yyyy-MM", "day": "yyyy-MM-dd"}[bucket]
        rows = U.usage(self.turns(), U.period(form), "harness", "model")
        return U.top(rows, limit, F.desc("period"), F.desc("reported_total_tokens"), F.col("harness"), F.col("model"))

    def tools(self, limit: int = 30) -> DataFrame:
        t = self.turns().withColumn("tool", F.explode("tools"))
        return U.top(U.tools(t, "harness"), limit, F.desc("calls"), F.col("harness"), F.col("tool"))

    def lengths(self) -> DataFrame:
        return U.lengths(U.sessions(self.turns())).orderBy("least")

    def projects(self, limit: int = 50) -> DataFrame:
        g = U.sessions(self.turns()).groupBy("project").agg(F.count("*").alias("sessions"), F.sum("turns").alias("turns"), F.min("started").alias("first"), F.max("ended").alias("last"))
        return U.top(g, bounded(limit, 50, 200), F.desc("last"), F.col("project"))

    def sessions(self, project: str | None = None, q: str | None = None, limit: int = 40) -> DataFrame:
        c = C.current(self.spark, self.root)[0]
        if project:
            c = c.where(F.col("project") == project)
        if q:
            c = c.where(" OR ".join(f"contains(lower(coalesce({n}, '')), lower({_sql(q)}))" for n in ("project", "model", "id", "title")))
        return c.orderBy(F.desc("ended_at"), "content_hash").limit(bounded(limit, 40, 100))

    def overview(self) -> dict:
        t = self.turns()
        return {"totals": U.overview(t).first().asDict(), "harnesses": _rows(U.usage(t, "harness").orderBy(F.desc("sessions"), "harness")), "domains": _rows(U.usage(t, "domain").orderBy(F.desc("sessions"), "domain")), "projects": _rows(self.projects(12)), "recent": _rows(self.sessions(limit=12).select("id", "project", "harness", "ended_at")), "tools": _rows(self.tools(10))}

    def recent_work(self, project: str, limit: int = 8) -> DataFrame:
        c = C.current(self.spark, self.root)[0].where((F.col("project") == project) & X.domain(F.col("domain")).isin(self.policy))
        return c.orderBy(F.desc("ended_at"), "content_hash").limit(bounded(limit, 8, 20))

    def project(self, name: str) -> dict:
        """Analytics, outcome counts, recurring problems and the newest decisions of a project."""
        t = self.turns().where(F.col("project") == name)
        p = D.problems(t).select("conv_id", F.explode(F.filter(F.split("categories", "\\|"), lambda c: c != "")).alias("category"))
        again = p.groupBy("category").agg(F.count("*").alias("occurrences"), F.countDistinct("conv_id").alias("sessions"))
        d = D.newest(D.decisions(t), 2).join(t.select("conv_id", "ended_at").distinct(), "conv_id")
        return {
            "project": name, "overview": U.overview(t).first().asDict(), "models": _rows(U.usage(t, "model").orderBy(F.desc("sessions"), "model").limit(20)),
            "tools": _rows(U.top(U.tools(t.withColumn("tool", F.explode("tools"))), 15, F.desc("calls"), F.col("tool"))), "outcomes": _statuses(D.outcomes(t)),
            "recurring_problems": _rows(again.orderBy(F.desc("sessions"), F.desc("occurrences"), "category").limit(12)), "decisions": _rows(d.orderBy(F.desc("ended_at"), "conv_id", F.desc("idx")).limit(10)),
        }

    # ------------------------------------------------------------ recall

    def search(self, query: str, limit: int = 20, mode: str = "and", roles_only: bool = False, domains_: list[str] | None = None, words: int = 28) -> DataFrame:
        """Ranked turns with a snippet of at most `words` tokens around the hits.  Scores use all turns ever ingested; only current ones are returned."""
        c, t = C.current(self.spark, self.root)
        live = C.turns_view(c, t)
        every = self.spark.read.parquet(f"{self.root}/corpus/turns").select("source_path", "content_hash", "idx", F.coalesce("content", F.lit("")).alias("content")).dropDuplicates(["source_path", "content_hash", "idx"])
        now = live.select(F.col("conv_id").alias("content_hash"), "idx", "id", "role", "project", "harness", "model", "domain", "ended_at")
        rows = every.join(now, ["content_hash", "idx"], "left")
        keep = F.col("id").isNotNull()
        if roles_only:
            keep = keep & F.col("role").isin("user", "assistant")
        if domains_ is not None:
            keep = keep & F.col("domain").isin(domains_)
        hits = S.search(rows, query, limit, mode=mode, keep=keep, order=("content_hash", "idx"))
        uri = X.pointer(F.col("content_hash"), F.col("idx"))
        hits = S.snippets(hits, query, words, mode=mode)
        return hits.select(F.col("content_hash").alias("conv_id"), "id", "idx", "role", "project", "harness", "model", "ended_at", "score", "snippet", uri.alias("uri"))

    def policy_search(self, query: str, limit: int = 8, wanted: list[str] | None = None) -> dict:
        """Search of the domains that the policy allows; a caller may only narrow them."""
        asked = wanted or self.policy
        allowed = [d for d in asked if d in self.policy]
        words = [w for p in S.terms(query) for w in p if len(w) > 1]
        hits = _rows(self.search(Q.quoted(list(dict.fromkeys(words))[:10]), bounded(limit, 8, 20), roles_only=True, domains_=allowed)) if allowed and words else []
        return {"hits": hits, "domains": allowed, "denied": sorted(set(asked) - set(allowed))}

    def _resolve(self, identifier: str) -> str:
        c = C.current(self.spark, self.root)[0]
        if re.fullmatch(r"[0-9a-fA-F]{8,64}", identifier):
            rows = c.where(F.col("content_hash").startswith(identifier.lower())).select("content_hash").limit(2).collect()
            if len(rows) > 1:
                raise LookupError(f"ambiguous hash prefix: {identifier}")
        else:
            rows = c.where((F.col("id") == identifier) | (F.col("resume_id") == identifier)).orderBy(F.desc("ended_at"), "content_hash").select("content_hash").limit(1).collect()
        if not rows:
            raise LookupError(f"conversation not found: {identifier}")
        return rows[0].content_hash

    def get(self, identifier: str, idx: int | None = None) -> DataFrame:
        """Turns of a conversation, by a hash's prefix, id or resume id."""
        t = self.turns().where(F.col("conv_id") == self._resolve(identifier))
        if idx is None:
            return t.orderBy("idx")
        t = t.where(F.col("idx") == idx)
        if t.isEmpty():
            raise LookupError(f"turn not found: {idx}")
        return t

    def evidence(self, uri: str, wanted: list[str] | None = None) -> dict:
        """A current turn that the policy lets see, cut to 12,000 characters; every refusal is the same error."""
        m = re.fullmatch(rf"{R.POINTER_SCHEME}://conversation/([0-9a-fA-F]{{64}})/turn/(\d{{1,9}})", uri)
        allowed = [d for d in (wanted or self.policy) if d in self.policy]
        row = None
        if m and allowed:
            row = self.turns().where((F.col("conv_id") == m[1].lower()) & (F.col("idx") == int(m[2])) & F.col("role").isin("user", "assistant") & F.col("domain").isin(allowed)).first()
        if row is None:
            raise Denied("evidence is not available")
        return {"uri": uri, "role": row.role, "text": row.content[:MOST_EVIDENCE], "truncated": len(row.content) > MOST_EVIDENCE, "full_length": len(row.content), "project": row.project}

    def _cards(self, hits: list[dict], words: list[str], limit: int, newest: bool) -> dict:
        """Cards of the sessions that hits belong to, with at most three hits each."""
        groups: dict[str, list[dict]] = {}
        for h in hits:
            groups.setdefault(h["conv_id"], []).append(h)
        groups = {k: v[:3] for k, v in groups.items()}
        if not groups:
            return {"matched_sessions": 0, "outcomes": dict.fromkeys(STATUSES, 0), "sessions": []}
        t = self.turns().where(F.col("conv_id").isin(list(groups)))  # of at most 200 hits
        head = {r.conv_id: r.asDict() for r in t.select(*_CARD).distinct().collect()}
        order = sorted(groups, key=lambda k: head[k]["ended_at"], reverse=True) if newest else list(groups)
        order = order[:limit]
        t = t.where(F.col("conv_id").isin(order))
        parts = {n: _by_conv(df) for n, df in {"problems": D.problems(t), "decisions": D.decisions(t), "attempts": D.attempts(t), "evidence": D.outcome_evidence(t, 2), "metrics": D.metrics(t), "outcome": D.outcomes(t)}.items()}
        most = {"problems": 2 if newest else 3, "decisions": 3, "attempts": 5}
        cards = []
        for k in order:
            card = head[k] | {"matches": groups[k], "outcome": parts["outcome"][k][0]["status"], "evidence": parts["evidence"].get(k, []), "shape": parts["metrics"][k][0]}
            card |= {n: relevant(sorted(parts[n].get(k, []), key=lambda r: r["idx"]), words, m) for n, m in most.items()}
            cards.append(card)
        return {"matched_sessions": len(groups), "outcomes": {s: sum(c["outcome"] == s for c in cards) for s in STATUSES}, "sessions": cards}

    def grok(self, topic: str, limit: int = 10) -> dict:
        return {"topic": topic} | self._cards(_rows(self.search(topic, max(limit * 5, 30))), Q.ask_terms(topic), limit, False)

    def ask_lexical(self, question: str, limit: int = 10) -> dict:
        """Sessions that hold all terms of a question, else any, newest first."""
        words = _concrete(question)
        n, mode = max(limit * 8, 50), "and"
        hits = _rows(self.search(Q.quoted(words), n))
        if len(hits) < limit:
            mode, hits = "or", _rows(self.search(Q.quoted(words), n, mode="or"))
        return {"question": question, "terms": words, "mode": mode} | self._cards(hits, words, limit, True)

    def semantic(self, query: str, limit: int = 10, candidates: int = 40, scorer: Q.Scorer = Q.overlap, name: str = "overlap") -> dict:
        """Hits ranked by a scorer; the default is local term overlap, not a language model."""
        wanted = max(limit, min(50, candidates))
        hits = Q.selected(_rows(self.search(Q.quoted(_concrete(query)), min(200, wanted * 4), mode="or", roles_only=True, words=80)), wanted)
        if not hits:
            return {"hits": [], "candidates": 0, "cached": False}
        by = {f"c{i}": h for i, h in enumerate(hits)}
        r = Q.rerank(query, [(i, h["snippet"]) for i, h in by.items()], scorer, name, self.root)
        ranked = [by[i] | {"lexical_score": by[i]["score"], "score": s, "reason": why} for i, s, why in r["rankings"] if i in by][:limit]
        return {"hits": ranked, "candidates": len(hits), "cached": r["cached"], "passed": r["passed"], "request": r["request"]}

    def ask(self, question: str, limit: int = 10, scorer: Q.Scorer = Q.overlap, name: str = "overlap") -> dict:
        """Sessions of the hits that a scorer finds relevant, newest first."""
        words, n = _concrete(question), min(50, max(limit * 8, 24))
        found = self.semantic(question, n, n, scorer, name)
        pool, floor = Q.qualified(found["hits"])
        return {"question": question, "terms": words, "threshold": floor} | self._cards(pool, words, limit, True)

    def project_brief(self, name: str, wanted: list[str] | None = None) -> dict:
        """Activity, outcomes and recent evidence of one project, from the domains that the policy allows."""
        allowed = [d for d in (wanted or self.policy) if d in self.policy]
        t = self.turns().where((F.col("project") == name) & F.col("domain").isin(allowed))
        s = U.sessions(t)
        recent = [r.conv_id for r in s.orderBy(F.desc("ended"), "conv_id").limit(8).select("conv_id").collect()]
        own = t.where(F.col("conv_id").isin(recent))
        place = {k: i for i, k in enumerate(recent)}
        by = lambda c: _rows(s.groupBy(*c).agg(F.count("*").alias("sessions"), F.sum("turns").alias("turns")).orderBy(F.desc("sessions"), *c).limit(8))

        def newest(rows: DataFrame) -> list[dict]:
            """The last two of each recent session, newest session first, at most eight."""
            w = Window.partitionBy("conv_id").orderBy(F.desc("idx"))
            few = _rows(rows.withColumn("k", F.row_number().over(w)).where("k <= 2").select("conv_id", "idx", "snippet", X.pointer(F.col("conv_id"), F.col("idx")).alias("uri")))
            return sorted(few, key=lambda r: (place[r["conv_id"]], r["idx"]))[:8]

        head = s.agg(F.count("*").alias("sessions"), F.coalesce(F.sum("turns"), F.lit(0)).alias("turns"), F.min("started").alias("first"), F.max("ended").alias("last")).first().asDict()
        return {"project": name, "domains": allowed, "denied": sorted(set(wanted or []) - set(allowed)), "overview": head, "harnesses": by(["harness"]), "models": by(["model", "harness"]), "outcomes": _statuses(D.outcomes(own)), "problems": newest(D.problems(own)), "decisions": newest(D.decisions(own))}

    # ------------------------------------------------------------ mining

    def _artifact(self, name: str, recipe: str, build) -> dict:
        """A bounded report, made once per snapshot and recipe."""
        snap = C.snapshot(self.root)
        L.validate(self.root)
        A.get_or_build(self.root, name, snap["hash"], recipe, build)
        C.assert_unchanged(self.root, snap)
        return A.load(self.root, name, snap["hash"])

    def derived(self, table: str) -> DataFrame:
        """One of problems, decisions, gates, attempts, topics, outcomes, outcome_evidence, metrics."""
        return {"problems": D.problems, "decisions": D.decisions, "gates": D.gates, "attempts": D.attempts, "topics": D.topics, "outcomes": D.outcomes, "outcome_evidence": D.outcome_evidence, "metrics": D.metrics}[table](self.turns())

    def refinery(self, kind: str | None = None, limit: int = 30, threshold: int = 3) -> dict:
        c = Y.candidates(self.turns(), threshold)
        shown = c.where(F.col("type") == kind) if kind else c
        shown = shown.orderBy(F.desc("sessions"), F.desc("projects"), F.desc("occurrences"), "id").limit(bounded(limit, 30, 100))
        return {"counts": {r["type"]: r["count"] for r in c.groupBy("type").count().collect()}, "candidates": _rows(shown)}

    def candidate(self, id: str) -> dict:
        t = self.turns()
        row = Y.candidates(t).where(F.col("id") == id).first()
        if row is None:
            raise LookupError(f"candidate not found: {id}")
        proof = Y.evidence(t).where((F.col("type") == row["type"]) & (F.col("signature") == row["signature"]))
        return row.asDict() | {"route": R.ROUTES[row["type"]]} | {"evidence": _rows(proof.select("conv_id", "idx", "project", "harness", "snippet", "rank").orderBy("rank"))}

    def orchestration_profile(self) -> dict:
        t = self.turns()
        return self._artifact("orchestration-profile", "1", lambda: {"signals": _rows(W.inventory(t).orderBy("signal")), "roles": _rows(G.counts(t).orderBy("role")), "profiles": _rows(G.profiles(t).orderBy("role")), "distinguishable": _rows(G.distinguishable(G.profiles(t)))})

    def roles(self) -> DataFrame:
        return G.inferred(self.turns())

    def workflow_evolution(self) -> DataFrame:
        """Workflow events, with their lineage and evidence."""
        t = self.turns()
        return W.grouped(W.events(t), G.inferred(t))

    def workflow_summary(self) -> dict:
        t = self.turns()
        groups = self.workflow_evolution()
        latest = groups.where(F.col("kind") == R.KINDS[0]).orderBy(F.desc("at_s"), F.desc("id")).first()
        return {r["measure"]: r["n"] for r in W.summary(t, W.events(t), groups).collect()} | {"approval_gate": latest.asDict(True) if latest else None}

    def workflow_outcomes(self) -> DataFrame:
        """What was observed around each event."""
        return N.comparisons(self.workflow_evolution(), N.observations(self.turns()))

    def workflow_token_changes(self) -> DataFrame:
        return N.token_changes(self.workflow_evolution(), N.observations(self.turns()))

    def workflow_patterns(self) -> DataFrame:
        return P.patterns(self.workflow_evolution(), self.workflow_outcomes())

    def workflow_pattern(self, id: str) -> dict:
        """A pattern with its examples and timeline."""
        row = self.workflow_patterns().where(F.col("id") == id).first()
        if row is None:
            raise LookupError(f"pattern not found: {id}")
        own = F.lit(True)
        for k in P.KEY:
            own = own & (F.col(k) == row[k])
        groups = self.workflow_evolution()
        return row.asDict() | {"examples": _rows(P.examples(groups).where(own).orderBy("slot")), "timeline": _rows(P.timeline(groups).where(own).orderBy("at_s", "id"))}

    def explore(self, **filters: str) -> DataFrame:
        """Patterns as they may be shown, filtered as in `explorer.filtered`."""
        p = E.filtered(self.workflow_patterns(), P.occurrences(P.memberships(self.workflow_evolution())), **filters)
        return E.bounded_patterns(p.orderBy(*E.pattern_order()))

    def validate(self, labels: str) -> DataFrame:
        """Agreement and accuracy of the signal rules on a label file."""
        return B.validation(self.turns(), B.signal_labels(self.spark, labels))

    def derive(self) -> dict:
        """Derived structure of conversations that have none yet; the counts."""
        return V.derive(self.spark, self.root)

    def insights(self) -> dict:
        """What a report page shows: the newest events and comparisons, the strongest patterns and candidates, inventories and roles."""
        events, t = self.workflow_evolution(), self.turns()
        outcomes = N.comparisons(events, N.observations(t))
        shown = ["id", "kind", "at_s", "statement_text", "conversations", "collapsed", "signals"]
        return {
            "events": _rows(events.orderBy(F.desc("at_s"), F.desc("id")).select(*shown).limit(40))[::-1], "outcomes": _rows(E.bounded_comparisons(outcomes, events).orderBy(F.desc("at_s")).limit(30))[::-1],
            "patterns": _rows(E.bounded_patterns(P.patterns(events, outcomes).orderBy(*E.pattern_order()).limit(30))), "profile": self.orchestration_profile(), "refinery": self.refinery(),
        }

    def bridge(self, identifier: str, mode: str = "history", path: str | None = None) -> dict:
        """Write a session file for another harness; its receipt."""
        name = self._resolve(identifier)
        snap = C.snapshot(self.root)
        text, receipt = H.emit(self.turns(), name, mode)
        C.assert_unchanged(self.root, snap)
        path = path or f"{self.root}/bridge/{mode}/{name[:2]}/{name}.jsonl"
        files.write(path, text)
        return receipt | {"path": path, "content_hash": files.sha256(text)}


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict(True) for r in df.collect()]


def _statuses(df: DataFrame) -> dict[str, int]:
    found = {r["status"]: r["count"] for r in df.groupBy("status").count().collect()}
    return {s: found.get(s, 0) for s in STATUSES}


def _by_conv(df: DataFrame) -> dict[str, list[dict]]:
    out: dict[str, list[dict]] = {}
    for r in _rows(df):
        out.setdefault(r["conv_id"], []).append(r)
    return out


def _concrete(question: str) -> list[str]:
    words = Q.ask_terms(question)
    if not words:
        raise ValueError("a concrete topic is needed")
    return words


def relevant(items: list[dict], words: list[str], limit: int) -> list[dict]:
    """The last items that hold a word, else the last of all."""
    hit = [x for x in items if any(w in x["snippet"].lower() for w in words)]
    return (hit or items)[-limit:]
