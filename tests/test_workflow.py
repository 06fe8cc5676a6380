"""Workflow events, windows and patterns on made-up sessions whose counts are known, and search display against SQLite."""

import json
import sqlite3

import pytest

from sessionlake.operators import labels as L
from sessionlake.operators import outcomes as N
from sessionlake.operators import patterns as P
from sessionlake.operators import rollups as U
from sessionlake.operators import search as S
from sessionlake.operators import workflow as W

DAY = 86400
T0 = 1_767_225_600  # 2026-01-01
SCHEMA = "conv_id string, id string, resume_id string, idx int, role string, content string, harness string, provider string, project string, model string, domain string, at_s bigint, t_in bigint, t_out bigint, t_cached bigint, t_write bigint, t_total bigint, tool string"
APPROVAL = "PRs are now allowed to merge once checks are green; no operator approval gate. Destructive actions need operator approval."


def turn(conv, idx, role, text, at, project="/p", resume=None, harness="codex", tokens=(None,) * 5, tool=None):
    return (conv, conv, resume, idx, role, text, harness, "openai", project, "m", "coding", at, *tokens, tool)


def session(conv, start, minutes, said="all checks are green", project="/p", total=None):
    """Two turns; the second tells an outcome."""
    return [turn(conv, 0, "user", "please look at the widget", start, project), turn(conv, 1, "assistant", said, start + 60 * minutes, project, tokens=(5, 5, 0, 0, total))]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_events_collapse_copies_of_one_episode(spark):
    say = "Please  continue AUTONOMOUSLY with the widget"
    rows = [
        *(turn(f"a{k}", 0, "user", say, T0 + k * 60, f"/p{k}", resume="r1") for k in range(3)),  # copies of one resumed session
        turn("b", 0, "user", say, T0),  # the same words elsewhere
        turn("a0", 1, "user", say.lower(), T0 + DAY, "/p0", resume="r1"),  # the next day
        turn("c", 0, "user", APPROVAL, T0),
        turn("d", 0, "user", "should we remove the operator approval gate?", T0),
        turn("e", 0, "user", "<system-reminder> continue autonomously", T0),
        turn("f", 0, "user", "quoting <persisted-output> here: continue autonomously", T0),
        turn("g", 0, "user", "one writer per tree, and ﬁnish", T0, harness="pi"),
    ]
    t = frame(spark, rows)
    roles = spark.createDataFrame([("a0", "worker"), ("a1", "manager"), ("b", "unclassified")], "conv_id string, role string")
    events = W.events(t)
    got = {(r.kind, r.episode, r.day): r for r in W.grouped(events, roles).collect()}
    assert len(got) == 5 and sum(r.collapsed for r in got.values()) == 2
    many = next(r for r in got.values() if r.collapsed)
    assert (many.projects, many.roles, many.signals, many.conversations) == (["/p0", "/p1", "/p2"], ["manager", "worker"], ["self-propel"], 3)
    assert [(e.conversation, e.turn) for e in many.evidence] == [("a0", 0), ("a1", 0), ("a2", 0)]
    gate = next(r for r in got.values() if r.kind == "approval-gate-changed")
    assert gate.retained == "required verification remains in force|destructive or unsafe actions remain operator-owned"
    assert {r.measure: r.n for r in W.summary(t, events, W.grouped(events, roles)).collect()} == {"conversations": 9, "episodes": 7, "operator_turns": 8, "candidates": 7, "collapsed": 2, "approval-gate-changed": 1, "autonomy-boundary": 3, "ownership-boundary": 1}
    assert "finish" in next(r.statement_text for r in events.select(W.nfkc("statement_text").alias("statement_text")).collect() if "writer" in r.statement_text)


def test_windows_are_symmetric_and_strict(spark):
    at = T0 + 10 * DAY
    rows = [turn("event", 0, "user", "please continue autonomously", at)]
    for k in range(5):
        rows += session(f"pre{k}", at - (k + 1) * DAY, 30, "the build failed" if k < 2 else "all checks are green", total=100 + k)
        rows += session(f"post{k}", at + (k + 1) * DAY, 60, total=200 + k)
    rows += session("ends-at", at - 1800, 30) + session("across", at - 1800, 90) + session("starts-at", at, 30) + session("far", at - 9 * DAY, 30) + session("other", at + DAY, 30, project="/q")
    rows += session("first", T0 + 3 * DAY, 0) + session("last", T0 + 17 * DAY + 1800, 0)  # seven days on both sides, cut to whole hours
    t = frame(spark, rows)
    roles = spark.createDataFrame([], "conv_id string, role string")
    groups, seen = W.grouped(W.events(t), roles), N.observations(t)
    r = N.comparisons(groups, seen).first()
    assert (r.status, r.reasons, r.window_hours) == ("observed", "", 168)
    # what ends at the event is neither before it nor across it; what starts with it is after it
    assert (r.pre, r.post, r.spanning, r.outside, r.event_episodes) == (6, 6, 1, 3, 1)
    assert (r.pre_success, r.pre_failure, r.pre_completion, r.post_completion, r.completion_change) == (4, 2, 0.6667, 1.0, 0.3333)
    assert (r.pre_turns, r.pre_minutes, r.post_minutes) == (2.0, 30.0, 60.0)
    (k,) = N.token_changes(groups, seen).collect()
    assert (k.pre_samples, k.pre_tokens, k.post_samples, k.post_tokens) == (6, 101.5, 6, 201.5) and k.change == 100.0


def test_patterns_need_episodes_and_days(spark):
    a, b = "please continue autonomously with it", "keep moving until a true operator decision"
    said = [a, a, b, a]
    rows = [turn(f"c{k}", 0, "user", text, T0 + k * DAY) for k, text in enumerate(said)] + [turn("c3", 1, "user", b, T0 + 3 * DAY - 60)]
    rows += [turn(f"d{k}", 0, "user", "one writer per tree", T0 + k) for k in range(4)]  # one day only
    t = frame(spark, rows)
    groups = W.grouped(W.events(t), spark.createDataFrame([], "conv_id string, role string"))
    (p,) = P.patterns(groups, N.comparisons(groups, N.observations(t))).collect()
    assert (p.kind, p.signal, p.role, p.title) == ("autonomy-boundary", "self-propel", "unclassified", "Agents: continue autonomously through the active lane")
    assert (p.memberships, p.episodes, p.days, p.formulations, p.collapsed) == (5, 4, 4, 2, 1)
    assert (p.introduced, p.reinforced, p.reformulated, p.returned_to_prior, p.latest) == (1, 1, 1, 1, "returned-to-prior")
    assert (p.effect, p.outcome, p.sparse) == ("operating-latitude-expanded", "insufficient-coverage", 4)
    assert [(e.slot, e.relation) for e in P.examples(groups).where("signal = 'self-propel'").orderBy("slot").collect()] == [(0, "introduced"), (1, "reformulated"), (2, "returned-to-prior")]


def test_token_measures_and_buckets(spark):
    rows = [turn("a", 0, "assistant", "hello", T0, harness="claude-code", tokens=(10, 5, 20, 30, 65)), turn("b", 0, "assistant", "world", T0, tokens=(100, 20, 80, None, 120))]
    t = frame(spark, rows)
    got = {r.harness: (r.non_cached_tokens, r.cached_tokens, r.reported_total_tokens) for r in U.usage(t, "harness").collect()}
    assert got == {"claude-code": (15, 50, 65), "codex": (40, 80, 120)}
    assert [tuple(r) for r in U.lengths(U.sessions(t)).collect()] == [("1-10", 2, 1.0, 1, 1)]


def test_labels(spark, tmp_path):
    t = frame(spark, [turn("a", 0, "user", "Continue autonomously now", T0), turn("b", 0, "user", "one writer per tree", T0), turn("c", 0, "user", "hello", T0)])
    rows = [{"split": s, "conversationHash": c, "turnIndex": 0, "expectedPole": p, "expectedSignal": g} for s, c, p, g in [("calibration", "a", "autonomy-grant", "self-propel"), ("held-out", "b", "determinism-impose", "one-writer"), ("held-out", "c", "autonomy-grant", "self-propel")]]
    (tmp_path / "labels.json").write_text(json.dumps(rows, indent=1))
    labels = L.signal_labels(spark, str(tmp_path / "labels.json"))
    got = {r.split: r.asDict() for r in L.validation(t, labels).collect()}
    assert got["calibration"]["agreement"] == 1.0 and (got["held-out"]["accuracy"], got["held-out"]["base_rate"]) == (0.5, 0.5)
    with pytest.raises(ValueError):
        L.sound(got)
    assert {r.prediction for r in L.judged(t, labels).collect()} == {"autonomy-grant", "determinism-impose", "no-signal"}
    assert L.unsupported(t, spark.createDataFrame([("a", 0, "self-propel"), ("c", 0, "self-propel")], "conv_id string, idx int, signal string")).count() == 1


QUERIES = ["flake", "flake dirty", "flake OR widget", "flake NOT dirty", "(flake OR widget) AND dirty", '"operator review"', 'cafe', "flake NOT (dirty OR widget)", "nothing OR operator NOT gate"]
TEXTS = ["the flake is dirty", "a widget, a Flake!", "operator review gate", "review operator", "Café and flake", "dirty widget", "", "gate operator nothing"]


@pytest.mark.parametrize("query", QUERIES)
def test_search_finds_what_fts5_finds(spark, query):
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE f USING fts5(content, tokenize='unicode61')")
    db.executemany("INSERT INTO f(rowid, content) VALUES (?, ?)", list(enumerate(TEXTS, 1)))
    want = db.execute("SELECT rowid, -bm25(f) FROM f WHERE f MATCH ?", (query,)).fetchall()
    docs = spark.createDataFrame(list(enumerate(TEXTS, 1)), "id int, content string")
    assert {r.id for r in S.search(docs, query, 20, order=("id",)).collect()} == {i for i, _ in want}


def test_shown_hits_and_bad_expressions():
    ps = S.phrases(S.Expression("flake OR dirty").tree)
    assert S.shown("the Flake is dirty, very dirty", ps) == "the [Flake] is [dirty], very [dirty]"
    long = " ".join(f"w{i}" for i in range(50)) + " flake and dirty end " + " ".join(f"v{i}" for i in range(50))
    assert S.shown(long, ps, 5) == " … [flake] and [dirty] end v0 … "
    for bad in ("(flake", "flake)", "AND flake", "flake NOT", "NOT flake"):
        with pytest.raises(ValueError):
            S.Expression(bad)


def test_pattern_filter_sees_occurrences_beyond_the_timeline(spark, tmp_path):
    """Patterns with more occurrences than a timeline shows, of which only the older lie in the days."""
    import oracle

    from sessionlake.plans import queries as plans

    rows = [(c, i, ("user", "assistant")[i % 2], "again") for c in range(3000) for i in range(2)]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").coalesce(1).write.parquet(str(tmp_path / "made"))
    next((tmp_path / "made").glob("part-*")).rename(tmp_path / "conversations.parquet")
    assert oracle.compare(plans.pattern_filter(spark, str(tmp_path)), oracle.connect(str(tmp_path)), plans.SQL["pattern_filter"]) is None
