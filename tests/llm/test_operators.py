"""Operators against brute force on a small fixture with nulls, empties, ties, repeats, a long text and clashing columns."""

import hashlib
import math
import random
import re
import sys
import zlib
from collections import Counter

import numpy as np
import pytest

from sessionlake.llm import decontam, jaccard, linededup, oracles, packing, queries, rabitq, secretscan, suffixtree, tokenfile, tokens, toxicity, urltree

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows():
    r = random.Random(3)
    words = ["Alpha", "beta", "gamma,", "délta", "eps", "zeta.", "eta", "token", "=", "secret", "9f" * 20, "AKIA" + "Z" * 14, "x"]
    text = lambda n: " ".join(r.choice(words) + str(r.randrange(40)) * r.randrange(2) for _ in range(n))
    out = [(i, text(r.randrange(1, 90))) for i in range(40)]
    base = text(120)
    for i in range(40, 60):
        w = base.split(" ")
        w[r.randrange(len(w))] = f"edit{i}"
        out.append((i, " ".join(w)))
    out += [(60, base), (61, base), (61, base), (62, None), (63, ""), (64, " \n\t "), (65, "one two"), (None, base), (None, None), (66, "token=abcdefgh\n" * 3000), (67, 'Secret : "' + "a1" * 20 + '" api_key=short'), (68, "a  <|endoftext|>b's <|startoftext|>'s\n\nC'd"), (69, "Ab.\n\nCd 12ab&é  x")]
    return [(i, t, "clash", "clash") for i, t in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), "doc_id bigint, text string, key string, score string").repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, key string, score string")


def test_decontamination(spark, docs, none):
    items = [(1, rows()[45][1]), (2, "one two"), (3, None), (4, "!!"), (5, rows()[3][1]), (5, rows()[3][1]), (None, "x")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    cut = lambda t: word.findall((t or "").translate(LOW))
    windows: dict = {}
    for i, t in items:
        w = cut(t)
        for k in range(max(1, len(w) - 9) if w and i is not None else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(str(i))
    want = []
    for d, t, *_ in rows():
        w, hit, found = cut(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        want.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    got = [tuple(r) for r in decontam.contamination(spark, docs, bench).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert decontam.contamination(spark, none, bench).count() == 0
    near = decontam.search(decontam.build_index(docs), spark.createDataFrame([(1, "two one")], "item_id bigint, text string"), 10, slop=3)
    assert [r.doc_id for r in near.where("size(items) > 0").collect()] == [65]


def test_secret_scan(docs, none):
    assign = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    want = {}
    for d, t, *_ in rows():
        t = t or ""
        found = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in assign.finditer(t) if len(m[2]) >= 8]
        found += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
        found += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        want[d, len(t)] = (Counter(k for _, k, _ in found), hashlib.sha256(",".join(x for *_, x in sorted(found)).encode()).hexdigest())
    got = {(r.doc_id, r.base_sha256) for r in secretscan.scan(docs).collect()}
    assert got == {(d, h) for (d, _), (_, h) in want.items()}
    assert secretscan.scan(none).count() == 0


def test_secret_scan_is_linear_in_long_texts():
    import time

    import pyarrow as pa

    from sessionlake.llm import common as C

    scanner = secretscan.Scanner()
    for text, n in (("token=abcdefgh\n" * 70_000, 70_000), ("a1" * 500_000, 1), ("-----BEGIN " * 90_000, 0), ("token= " * 100_000, 0)):
        began = time.time()
        assert len(scanner.scan(*C.buffers(pa.array([text]))).get(0, [])) == n
        assert time.time() - began < 30


def test_line_dedup(spark, none):
    long = " ".join(f"w{i}" for i in range(60))
    data = [(2, f"intro two\n{long}\nend two"), (1, f"intro one\n{long}"), (3, long), (4, "short line\nend two"), (5, None), (None, long), (6, "")]
    df = spark.createDataFrame(data, "doc_id bigint, text string")
    got = {r.doc_id: (r.text, r.n_deleted, r.emptied) for r in linededup.dedup(df).collect()}
    assert got == {1: (f"intro one\n{long}", 0, False), 2: ("intro two\nend two", 1, False), 3: ("", 1, True), 4: ("short line\nend two", 0, False), 5: (None, 0, False), None: (long, 0, False), 6: ("", 0, False)}
    assert {r.doc_id for r in linededup.drop_repeats(spark, df).collect()} == {1, 2, 4, 5, None, 6}
    assert linededup.dedup(none).count() == 0
    a, b = ["x", "p", "q", "r"], ["q", "r", "x", "p"]
    assert linededup.common_blocks(a, b, [9] * 4, 18) == [0, 1, 2, 3]  # moved blocks


def brute_blocks(a, b, words, least):
    """Indices in b of lines in any run of at least `least` words that stands in a too."""
    held = {tuple(a[i:j]) for i in range(len(a)) for j in range(i + 1, len(a) + 1)}
    return sorted({k for i in range(len(b)) for j in range(i + 1, len(b) + 1) if sum(words[i:j]) >= least and tuple(b[i:j]) in held for k in range(i, j)})


def test_common_blocks_without_unique_lines():
    assert linededup.common_blocks(["P", "x", "P"], ["y", "P", "z"], [1, 60, 1], 20) == [1]
    assert linededup.common_blocks(["y", "P", "z"], ["P", "x", "P"], [60, 1, 60], 20) == [0, 2]
    r = random.Random(5)
    for _ in range(400):
        size = {x: r.choice([1, 4, 7, 25]) for x in "abcdef"}
        a, b = ([r.choice("abcdef") for _ in range(r.randrange(1, 14))] for _ in range(2))
        w = [size[x] for x in b]
        assert linededup.common_blocks(a, b, w, 20) == brute_blocks(a, b, w, 20)


def test_line_dedup_against_all_earlier_documents(spark):
    r = random.Random(8)
    line = {x: " ".join(f"{x}{k}" for k in range(r.choice([1, 6, 6, 11, 22]))) for x in "abcdefgh"}
    s = [" ".join(f"s{i}w{k}" for k in range(6)) for i in range(4)]
    texts = [s[0:2], s[1:3], s[2:4], s, s]
    texts += [[line[r.choice("abcdefgh")] for _ in range(r.randrange(1, 12))] for _ in range(60)]
    df = spark.createDataFrame([(i, "\n".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(3)
    got = {x.doc_id: x.text for x in linededup.dedup(df).collect()}
    for i, t in enumerate(texts):
        w = [len(x.split()) for x in t]
        gone = {k for a in texts[:i] if a != t for k in brute_blocks(a, t, w, 20)}
        gone |= set(range(len(t))) if t in texts[:i] and sum(w) >= 20 else set()
        assert got[i] == "\n".join(x for k, x in enumerate(t) if k not in gone), i
    assert got[4] == ""


def test_url_rules(spark):
    urls = {1: "http://A.Example.ORG/es/7?q", 2: "https://example.org/en/19#t", 3: "x://org/en/2", 4: "http://u.com/de/3", 5: "ftp", 6: None, 7: "http://example.org?x=/es/", 8: "http://org.net/fr/1"}
    df = spark.createDataFrame([(i, u, "clash") for i, u in urls.items()], "page_id bigint, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urltree.judge(df).collect()}
    assert got[1] == ("a.example.org", "/es/7", "example.org/es/", "block") and got[2] == ("example.org", "/en/19", "example.org/en/1", "block")
    assert got[3][2:] == ("org/", "allow") and got[4][2:] == ("com/de/", "block")
    assert got[5][:3] == got[6][:3] == ("", "", None) and got[7][:3] == ("example.org", "", None) and got[8][:2] == ("org.net", "/fr/1")


def brute_tree(texts, held, depth):
    """Score of each token list, by counting contexts in dictionaries."""
    from collections import defaultdict

    n: dict = defaultdict(Counter)  # context -> followers in training
    for w, h in zip(texts, held, strict=True):
        for i in range(len(w)):
            for d in range(min(i, depth) + 1):
                if not h:
                    n[tuple(w[i - d : i])][w[i]] += 1
    total, kinds = sum(n[()].values()), len(n[()])
    root = lambda x: (n[()][x] + 0.5) / (total + 0.5 * (kinds + 1))
    states = {}
    for c, follows in n.items():
        size = sum(follows.values())
        up = n[c[1:]]
        parent = lambda x: root(x) if len(c) == 1 else up[x] / sum(up.values())  # noqa: B023, E731
        told = {x: k for x, k in follows.items() if k >= 2}
        gain = sum(k * math.log(k / size / parent(x)) + math.log(root(x)) for x, k in told.items()) if c else 0
        if c and size >= suffixtree.LEAST and gain >= suffixtree.GAIN:
            states[c] = {x: (k - suffixtree.DISCOUNT) / size for x, k in told.items()}

    def p(c, x):
        if not c:
            return root(x)
        if c not in states:
            return p(c[1:], x)
        return states[c].get(x, 0) + (1 - sum(states[c].values())) * p(c[1:], x)

    return [sum(math.log10(p(tuple(w[max(0, i - depth) : i]), w[i])) for i in range(len(w))) for w in texts], states


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_suffix_tree(spark, docs, none, depth, monkeypatch):
    cut = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW)) + ["\0"]
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 == 1
    c = Counter(w for d, t, *_ in rows() if not held(d) for w in cut(t))
    n, v = sum(c.values()), len(c)
    score, states = brute_tree([cut(t) for _, t, *_ in rows()], [held(d) for d, *_ in rows()], depth)
    assert {len(x) for x in states} == set(range(1, depth + 1))
    want = sorted((str(d), held(d), len(cut(t)), sum(c[w] > 0 for w in cut(t)), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in cut(t)), 3), round(s, 3)) for (d, t, *_), s in zip(rows(), score, strict=True))
    monkeypatch.setattr(suffixtree, "BLOCK_BYTES", 2000)
    got = suffixtree.score(docs, depth).collect()
    got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 3), round(r.score, 3)) for r in got)
    assert [x[:5] for x in got] == [x[:5] for x in want]
    assert all(abs(a - b) < 0.01 for x, y in zip(got, want, strict=True) for a, b in zip(x[5:], y[5:], strict=True))
    assert suffixtree.score(none).count() == 0


def test_toxicity(spark):
    r = random.Random(1)
    bad = lambda i: i % 5 == 0
    data = [(i, " ".join(r.choice(["plain", "words", "here", "and", "there"]) + str(r.randrange(30)) for _ in range(40)) + (" vileword" if bad(i) else "")) for i in range(600)]
    df = spark.createDataFrame([*data, (None, None), (900, "")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 1 if bad(i) else 0) for i in range(600)] + [(None, 1), (3, None)], "doc_id bigint, toxic int")
    got = toxicity.score(toxicity.fit(df, labels), df).collect()
    test = [x for x in got if x.held_out and x.doc_id is not None and x.doc_id < 600]
    assert test and all(x.predicted == bad(x.doc_id) for x in test)
    assert all(0 <= x.score <= 1 for x in got)
    assert toxicity.score(toxicity.fit(df, labels.limit(0)), df).where("predicted = 1").count() == 0


def test_toxicity_of_a_frequent_class(spark):
    r = random.Random(2)
    bad = lambda i: i % 20 < 7
    data = [(i, " ".join(r.choice(["plain", "words", "here", "and", "there"]) + str(r.randrange(30)) for _ in range(40)) + (" vileword" if bad(i) else "")) for i in range(900)]
    df = spark.createDataFrame(data, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 1 if bad(i) else 0) for i in range(900)], "doc_id bigint, toxic int")
    got = [x for x in toxicity.score(toxicity.fit(df, labels), df).collect() if x.held_out]
    assert got and all(x.predicted == bad(x.doc_id) for x in got)
    assert {x.doc_id for x in toxicity.drop_toxic(spark, df, labels).collect()} == {i for i, _ in data if not bad(i)}


@pytest.mark.parametrize("n", [0, 1, 700, 9000])
def test_range_coder_round_trip(n):
    ids = np.random.default_rng(n).zipf(1.3, n).clip(0, 50000).astype(np.int32)
    raw = tokenfile.pack_segment(np.array([4, 5]), np.array([False, True]), np.array([0, n // 2, n]), ids)
    doc, null, bounds, back = tokenfile.unpack_segment(raw)
    assert (back == ids).all() and doc.tolist() == [4, 5] and null.tolist() == [False, True] and bounds.tolist() == [0, n // 2, n]
    if n > 100:
        with pytest.raises(ValueError):
            tokenfile.unpack_segment(raw[:-40] + bytes(8) + raw[-32:])
    if n > 1000:  # a block alone, and far below raw size
        assert (tokenfile.unpack_segment(raw, only=2)[3] == ids[512:768]).all()
        assert len(raw) < 0.7 * 2 * n


def test_range_coder_learns_contexts():
    r = np.random.default_rng(5)
    words = [r.integers(0, 50000, r.integers(2, 6)) for _ in range(2000)]
    ids = np.concatenate([words[k] for k in r.zipf(1.2, 30000).clip(1, 2000) - 1]).astype(np.int32)
    n = np.bincount(ids)
    p = n[n > 0] / len(ids)
    raw = tokenfile.pack_segment(np.array([1]), np.array([False]), np.array([0, len(ids)]), ids)
    assert (tokenfile.unpack_segment(raw)[3] == ids).all()
    assert len(raw) * 8 < 0.75 * len(ids) * -(p * np.log2(p)).sum()  # orders 1 and 2 tell much that order 0 cannot


@pytest.mark.parametrize("name,drops", [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_encoder_equals_the_library(name, drops):
    import pyarrow as pa
    from tokenizers import Tokenizer

    from sessionlake.llm import common as C

    r = random.Random(4)
    atoms = [*"aAbzZ0 19  \n\t\r'&.#-_<|>éÀß×ÿñ\u3000中\x1c\x00\x7f\x85İΣς½", "'s", "'re", "<|endoftext|>", "<|startoftext|>", " the", "\n\n", "don't", "e\u0301"]
    texts = ["".join(r.choice(atoms) for _ in range(r.randrange(30))) for _ in range(1500)]
    data, off = C.buffers(pa.array(texts))
    for marks in (True, False):
        tok = Tokenizer.from_file(tokens.vocabulary(name))
        tok.encode_special_tokens = not marks
        enc, want = tokens.Encoder(name, drops, marks), [x.ids for x in tok.encode_batch(texts, add_special_tokens=False)]
        for _ in range(2):
            ids, b = enc.encode(data, off)
            assert [ids[x:y].tolist() for x, y in zip(b[:-1], b[1:], strict=True)] == want


def calls(f, *args):
    """How many Python and C functions f calls."""
    n = 0

    def tick(frame, event, arg):
        nonlocal n
        n += event in ("call", "c_call")

    sys.setprofile(tick)
    try:
        f(*args)
    finally:
        sys.setprofile(None)
    return n


@pytest.mark.parametrize("name,drops", [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_new_words_go_to_the_library_together(name, drops):
    from tokenizers import Tokenizer

    r = random.Random(6)
    words = list(dict.fromkeys("".join(r.choice("aeinrstäÖßÿÑ") for _ in range(r.randrange(1, 9))) for _ in range(6000)))
    text = "".join(r.choice([" ", " ", "\n", "  ", ".\n", "-", " ×", "÷"]) + w for w in words)
    data, off = np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())])
    enc = tokens.Encoder(name, drops)
    assert calls(enc.encode, data, off) < len(words)  # of each new word there were several calls before
    want = Tokenizer.from_file(tokens.vocabulary(name)).encode(text, add_special_tokens=False).ids
    assert enc.encode(data, off)[0].tolist() == want == tokens.Encoder(name, drops).encode(data, off)[0].tolist()


def test_range_coder_takes_many_ids_a_call():
    ids = np.random.default_rng(0).zipf(1.3, 6_000_000).clip(0, 50000).astype(np.int32)
    args = np.array([1]), np.array([False]), np.array([0, len(ids)]), ids
    raw = tokenfile.pack_segment(*args)
    assert (tokenfile.unpack_segment(raw)[3] == ids).all()
    assert calls(tokenfile.pack_segment, *args) + calls(tokenfile.unpack_segment, raw) < len(ids) // 28  # one in 23 before


def test_token_file_and_packing(docs, none):
    from tokenizers import Tokenizer

    plain = {name: Tokenizer.from_file(tokens.vocabulary(name)) for name in ("byte_bpe_50k.json", "word_bpe_49k.json")}
    ids = lambda name, t: plain[name].encode(t or "", add_special_tokens=False).ids

    data = sorted(((d, t) for d, t, *_ in rows()), key=lambda x: (x[0] is not None, x[0] or 0))
    size = {str(d) + str(t): len(ids("byte_bpe_50k.json", t)) + 1 for d, t in data}
    got = sorted(tokenfile.index(tokenfile.write(docs)).collect(), key=lambda r: r.start)
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == sorted((str(d), size[str(d) + str(t)]) for d, t in data)
    assert [r.start for r in got] == list(np.cumsum([0] + [r.n_tokens for r in got])[:-1]) and [r.doc_id or -1 for r in got] == sorted(r.doc_id or -1 for r in got)
    want = sorted((str(d), zlib.crc32(np.array(ids("byte_bpe_50k.json", t) + [2], "<u4").tobytes())) for d, t in data)
    assert sorted((str(r.doc_id), r.ids_crc32) for r in got) == want
    pieces = packing.pack(docs, with_ids=True)
    p = sorted(pieces.collect(), key=lambda r: (r.sequence_id, r.offset))
    whole = [np.array(ids("word_bpe_49k.json", t) + [0], "<u4") for _, t in data]
    total = sum(map(len, whole))
    cut = [(str(d), k, 2048 * k, len(x[2048 * k : 2048 * (k + 1)]), zlib.crc32(x[2048 * k : 2048 * (k + 1)].tobytes())) for (d, _), x in zip(data, whole, strict=True) for k in range(-(-len(x) // 2048))]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in p) == sorted(cut)
    assert sum(r.length for r in p) == total and all(r.ids_crc32 == zlib.crc32(r.ids) for r in p)
    end: dict = {}
    for r in p:
        assert r.offset == end.get(r.sequence_id, 0)
        end[r.sequence_id] = r.offset + r.length
    assert max(end.values()) <= 2048 and len(end) <= -(-total // 2048) + 1
    assert packing.sequences(pieces).count() == len(end)
    assert tokenfile.index(tokenfile.write(none)).count() == 0 and packing.pack(none).count() == 0


def test_near_vectors(spark):
    r = np.random.default_rng(0)
    base = r.standard_normal((40, 16))
    v = [base[i % 40] + 0.12 * r.standard_normal(16) for i in range(400)] + [base[0]] * 5
    data = [(i, x.tolist()) for i, x in enumerate(v)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [1.0, None]), (904, [1.0, 2.0])]
    got = {x.vec_id: x for x in rabitq.near_dedup(spark.createDataFrame(data, "vec_id bigint, embedding array<double>")).collect()}
    u = np.array(v) / np.linalg.norm(v, axis=1, keepdims=True)
    links = (u @ u.T >= rabitq.COSINE).sum(1) - 1
    found = np.array([got[i].n_links for i in range(len(v))])
    assert (found <= links).all() and found.sum() >= 0.9 * links.sum()
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in (900, 901, 902, 903, 904))


@pytest.mark.parametrize("leaf", [2, jaccard.LEAF])
def test_jaccard(docs, none, leaf, monkeypatch):
    monkeypatch.setattr(jaccard, "LEAF", leaf)
    data = [(d, re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))) for d, t, *_ in rows()]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for _, w in data]
    up = list(range(len(data)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                up[find(i)] = find(j)
    least: dict = {}
    for i, (d, _) in enumerate(data):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    want = sorted(str((d, len(s), least.get(find(i)))) for i, ((d, _), s) in enumerate(zip(data, sets, strict=True)))
    assert sorted(str(tuple(r)) for r in jaccard.join(docs).collect()) == want
    assert jaccard.join(none).count() == 0


def test_jaccard_region_large_in_one_batch(spark):
    phrase = "one two three four five six seven"
    data = [(i, f"{phrase} word{i}") for i in range(1, 10)] + [(0, phrase)]
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(batch)
    spark.conf.set(batch, "9")
    try:
        got = {tuple(r) for r in jaccard.join(spark.createDataFrame(data, "doc_id bigint, text string").coalesce(1)).collect()}
    finally:
        spark.conf.set(batch, was)
    assert got == {(0, 3, 0), *((i, 4, 0) for i in range(1, 10))}


def test_one_row_of_each_component(spark):
    r = random.Random(9)
    text = lambda: " ".join(f"w{r.randrange(1000)}" for _ in range(40))
    base, clean, other = text(), text(), text()
    data = [(1, base, "a"), (2, base + " end", "b"), (2, clean, "c"), (3, other, "d"), (3, other, "d"), (3, other, "d"), (4, other + " end", "e"), (5, clean, "f"), (None, base, "g"), (6, "", "h"), (6, "", "h"), (7, None, "i"), (None, "!", "j"), (None, "!", "j")]
    docs = spark.createDataFrame(data, "doc_id bigint, text string, lang string").repartition(3)
    got = sorted(x.lang for x in jaccard.one_of_each(spark, docs).collect())
    assert got == ["a", "c", "d", "h", "h", "i", "j"]
    assert jaccard.one_of_each(spark, docs).columns == docs.columns


@pytest.mark.parametrize("name", list(oracles.SQL))
def test_queries_equal_their_sql(spark, name):
    import os

    import oracle

    sf = os.environ.get("TEST_SF", "/root/testdata/sf0.001")
    assert oracle.compare(queries.queries()[name](spark, sf), oracle.connect(sf), oracles.SQL[name]) is None


def brute_classes(texts, percent=75):
    """Smallest row of each class of texts linked by shared 5-word shingles."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t.translate(LOW)) for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    up, holders = list(range(len(texts))), {}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    for i, a in enumerate(sets):
        for j in {j for x in a for j in holders[x] if j < i}:
            if 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                x, y = sorted((find(i), find(j)))
                up[y] = x
    return [find(i) for i in range(len(texts))]


@pytest.mark.parametrize("leaf,files", [(2, 5), (jaccard.LEAF, 7)])
def test_jaccard_of_many_files_whatever_the_order(spark, leaf, files, monkeypatch, tmp_path):
    """Overlaps of exactly 75 %, passages of many documents, no sample for the shingle order, several files."""
    monkeypatch.setattr(jaccard, "LEAF", leaf)
    monkeypatch.setattr(jaccard, "SAMPLE", 0)
    r = random.Random(leaf)
    fresh = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    texts, phrases = [], [fresh(7) for _ in range(6)]
    for _ in range(40):  # 3 and 4 shingles with 3 shared: exactly 75 %
        p = r.choice(phrases)
        texts += [" ".join(p), " ".join(p + fresh(1)), " ".join(fresh(1) + p)]
    for _ in range(12):  # chains of edits about the threshold
        w = fresh(60)
        for _ in range(8):
            w = list(w)
            for _ in range(r.randrange(1, 3)):
                w[r.randrange(len(w))] = fresh(1)[0]
            texts.append(" ".join(w))
    passage = fresh(5)
    texts += [" ".join(passage + fresh(r.randrange(1, 9))) for _ in range(45)] + [" ".join(fresh(30)) for _ in range(60)]
    r.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(files)
    df.write.parquet(str(tmp_path / "d"))
    got = {x.doc_id: x.component_id for x in jaccard.join(spark.read.parquet(str(tmp_path / "d"))).collect()}
    assert [got[i] for i in range(len(texts))] == brute_classes(texts)


def hostile(spark):
    """Rows of nulls, empties, repeats and one long text, with columns named like the stages' own."""
    own = ["mask", "th", "row", "key", "gone", "nth", "i", "t", "left", "c0", "score", "kind", "__mask", "__key", "n_chars"]
    data = [(d, t, *([7] * len(own))) for d, t, *_ in rows()[30:]]
    data += [(70, "line " * 30 + "\n" + "end " * 25 + "\n" + "more"), (71, "line " * 30 + "\n" + "end " * 25 + "\nother"), (71, "line " * 30 + "\n" + "end " * 25 + "\nother"), (71, "another text with the same id")]
    data = [x if len(x) > 2 else (*x, *([7] * len(own))) for x in data]
    return spark.createDataFrame(data, "doc_id bigint, text string, " + ", ".join(f"`{c}` int" for c in own)).repartition(3), data


def test_stages_take_any_columns_and_rows(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs, data = hostile(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        kept = Counter(str((x.doc_id, x.text)) for x in out.collect())
        if name in ("toxicity", "decontamination"):
            assert not kept - Counter(str((d, t)) for d, t, *_ in data), name
        assert any("62, None" in x for x in kept) and stage(spark, docs.limit(0), sf).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() >= len(data) and corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), sf).count() == 0


def test_contaminated_rows_are_judged_by_id_and_text(spark):
    words = " ".join(f"w{i}" for i in range(14))
    docs = spark.createDataFrame([(1, words, "a"), (1, "clean", "b"), (None, words, "c"), (None, "clean", "d"), (2, None, "e")], "doc_id bigint, text string, row string")
    bench = spark.createDataFrame([(1, words)], "item_id bigint, text string")
    assert sorted(x.row for x in decontam.drop_contaminated(spark, docs, bench).collect()) == ["b", "d", "e"]
    assert decontam.drop_contaminated(spark, docs, bench.limit(0)).count() == 5


def test_pipeline_keeps_columns(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
    assert corpus_pipeline.run(spark, sf).count() > 100


def test_near_vectors_across_many_cells(spark, monkeypatch):
    monkeypatch.setattr(rabitq, "CELL", 150)
    r = np.random.default_rng(2)
    n, dim = 1500, 32
    a = r.standard_normal((n, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    side = r.standard_normal((n, dim))
    side -= (side * a).sum(1, keepdims=True) * a
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    b = 0.9505 * a + math.sqrt(1 - 0.9505**2) * side  # just within the threshold, so a cell's border often parts them
    v = np.concatenate([a, b])
    got = {x.vec_id: x for x in rabitq.near_dedup(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id bigint, embedding array<double>")).collect()}
    links = (v @ v.T >= rabitq.COSINE).sum(1) - 1
    found = np.array([got[i].n_links for i in range(2 * n)])
    assert (found <= links).all() and found.sum() >= 0.9 * links.sum() and links.sum() >= 2 * n
    assert sum(got[n + i].component_id == i for i in range(n)) >= 0.9 * n


def test_jaccard_regions_of_a_passage_outside_the_sample(spark, monkeypatch):
    """A passage of common words in few of many documents makes no large region, though the sample lacks it."""
    monkeypatch.setattr(jaccard, "SAMPLE", 64)
    r = random.Random(5)
    common = lambda n: [f"c{r.randrange(40)}" for _ in range(n)]
    passage = common(30)
    texts = [[w for i in range(40) for w in (f"w{d}x{i}", *common(1))] + (passage if d % 50 == 0 else common(30)) for d in range(1200)]
    docs = spark.createDataFrame([(d, " ".join(t)) for d, t in enumerate(texts)], "doc_id bigint, text string")
    made = jaccard.Join(docs)
    made.prepare()
    assert made.candidates()[1].count() == 0


def test_jaccard_stage_deletes_its_tables(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(jaccard.C, "shared_dir", lambda _: str(tmp_path))
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (3, "g h")], "doc_id bigint, text string")
    out = jaccard.one_of_each(spark, docs)
    assert {p.name.split("-")[0] for p in tmp_path.iterdir()} <= {"marks", "edges"}
    assert sorted(x.doc_id for x in out.collect()) == [1, 3]


def test_jaccard_memory_of_a_worker_follows_the_step(spark, monkeypatch):
    """Sets are made of short steps, and no Arrow batch of texts is much longer than BATCH."""
    import tracemalloc

    import pyarrow as pa

    r = random.Random(2)
    words = [f"w{i}" for i in range(5000)]
    texts = [" ".join(r.choices(words, k=300)) for _ in range(4000)]
    batch = pa.RecordBatch.from_pydict({"doc_id": range(4000), "text": texts, "th": range(4000)})
    order = jaccard.Order((np.zeros(0, np.uint64), np.zeros(0, np.int64)), 1, 1, 1)
    jaccard.C._powers.clear()
    tracemalloc.start()
    assert sum(x.num_rows for x in jaccard._sets(order, 75, 5)([batch])) == 4000
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 30e6

    sets = jaccard._sets

    def watched(*args):
        run = sets(*args)

        def checked(batches):
            for b in batches:
                assert b.num_rows < 3000, b.num_rows  # 4,000 rows have 7 MB
                yield from run([b])

        return checked

    monkeypatch.setattr(jaccard, "_sets", watched)
    made = jaccard.Join(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1))
    made.prepare()
    assert made.sets.count() == 4000
    made.drop()


def test_stage_memory_of_a_worker_follows_the_step():
    """One long Arrow batch of texts: toxicity and line dedup hold the arrays of a short step only, and find the same as step by step."""
    import tracemalloc

    import pyarrow as pa

    r = random.Random(4)
    words = [f"word{i}" for i in range(5000)]
    texts = [" ".join(r.choices(words, k=300)) + "\n" + " ".join(r.choices(words, k=300)) for _ in range(1500)]  # 8 MB
    column = pa.array(texts)
    data, off = toxicity.C.buffers(pa.array(texts[:50]))
    keys = np.unique(toxicity.features(data, off)[0])
    model = toxicity.Model(keys, np.ones(len(keys)), 0.0, 0.1)
    whole = toxicity.Lookup(keys).held(*toxicity.C.buffers(column))
    seen = np.bincount(whole[0], minlength=len(keys))
    size = np.bincount(whole[1], minlength=len(texts)).tolist()
    del whole

    def peak(run, *columns):
        batch = pa.RecordBatch.from_arrays(list(columns), names=[f"c{i}" for i in range(len(columns))])
        toxicity.C._powers.clear()
        tracemalloc.start()
        out = [f(x) for x in run([batch])]
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert most < 50e6, most
        return out

    f = lambda x: dict(zip(np.asarray(x.column(0)).view(np.uint64).tolist(), x.column(1).to_pylist(), strict=True))
    assert peak(toxicity._frequencies(keys), column) == [{k: n for k, n in zip(keys.tolist(), seen.tolist(), strict=True) if n}]
    f = lambda x: x.column(1).value_lengths().to_pylist()
    assert sum(peak(toxicity._rows(model), pa.array([0] * len(texts)), column), []) == size
    f = lambda x: x.num_rows
    assert sum(peak(toxicity._agreed, column)) > 0
    assert sum(peak(toxicity._scores(model), pa.array(range(len(texts))), column, pa.array([False] * len(texts)))) == len(texts)
    assert sum(peak(linededup._sequences, pa.array(range(len(texts))), pa.array(range(len(texts))), column)) == len(texts)
