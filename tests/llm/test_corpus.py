"""Corpus operators against brute force on small tables with nulls, ties, repeated rows and clashing names."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sensemill.llm import compression, decontaminate, jaccard_join, mixing, pii, repetition, reputation, seed_extend, suffix_index, warc
from sensemill.llm import kernel as K
from sensemill.llm.components import components
from sensemill.llm.shared import Workspace

WORD = re.compile(r"[^\x20\x09-\x0D]+")
RNG = np.random.default_rng(7)
VOCAB = ["wéi", "a", "bb", "ccc", "the", "of", "x1", "Zed", "über", "q"] + [f"w{i}" for i in range(60)]


def prose(n):
    return " ".join(RNG.choice(VOCAB, n))


PASSAGE = prose(70)
TEXTS = [prose(120), prose(60) + " " + PASSAGE + " " + prose(30), PASSAGE, prose(20) + "\n" + PASSAGE, "", None, "one two", "one two", prose(10) + " " + prose(8), "la " * 300, "la " * 300 + "x"]
TEXTS += [TEXTS[0], TEXTS[0].replace(" the ", " of ", 1)]
ROWS = [(i, t) for i, t in enumerate(TEXTS)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "s", "z", 1) for i, t in ROWS], "doc_id long, text string, version string, first string, n int")


def by_id(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def test_words_and_spans():
    text = "ab  é\tz\x0bq "
    for _, _, buf, off in K.runs(__import__("pyarrow").array([text, None, "", "x"])):
        start, end, cuts = K.word_spans(buf, off)
        assert [buf[a:b].tobytes().decode() for a, b in zip(start, end)] == ["ab", "é", "z", "q", "x"]
        assert cuts.tolist() == [0, 4, 4, 4, 5]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=25), min_size=1, max_size=4))
def test_suffix_repeats(texts):
    values = np.array([x for t in texts for x in t], np.uint64)
    cuts = np.cumsum([0, *map(len, texts)])
    best = repetition.suffix_repeats(values, cuts)
    for t, lo in zip(texts, cuts):
        for i in range(len(t)):
            want = max((next((k for k in range(len(t) - max(i, j)) if t[i + k] != t[j + k]), len(t) - max(i, j)) for j in range(len(t)) if j != i), default=0)
            assert best[lo + i] == want


def test_repetition(docs):
    got = by_id(repetition.repetition_quality(docs).select("doc_id", "n_words", "n_repeat_words", "base_failed", "kept"))
    for i, t in ROWS:
        w = WORD.findall(t or "")
        at = defaultdict(list)
        for k in range(len(w) - 4):
            at[tuple(w[k : k + 5])].append(k)
        hit = {p for v in at.values() if len(v) > 1 for k in v for p in range(k, k + 5)}
        failed = len(w) < 10 or 100 * len(hit) > 20 * len(w)
        assert got[i][:3] == (len(w), len(hit), failed)
        assert not (failed and got[i][3])


@pytest.mark.parametrize(("text", "want"), [
    ("mail jo.doe[at]example[dot]com now", [("email", "jo.doe[at]example[dot]com")]),
    ("jo at example dot com", [("email", "jo at example dot com")]),
    ("ｊｏ＠ｅｘａｍｐｌｅ．ｃｏｍ", [("email", "ｊｏ＠ｅｘａｍｐｌｅ．ｃｏｍ")]),
    ("jо@example.com", [("email", "jо@example.com")]),
    ("plus one two six nine five five five three two", [("phone", "plus one two six nine five five five three two")]),
    ("look at the dot on one of two pages", []),
    ("a@b.c%d@e.f 1.2.3.4.5 999.1.1.1", [("email", "a@b.c"), ("email", "%d@e.f"), ("ip", "1.2.3.4")]),
])
def test_disguises(text, want):
    assert [(k, text[s:e]) for k, s, e in pii._both(text)[1]] == want


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="a1.@+-4 %2", max_size=40))
def test_plain_rules_are_the_patterns(text):
    got = pii.detect(text)
    assert [(s, e) for k, s, e in got if k == "email"] == [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    assert [(s, e) for k, s, e in got if k == "ip"] == [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]


def test_seed_extend(spark, docs):
    got = by_id(seed_extend.remove_repeats(spark, docs))
    words = {i: WORD.findall(t or "") for i, t in ROWS}
    first = {}
    for i, w in words.items():
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), i)
    for i, w in words.items():
        gone = {p for k in range(len(w) - 49) if first[tuple(w[k : k + 50])] < i for p in range(k, k + 50)}
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        assert got[i] == (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept)


def test_suffix_index(spark, docs):
    got = by_id(suffix_index.remove_repeated_bytes(spark, docs, batches=4).drop("kept"))
    raw = {i: (t or "").encode() for i, t in ROWS}
    count = Counter(b[k : k + 400] for b in raw.values() for k in range(len(b) - 399))
    for i, b in raw.items():
        gone = [False] * len(b)
        for k in range(len(b) - 399):
            if count[b[k : k + 400]] > 1:
                gone[k : k + 400] = [True] * 400
        spans = sum(g and (p == 0 or not gone[p - 1]) for p, g in enumerate(gone))
        assert got[i] == (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())


def test_jaccard(spark, docs):
    got = by_id(jaccard_join.jaccard_components(spark, docs, block=2).drop("version"))
    sets = {}
    for i, t in ROWS:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set()
    root = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    assert got == {i: (len(sets[i]), root[i]) for i in sets}


def test_components_by_stars(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 40) if i % 10 != 9], "u long, v long")
    got = by_id(components(Workspace(spark, "test"), edges, "c", share=5))
    assert got == {i: (i // 10 * 10,) for i in range(40)}


def test_decontamination(spark, docs):
    bench = spark.createDataFrame([(1, PASSAGE), (2, "one two"), (3, None), (4, "")], "item_id long, text string")
    for block in (1 << 20, 10):
        got = by_id(decontaminate.contamination_report(decontaminate.benchmark_hits(spark, docs, bench, block_bytes=block)))
        assert got[2][1:3] == (len(PASSAGE.split()), 1)
        assert got[6][1] == 2 and got[6][4] and got[4] == (0, 0, 0, hashlib.sha256(b"").hexdigest(), False)
    left = {r.doc_id: r.text for r in decontaminate.clean(spark, docs, bench).collect()}
    assert 2 not in left and left[0] == TEXTS[0] and left[5] is None


def test_mix(spark):
    rows = [(i, prose(int(RNG.integers(1, 30))), f"s{i % 3}" if i % 7 else None) for i in range(300)] + [(0, None, "s0"), (3, "a b", "s0")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.weighted_mix(spark, df)
    got = sorted(out.collect(), key=str)
    assert got == sorted(mixing.weighted_mix(spark, df).collect(), key=str) and len(got) == len(rows)
    taken, target = defaultdict(int), {}
    for r in got:
        assert r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= 30 for s in target)


def test_classifier_ranks_and_blank_texts(spark):
    good, bad = [prose(50).encode() for _ in range(60)], [("BUY!! NOW%%% " * 20 + prose(5)).encode() for _ in range(60)]
    model = compression.fit(good, bad)
    s = model.scores([prose(50).encode(), b"BUY!! NOW%%% " * 15, b"", b" "])
    assert s[0] > 0.5 > s[1] and s[2] == s[3] == model.prior
    assert 0 < compression.fit(good, []).scores([b"abc"])[0] < 1


def test_reputation(spark):
    pages = [(i, f"http://bad.example.net/en/{i}") for i in range(3)] + [(10, None), (11, "no"), (12, "HTTP://A.Example.ORG?x"), (13, "http://a.example.org/es/x"), (14, "http://a.com/de/"), (14, "http://a.com/de/")]
    rules = [reputation.Rule("allow", "org", "/"), reputation.Rule("block", "example.org", "/es/"), reputation.Rule("block", "com", "/de/")]
    got = by_id(reputation.judge_urls(spark, spark.createDataFrame(pages, "page_id long, url string"), rules).select("page_id", "host", "path", "rule", "verdict"))
    assert got[10][:3] == ("", "", None) and got[12][:3] == ("a.example.org", "", None) and got[13] == ("a.example.org", "/es/x", "example.org/es/", "block") and got[14][3] == "block"


def test_warc_round_trip(spark, tmp_path):
    pages = [(1, "http://a/", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "http://b/\n", None), (4, "http://c/", ""), (5, "http://d/", "x" * 100_000)]
    path = f"file://{tmp_path}/w"
    warc.archive_pages(spark, spark.createDataFrame(pages, "page_id long, url string, html string"), path)
    read = spark.read.format("warc").load(path)
    got = {r.record_id: r for r in read.collect()}
    assert got["urn:page:2"].record_type == "revisit" and got["urn:page:2"].refers_to == "urn:page:1" and got["urn:page:2"].payload_length == len("<p>é</p>".encode())
    assert bytes(got["urn:page:1"].payload).decode() == "<p>é</p>" and got["urn:page:4"].refers_to == "urn:page:3" and len(got["urn:page:5"].payload) == 100_000
    only = spark.read.format("warc").option("payload", "false").load(path).where(F.col("record_type") == "revisit")
    assert only.count() == 2 and got["urn:page:5"].payload_digest == warc.sha1_base32(b"x" * 100_000)


@pytest.mark.parametrize("run", [
    lambda s, e: repetition.repetition_quality(e), lambda s, e: pii.find_pii(e), lambda s, e: mixing.weighted_mix(s, e), lambda s, e: seed_extend.remove_repeats(s, e),
    lambda s, e: suffix_index.remove_repeated_bytes(s, e), lambda s, e: jaccard_join.jaccard_components(s, e), lambda s, e: decontaminate.benchmark_hits(s, e, e, item_col="doc_id"),
])
def test_empty_tables(spark, run):
    assert run(spark, spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
