"""What the third round's reading found."""

import numpy as np
import pytest

from sensemill.operators import cluster as C
from sensemill.operators import disagree as D
from sensemill.operators import text as X
from sensemill.operators import vectors as VO
from sensemill.operators.hierarchy import merges_of_vectors


def test_nearly_equal_centroids_go_by_their_number(spark):
    """As in the SQL: 1000 d + c / 1000 decides."""
    rows = spark.createDataFrame([(0, [0.0, 0.0])], "k long, v array<double>")
    cents = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9999999, 0.0]), (7, [0.99999, 0.0])], "c int, mean array<double>")
    nearest = lambda **o: C.lloyd_step(rows, "k", "v", cents.where("c < 7"), "c", **o).first()
    assert nearest()["nearest"] == 2 and nearest(leaning=True)["nearest"] == 1
    assert nearest(leaning=True)["dist"] == 1.0
    assert C.lloyd_step(rows, "k", "v", cents, "c", leaning=True).first()["nearest"] == 7
    assert VO.nearest_centroid(rows, "k", "v", cents.where("c < 7"), "c", "mean", "sqeuclid", packed=1, leaning=True).first()["nearest"] == 1


def _units(n, size, seed=0):
    x = np.random.default_rng(seed).normal(size=(n, size))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _groups(spark, n, size=6):
    return spark.createDataFrame([(str(i % 2), i, [float(y) for y in v]) for i, v in enumerate(_units(2 * n, size))], "g string, k long, v array<double>")


@pytest.mark.parametrize(("linkage", "most"), [("average", None), ("average", 7), ("complete", None), ("ward", None)])
def test_trees_without_a_matrix(linkage, most):
    x = _units(700, 8)
    d = C.distances(x, "sqeuclid") / 2 if linkage == "ward" else C.distances(x, "cosine")
    assert merges_of_vectors(x, 1, linkage, most) == C.hac_merges(d, 1, linkage, most)
    assert merges_of_vectors(x, 690, linkage, most) == C.hac_merges(d, 690, linkage, most)


def test_chains_without_a_matrix():
    x = _units(90, 5)
    link = np.abs(np.subtract.outer(np.arange(90), np.arange(90))) == 1
    for k in (1, 5, 90):
        assert (C.chain(x, k) == C.connected_hac(x, link, k)).all()


def test_quantiles_modes_and_spectra_without_a_matrix(monkeypatch):
    x = _units(600, 8)
    for q in (0.0, 0.3, 1.0):
        want = np.quantile(np.sqrt(C.to_centres(x, x, "sqeuclid")), q)
        assert C.distance_quantile(x, q) == pytest.approx(want, abs=1e-7 if q == 0 else 1e-12)
        assert C.distance_quantile(x, q, bins=64, most=100) == pytest.approx(want, abs=1e-7 if q == 0 else 1e-12)
    assert C.distance_quantile(np.repeat(np.eye(2), 300, 0), 0.9, most=10) == pytest.approx(2**0.5)
    bunches = np.concatenate([np.eye(8)[i] * 3 + 0.1 * _units(200, 8, i) for i in range(3)])
    few = {m: C.METHODS[m](bunches, k=3) for m in ("ms", "sc")}
    monkeypatch.setattr(C, "DENSE", 5000)
    assert all((C.METHODS[m](bunches, k=3) == label).all() for m, label in few.items())


@pytest.mark.parametrize("method", ["ha", "chain", "ward", "ms", "sc"])
def test_groups_beyond_the_bound(spark, method):
    """Failed: the queries' groups were refused beyond MOST_ROWS."""
    out = C.label_groups(_groups(spark, C.MOST_ROWS + 50, 3), "g", "k", "v", method, most=None, k=3)
    assert out.count() == 2 * (C.MOST_ROWS + 50)
    with pytest.raises(Exception, match="60 rows"):
        C.label_groups(_groups(spark, 60), "g", "k", "v", method, most=50, k=3).count()


def test_steps_of_a_tree_by_several_tasks(spark, monkeypatch):
    df = _groups(spark, 40)
    monkeypatch.setattr(C, "STEP_ROWS", 250)
    got = {(r["g"], r["step"], r["k"]): r["label"] for r in C.merge_steps(df, "g", "k", "v").collect()}
    x = _units(80, 6)
    want = {}
    for g in (0, 1):
        for step, label in enumerate(C.labels_after(40, C.hac_merges(C.distances(x[g::2], "cosine"))), 1):
            want |= {(str(g), step, g + 2 * i): c for i, c in enumerate(label)}
    assert got == want
    assert C.merge_steps(df.where("k < 2"), "g", "k", "v").count() == 0


def test_gap_over_trees_by_several_tasks(spark):
    """The dispersion follows the merges; reference sets are rows of their own."""
    x = np.concatenate([np.eye(6)[i] * 5 + 0.2 * _units(8, 6, i) for i in range(4)])
    merges = C.tree(x)
    for m in (3, 12, 31):
        assert C.log_dispersions(x, merges)[m] == pytest.approx(C.log_dispersion(x, C.cut_tree(32, merges, 32 - m), "cosine"))
    df = spark.createDataFrame([("a", i, [float(y) for y in v]) for i, v in enumerate(x)] + [("b", 99, [1.0] * 6)], "g string, k long, v array<double>")
    got = {(r["g"], r["k"]): r["label"] for r in C.label_groups(df, "g", "k", "v", "gap_hac").collect()}
    assert [got["a", i] for i in range(32)] == C.METHODS["gap_hac"](x).tolist() and got["b", 99] == 0


def test_pairs_of_lists_by_many_tasks(spark, monkeypatch):
    """A cluster's pairs are made by as many tasks as they need; before, small tables were put together in one."""
    rows = [("c" if i % 9 else "d", "t%d" % (i % 4), i) for i in range(300)] + [("c", None, 300), ("c", "t0", 0)]
    members = spark.createDataFrame(rows, "cluster_id string, term string, obs_id long")
    alt = spark.createDataFrame([(i, "a%d" % (i % 3)) for i in range(290)] + [(5, "a9"), (300, "a1")], "obs_id long, alt string")
    of = {i: "a%d" % (i % 3) for i in range(290)}
    have = [(c, t, of[i], i) for c, t, i in rows if t and i in of]
    want = sorted((a[0], a[1], b[1], a[2], b[2], a[3], b[3]) for a in have for b in have if a[0] == b[0] and a[1:3] < b[1:3] and a[2] != b[2])
    monkeypatch.setattr(D, "TASK_PAIRS", 500)
    for block in (1024, 16):
        out = D.mismatch_pairs(members, alt, block=block)
        got = sorted(map(tuple, out.where("term_a is not null").collect()))
        assert got == want
    assert out.rdd.getNumPartitions() > 50


@pytest.mark.parametrize(("metric", "keep"), [("cosine", None), ("cosine", 0.7), ("cosine", 1e-9), ("sqeuclid", None), ("sqeuclid", 1.5)])
def test_all_pairs_in_blocks_of_keys(spark, monkeypatch, metric, keep):
    x = _units(90, 5) * np.linspace(0.5, 2, 90)[:, None]
    x[7], x[8], x[60] = x[80], 3 * x[80], 0.0
    keys = [(i * 37) % 90 - 45 for i in range(90)]
    df = spark.createDataFrame([(k, [float(y) for y in v]) for k, v in zip(keys, x, strict=True)] + [(44, [1.0, 0.0, 0.0, 0.0, 0.0])], "k long, v array<double>")
    monkeypatch.setattr(VO, "TILE", 64)
    monkeypatch.setattr(VO, "CHECKED", 7)
    rows = sorted((r["k"], r["v"]) for r in df.collect())
    far = lambda a, b: 1 - np.dot(a, b) / np.sqrt(np.dot(a, a) * np.dot(b, b)) if metric == "cosine" else ((np.array(a) - b) ** 2).sum()
    with np.errstate(invalid="ignore"):
        want = [(i, j, far(a, b)) for p, (i, a) in enumerate(rows) for j, b in rows[p + 1 :] if i < j and (keep is None or far(a, b) < keep)]
    for block in (None, 8):
        got = sorted(map(tuple, VO.all_pairs(df, "k", "v", metric, keep, block).collect()), key=lambda r: r[:2] + (str(r[2])[:9],))
        assert [g[:2] for g in got] == [w[:2] for w in sorted(want, key=lambda r: r[:2] + (str(r[2])[:9],))]
        assert np.allclose([np.nan if g[2] is None else g[2] for g in got], [w[2] for w in sorted(want, key=lambda r: r[:2] + (str(r[2])[:9],))], equal_nan=True)


def test_vectors_travel_to_few_blocks():
    """Were 601 blocks of 1024, so copies grew with the square."""
    assert VO.block_count(102_564, 64) == VO.block_count(20_000, 64) == 16
    assert VO.block_count(615_384, 64) == 19 and VO.block_count(100, 64) == 1


def test_words_meet_by_blocks_of_documents(spark):
    """A block's documents meet a word's vector or count once; plain loops over repeated keys, empty texts and unknown words."""
    texts = [(i % 40, " ".join("w%s" % "abcdefghij"[(i * j) % 10] for j in range(i % 7))) for i in range(120)] + [(500, None), (501, "zz zz")]
    docs = spark.createDataFrame(texts, "id long, t string")
    bag = {}
    for k, t in texts:
        for w in (t or "").split():
            bag[k, w] = bag.get((k, w), 0) + 1
    inside = X.bag_in_blocks(docs, "id", "t")
    assert inside.schema["_b"].metadata["blocks"] >= 8
    assert {(r["id"], r["token"]): r["tf"] for r in inside.collect()} == bag
    n, df = len({k for k, _ in bag}), {}
    for _, w in bag:
        df[w] = df.get(w, 0) + 1
    weights = {(k, w): tf * np.log2(n / df[w]) for (k, w), tf in bag.items() if df[w] < n}
    norm = {k: sum(x * x for (o, _), x in weights.items() if o == k) ** 0.5 for k, _ in weights}
    for source in (inside, X.bag_of_words(docs, "id", "t")):
        out = X.tfidf(source, "id")
        assert out.columns == ["id", "token", "w"]
        assert {(r["id"], r["token"]): pytest.approx(r["w"]) for r in out.collect()} == {(k, w): x / norm[k] for (k, w), x in weights.items()}
    vectors = spark.createDataFrame([("w%s" % c, [float(i), 1.0, -2.0 * i]) for i, c in enumerate("abcdefg")], "word string, vec array<double>")
    known = {"w%s" % c: np.array([i, 1, -2 * i], float) for i, c in enumerate("abcdefg")}
    want = {}
    for k in {k for k, _ in bag}:
        mine = [(tf, known[w]) for (o, w), tf in bag.items() if o == k and w in known]
        if mine:
            want |= {(k, i): x for i, x in enumerate(sum(tf * v for tf, v in mine) / sum(tf for tf, _ in mine))}
    for source in (inside.withColumnRenamed("token", "word"), X.bag_of_words(docs, "id", "t").withColumnRenamed("token", "word")):
        got = {(r["id"], r["dim"]): r["x"] for r in X.mean_of_word_vectors(source, "id", vectors).collect()}
        assert got.keys() == want.keys() and all(got[x] == pytest.approx(want[x]) for x in want)
