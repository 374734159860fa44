"""Grouping operators against plain loops, sources round trip, numbering and blocks."""

import itertools
import warnings

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sensemill.operators import cluster as C
from sensemill.operators import graph as G
from sensemill.operators import text as X
from sensemill.operators import vectors as VO
from sensemill.sources import io
from sensemill.sources.workspace import Workspace, numbered
from sensemill.streaming.incremental import windowed_counts


def groups_of(label):
    return sorted(sorted(np.flatnonzero(label == c).tolist()) for c in np.unique(label))


def plain_hac(n, k, distance, most=None):
    groups = [[i] for i in range(n)]
    while len(groups) > k:
        pairs = [(distance(a, b), a[0], b[0]) for a, b in itertools.combinations(groups, 2) if most is None or len(a) + len(b) <= most]
        if not pairs or min(pairs)[0] == np.inf:
            break
        _, i, j = min(pairs)
        a, b = (next(g for g in groups if g[0] == x) for x in (i, j))
        groups.remove(b)
        a += b
    return sorted(map(sorted, groups))


@settings(max_examples=20, deadline=None)
@given(st.integers(2, 14), st.integers(1, 5), st.integers(0, 10**6))
def test_linkages(n, k, seed):
    x = np.random.default_rng(seed).normal(size=(n, 4))
    k, d = min(n, k), C.distances(x, "cosine")
    assert groups_of(C.hac(d, k, "complete")) == plain_hac(n, k, lambda a, b: d[np.ix_(a, b)].max())
    assert groups_of(C.hac(d, k, max_size=3)) == plain_hac(n, k, lambda a, b: d[np.ix_(a, b)].mean(), most=3)
    inertia = lambda g: ((x[g] - x[g].mean(0)) ** 2).sum()
    assert groups_of(C.ward(x, k)) == plain_hac(n, k, lambda a, b: inertia(a + b) - inertia(a) - inertia(b))


def test_kl_recomputed_after_each_merge():
    rng = np.random.default_rng(5)
    m, v = rng.normal(size=(9, 3)), rng.uniform(0.5, 2, (9, 3))
    d = np.stack([C.symmetric_kl(m[i], v[i], m, v) for i in range(9)])
    mean, var = (lambda z: lambda g: z[g].mean(0))(m), (lambda z: lambda g: z[g].mean(0))(v)  # every leaf weighs the same
    want = plain_hac(9, 3, lambda a, b: C.symmetric_kl(mean(a), var(a), mean(b), var(b)))
    assert groups_of(C.hac(d, 3, mean=m, var=v)) == want
    both = C.symmetric_kl(m[0], v[0], m[1], v[1], cut=1)
    assert both == pytest.approx((C.symmetric_kl(m[0, :1], v[0, :1], m[1, :1], v[1, :1]) + C.symmetric_kl(m[0, 1:], v[0, 1:], m[1, 1:], v[1, 1:])) / 2)


def test_connectivity_joins_components_at_their_nearest_pair():
    x = np.array([[1, 0], [1, 0.1], [0, 1], [0.1, 1.0], [1, 1]], float)
    link = np.zeros((5, 5), bool)
    link[0, 1] = link[2, 3] = True
    d = C.repair_connectivity(C.distances(x, "cosine"), link)
    assert np.isfinite(d[0, 1]) and np.isfinite(d[2, 3]) and (np.isfinite(d).sum() // 2) == 4 and np.isinf(d[0, 2])
    assert len(np.unique(C.connected_hac(x, link, 1))) == 1
    apart = np.full((4, 4), np.inf)
    apart[0, 1] = apart[1, 0] = 0.1
    assert len(np.unique(C.hac(apart, 1))) == 3  # without neighbours nothing merges


def test_labels_after_each_merge():
    x = np.random.default_rng(2).normal(size=(8, 3))
    d = C.distances(x, "cosine")
    steps = list(C.labels_after(8, C.hac_merges(d)))
    assert [len(np.unique(s)) for s in steps] == [7, 6, 5, 4, 3, 2, 1]
    assert all((s == C.hac(d, 7 - i)).all() for i, s in enumerate(steps))


def test_merge_test_and_buckshot():
    rng = np.random.default_rng(1)
    one, far = rng.normal([5, 0, 0], 0.3, (40, 3)), rng.normal([0, 5, 0], 0.3, (40, 3))
    label = np.repeat([0, 1], 40)
    assert not C.merge_test(np.concatenate([one, far]), label, references=20)[0]
    halves = np.argsort(np.argsort(rng.random(80))) % 2
    assert C.merge_test(np.concatenate([one, one + rng.normal(0, 0.3, one.shape)]), halves, references=20)[0]
    x = np.concatenate([one, far])
    own = np.repeat(np.arange(4), 2)
    got = C.buckshot(x, x[[0, 1, 10, 11, 40, 41, 50, 51]], own[:, None] == own[None], 2)
    assert groups_of(got) == [list(range(40)), list(range(40, 80))]


def test_linear_svm_separates():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(2, 0.5, (30, 4)), rng.normal(-2, 0.5, (30, 4))])
    y = np.repeat([1.0, -1.0], 30)
    w = C.linear_svm(x, y)
    assert (np.sign(x @ w[:-1] + w[-1]) == y).all()
    loss = lambda w: w @ w / 2 + (np.maximum(0, 1 - y * (np.column_stack([x, np.ones(60)]) @ w)) ** 2).sum()
    assert all(loss(w) <= loss(w + e) for e in rng.normal(0, 0.01, (50, 5)))


def test_random_unit_vectors():
    assert np.linalg.norm(C.random_unit(10, 7), axis=1) == pytest.approx(np.ones(10))


def walk(pairs):
    used, out = set(), []
    for i, j in sorted(pairs):
        if not {i, j} & used:
            used |= {i, j}
            out.append((i, j))
    return out


def test_matching_and_collapse_are_the_walk(spark):
    rng = np.random.default_rng(4)
    pairs = {tuple(sorted(map(int, p))) for p in rng.integers(0, 25, (60, 2)) if p[0] != p[1]}
    got = C.first_matching(spark.createDataFrame(sorted(pairs), "i long, j long"), Workspace(spark, "test"), "m")
    assert sorted(map(tuple, got.collect())) == walk(pairs)
    sets = [set(map(int, rng.choice(8, int(rng.integers(1, 5)), replace=False))) for _ in range(30)]
    now = [(s, 1) for s in sets]
    while picked := walk([(i, j) for (i, (a, _)), (j, (b, _)) in itertools.combinations(enumerate(now), 2) if len(a) > 1 and len(b) > 1 and (a < b or b < a)]):
        gone = {x for p in picked for x in p}
        now = [x for i, x in enumerate(now) if i not in gone] + [(now[i][0] | now[j][0], now[i][1] + now[j][1]) for i, j in picked]
    out = C.collapse_subsets(spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], "k long, m array<long>"), "k", "m").orderBy("place").collect()
    assert [(set(r.m), r.merged) for r in out] == now


def test_balanced_subgraph(spark):
    pairs = [(f"c{i}", f"t{j}") for i in range(12) for j in range(12) if (i * 7 + j * 5) % 6 == 0] + [(f"d{i}", f"u{i}") for i in range(20)]
    ct = spark.createDataFrame(pairs, "concept_id string, term string")
    rows = G.balanced_subgraph(ct, 8, "s").collect()
    assert {(r.concept_id, r.term) for r in rows} <= set(pairs) and len(rows) == len({(r.concept_id, r.term) for r in rows})
    for idx, name in (("concept_idx", "concept_id"), ("term_idx", "term")):
        names = {r[name]: r[idx] for r in rows}
        assert sorted(names.values()) == list(range(len(names)))
    assert sum(r.concept_id.startswith("d") for r in rows) == 9  # one more while there are no more than 8
    a, b, c, d, e = (("p", "x"), ("p", "y"), ("q", "x"), ("r", "z"), ("s", "w"))
    assert G.chosen_nodes([(a, b)], [(a, c)], [d, e], None) == ([a, b, c, d, e], [True, True, True])
    assert G.chosen_nodes([(a, b)] * 3, [(a, c)], [d, e], 0) == ([a, b, c, d], [False] * 3)


def test_numbers_without_gaps(spark):
    df = spark.createDataFrame([(x, f"{x % 7}") for x in range(500)] + [(None, "z")], "a long, b string")
    got = numbered(df, ["b", "a"], "n").orderBy("n").collect()
    assert [r.n for r in got] == list(range(501)) and [(r.b, r.a) for r in got] == sorted(((f"{x % 7}", x) for x in range(500)), key=lambda t: t) + [("z", None)]


def test_blocks_change_nothing(spark):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(i, rng.normal(size=3).tolist()) for i in range(40)], "k long, v array<double>")
    cents = df.where("k % 4 = 0").select(F.col("k").alias("c"), F.col("v").alias("m"))
    rows = [sorted(map(tuple, VO.nearest_centroid(df, "k", "v", cents, "c", "m", "sqeuclid", packed=n).select("k", "nearest", "dist").collect())) for n in (1000, 3)]
    assert rows[0] == rows[1]
    stats = df.select("k", F.col("v").alias("mean"), F.col("v").alias("var"))
    dist = F.round(F.col("m1")[0] - F.col("m2")[1], 9)
    pairs = [sorted(map(tuple, VO.pair_stats(stats, "k", dist, block=n).collect())) for n in (1000, 7)]
    assert pairs[0] == pairs[1] and len(pairs[0]) == 40 * 39 // 2


def test_sources(spark, tmp_path):
    at = lambda n: str(tmp_path / n)
    df = spark.createDataFrame([(f"k{i:02}", i) for i in range(10)], "k string, v int")
    io.write_table(df, at("t"))
    io.write_table(df.limit(3), at("t"))
    assert spark.read.parquet(at("t")).count() == 3
    slices = {r.k: r.slice for r in io.in_ranges(df, "k", 3).collect()}
    assert [slices[f"k{i:02}"] for i in range(10)] == [next(s for s in range(3) if int(s * 10 / 3) <= i < int((s + 1) * 10 / 3)) for i in range(10)]
    io.write_ranges(df, "k", 4, at("r"))
    assert spark.read.parquet(at("r")).count() == 10
    parts = df.withColumn("slice", F.col("v") % 3)
    assert io.write_missing(parts.where("slice < 2"), "slice", at("m")) == []
    assert io.write_missing(parts, "slice", at("m")) == ["0", "1"] and spark.read.parquet(at("m")).count() == 10
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        got = {r.k: r.v for r in io.union_last([df, df.where("v < 2").withColumn("v", F.lit(99))], "k", warn=True).collect()}
    assert any("2 keys" in str(w.message) for w in said) and got["k00"] == 99 and got["k05"] == 5
    nested = df.withColumn("x", F.lit(1))
    io.write_nested(nested, ["k", "v"], at("n"))
    io.write_nested(nested.limit(0), ["k", "v"], at("n"))
    assert len(list((tmp_path / "n").glob("k=*/v=*"))) == 10
    got = io.extract_features(df.withColumn("b", F.col("k").cast("binary")), "v", "b", lambda xs: [[len(xs), xs[0][0]] for _ in xs], batch=4)
    assert all(r.vec[0] <= 4 and r.vec[1] == ord("k") for r in got.collect()) and got.count() == 10
    (tmp_path / "list.txt").write_text(" N1 \n\nn2\n")
    assert [r[0] for r in io.read_list(spark, at("list.txt")).collect()] == ["n1", "n2"]
    io.write_results(spark.createDataFrame([("a", 1), ("b", None)], "p string, q int").withColumnRenamed("q", " q "), at("csv"))
    assert [tuple(r) for r in io.read_results(spark, at("csv")).collect()] == [("a", "1")]
    (tmp_path / "vec.txt").write_text("2 3\ncat 1 2 3\ndog 4 5 6\n")
    assert {r.word: r.vec for r in io.read_word_vectors(spark, at("vec.txt")).collect()} == {"cat": [1, 2, 3], "dog": [4, 5, 6]}
    assert io.read_word_list(spark, at("list.txt")).count() == 2
    for name in ("run_gap_ms_0.v.txt", "run_gap_1.v.txt", "other.txt"):
        (tmp_path / "runs").mkdir(exist_ok=True)
        (tmp_path / "runs" / name).write_text("x")
    assert [tuple(r)[1:] for r in io.run_files(spark, at("runs")).collect()] == [("gap", "ms", "0", "v")]
    found = io.parse_search(spark.createDataFrame([('{"links": ["u"], "title": ["t"]}',)], "r string"), "r").first()
    assert found.links == ["u"] and found.title == ["t"] and found.description is None


def test_windows_of_words(spark):
    docs = spark.createDataFrame([(1, "a b of the c d e f"), (2, "of the")], "id long, t string")
    vectors = spark.createDataFrame([("a", [1.0]), ("c", [3.0]), ("f", [50.0])], "word string, vec array<double>")
    means = X.mean_in_windows(docs, "id", "t", ["of", "the"], vectors)
    assert [tuple(r) for r in X.or_zeros(docs, "id", means, 1).orderBy("id").collect()] == [(1, 0, 2.0), (2, 0, 0.0)]


def test_windowed_counts(spark, tmp_path):
    spark.createDataFrame([("2026-01-01 00:10:00", "a"), ("2026-01-01 00:50:00", "a"), ("2026-01-01 01:10:00", "b")], "ts string, k string").write.parquet(str(tmp_path / "in"))
    stream = windowed_counts(spark.readStream.schema("ts string, k string").parquet(str(tmp_path / "in")), "ts", "k")
    query = stream.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r.n for r in spark.table("counts").collect()) == [1, 2]


def test_topics_are_the_singular_vectors(spark):
    rng = np.random.default_rng(9)
    low = rng.normal(size=(40, 3)) @ np.diag([9.0, 5.0, 2.0]) @ rng.normal(size=(3, 25)) + rng.normal(0, 0.05, (40, 25))
    low[np.abs(low) < 1] = 0
    weights = spark.createDataFrame([(int(i), f"t{j}", float(low[i, j])) for i, j in zip(*np.nonzero(low))], "id long, token string, w double")
    got = np.array([r.topics for r in X.lsi_topics(weights, "id", 3, steps=6).orderBy("id").collect()])
    u, s, _ = np.linalg.svd(low)
    want = u[:, :3] * s[:3]
    assert np.abs(got) == pytest.approx(np.abs(want), abs=1e-3 * s[0])


def test_pairs_by_blocks(spark):
    from sensemill.operators import disagree as D

    members = spark.createDataFrame([(i % 2, f"t{i % 3}", i) for i in range(60)], "cluster_id long, term string, obs_id long")
    alt = spark.createDataFrame([(i, f"a{i % 4}") for i in range(60)], "obs_id long, alt string")
    pairs = [sorted(map(tuple, D.mismatch_pairs(members, alt, block=n).collect())) for n in (4096, 7)]
    assert pairs[0] == pairs[1] and len(pairs[0]) == sum(i % 2 == j % 2 and i % 4 != j % 4 for i in range(60) for j in range(i))


def test_files_follow_what_is_read(spark):
    part = spark.read.parquet("/root/testdata/sf0.001/part.parquet").select("p_partkey")
    one = Workspace(spark, "sized", part).files
    many = part
    for i in range(6):
        many = many.join(part.withColumnRenamed("p_partkey", f"k{i}"), F.col("p_partkey") > F.col(f"k{i}"))
    assert Workspace(spark, "sized", many).files == one == spark.sparkContext.defaultParallelism
    assert Workspace(spark, "sized", spark.createDataFrame([(1,)], "a long")).files is None
