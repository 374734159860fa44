import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from oracle_check import compare, connect
from sensemill.functions import vectors as V
from sensemill.operators import cluster as C
from sensemill.operators import disagree as D
from sensemill.operators import graph as G
from sensemill.operators import observations as O
from sensemill.operators import scoring as S
from sensemill.operators import stats as R
from sensemill.plans import catalog  # noqa: F401
from sensemill.plans import registry
from sensemill.sources import io

SF = "/root/testdata/sf0.001"


#: Queries of several seconds, run by tests of their own on smaller groups.
SLOW = {"gap_select_k", "gap_hac_select_k", "merge_senses_ha"}


@pytest.mark.parametrize("name", [n for n in registry.QUERIES if n not in SLOW])
def test_every_query_runs_and_matches_its_sql(spark, name):
    df = registry.QUERIES[name](spark, SF)
    if name in registry.ORACLE:
        assert compare(df, connect(SF), registry.ORACLE[name]) == ""
    else:
        assert len(df.collect()) > 0


def test_scores_from_counts(spark):
    """V and pair counts of a table, computed from lists of labels, one pair at a time."""
    table = [[4, 0, 1], [1, 5, 0], [0, 2, 6], [2, 2, 0]]
    labels = [(i, j) for i, row in enumerate(table) for j, n in enumerate(row) for _ in range(n)]
    p = lambda xs: [xs.count(x) / len(xs) for x in set(xs)]
    entropy = lambda xs: -sum(q * math.log(q) for q in p(xs))
    classes, clusters = [c for c, _ in labels], [k for _, k in labels]
    h, hk, joint = entropy(classes), entropy(clusters), entropy(labels)
    homogeneity, completeness = 1 - (joint - hk) / h, 1 - (joint - h) / hk
    cells = spark.createDataFrame([(i, j, n) for i, row in enumerate(table) for j, n in enumerate(row) if n], "class_id int, cluster_id int, n long")
    r = S.v_measure(cells).first()
    assert (r.homogeneity, r.completeness, r.v) == pytest.approx((homogeneity, completeness, 2 * homogeneity * completeness / (homogeneity + completeness)), abs=1e-6)
    same = sum(labels[a] == labels[b] for a in range(len(labels)) for b in range(a))
    in_clusters = sum(clusters[a] == clusters[b] for a in range(len(labels)) for b in range(a))
    f = S.paired_f(cells).first()
    assert (f.same, f.in_clusters) == (same, in_clusters)


def test_gold_against_gold(spark):
    g = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "c string, o int")
    assert S.v_measure(S.contingency(g, "c", "c")).first().v == 1
    assert S.paired_f(S.contingency(g, "c", "c")).first().f == 1


def test_single_class_scores_one(spark):
    g = spark.createDataFrame([("a", 1), ("a", 2)], "c string, o int")
    assert S.v_measure(S.contingency(g, "c", "o")).first().homogeneity == 1


def test_last_concept_decides_ambiguity(spark):
    ct = spark.createDataFrame([("c1", "bat"), ("c1", "club"), ("c2", "bat"), ("c3", "club"), ("c3", "mace")], "concept_id string, term string")
    assert {r.term for r in G.ambiguous_terms(ct).collect()} == {"bat", "club"}
    assert {r.term for r in G.ambiguous_terms(ct, literal=True).collect()} == {"bat"}


def test_even_split_boundaries(spark):
    ct = spark.createDataFrame([("c", t) for t in "xyz"], "concept_id string, term string")
    obs = spark.createDataFrame([("c", i) for i in range(7)], "concept_id string, obs_id int")
    assert [r.n for r in O.term_obs_assign(ct, obs, "s").groupBy("term").agg(F.count("*").alias("n")).orderBy("term").collect()] == [2, 2, 3]


def test_shares(spark):
    obs = spark.createDataFrame([("a", i) for i in range(10)] + [("b", i) for i in range(2)], "k string, obs_id int")
    got = {(r.k, r.part): r.n for r in O.split_partitions(obs, "k", [0.5, 0.3, 0.2], "s").groupBy("k", "part").agg(F.count("*").alias("n")).collect()}
    assert got == {("a", 0): 5, ("a", 1): 3, ("a", 2): 2}


def test_kl_of_equals_is_zero(spark):
    df = spark.createDataFrame([([1.0, 2.0], [0.5, 0.2])], "m array<double>, v array<double>")
    assert df.select(V.symmetric_kl(F.col("m"), F.col("v"), F.col("m"), F.col("v"), True).alias("x")).first().x == 0


def test_fusion_weights():
    assert [V.fusion_redundancy(w, 4096, 256) for w in (0.0, 1.0, 0.5)] == [(0, 1), (1, 0), (1, 16)]


def test_constraints():
    assert R.parse_constraints("a=x,b<3,b>2") == {"a": ("=", "x"), "b": (">", "2")}
    with pytest.raises(ValueError):
        R.parse_constraints("a>=3")


def test_none_counts_as_zero(spark):
    df = spark.createDataFrame([("x", "None", "q"), ("x", "4", "2")], "b string, h string, g string")
    got = {r.header: r.avg for r in R.batch_stats(R.unpivot(df, "b", ["h", "g"])).collect()}
    assert got == {"h": 2.0, "g": None}


def test_t_pvalue():
    assert R.t_pvalue(2.228139, 10) == pytest.approx(0.05, abs=1e-6)
    assert R.t_pvalue(0.0, 5) == pytest.approx(1)


def test_cdf_cut(spark):
    cdf = spark.createDataFrame([(5.0, 0.5), (3.0, 0.8), (1.0, 0.9), (1.0, 1.0)], "weight double, cdf double")
    assert sorted(r.share for r in D.cdf_cut(cdf, 0.5, 0.9).collect()) == [0.25, 0.75]


def test_collapse_exempts_singletons(spark):
    sets = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate([{1, 2}, {1, 2, 3}, {4}, {4, 5}, {6, 7}])], "k long, m array<long>")
    assert sorted(sorted(r.m) for r in C.collapse_subsets(sets, "k", "m").collect()) == [[1, 2, 3], [4], [4, 5], [6, 7]]


@settings(max_examples=25, deadline=None)
@given(st.integers(2, 12), st.integers(1, 12), st.integers(0, 10**6))
def test_hac_has_k_labels(n, k, seed):
    x = np.random.default_rng(seed).normal(size=(n, 3))
    k = min(n, k)
    assert len(np.unique(C.hac(C.distances(x, "cosine"), k))) == k


def test_hac_against_plain_average_linkage():
    x = np.random.default_rng(1).normal(size=(14, 4))
    d = C.distances(x, "cosine")
    groups = [[i] for i in range(len(x))]
    while len(groups) > 4:
        _, i, j = min((d[np.ix_(groups[i], groups[j])].mean(), i, j) for i in range(len(groups)) for j in range(i + 1, len(groups)))
        groups[i] += groups.pop(j)
    label = C.hac(d, 4)
    assert sorted(map(sorted, groups)) == sorted(sorted(np.flatnonzero(label == c).tolist()) for c in range(4))


def test_small_clusters_dissolve():
    x = np.random.default_rng(2).normal(size=(20, 3))
    label = C.collapse_small(x, C.kmeans(x, 8), 4)
    assert np.bincount(label).min() >= 4


def test_sources_round_trip(spark, tmp_path):
    (tmp_path / "p.tsv").write_text("N1\tBat, Club\nN2\tbat\n")
    assert {(r.concept_id, r.term) for r in io.read_pairs(spark, str(tmp_path / "p.tsv")).collect()} == {("n1", "bat"), ("n1", "club"), ("n2", "bat")}
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    io.write_by_key(df, "k", str(tmp_path / "k"))
    assert io.read_key(spark, str(tmp_path / "k"), "k", "b").first().v == 2
    assert {(r.k, r.v) for r in io.union_last([df, df.where("k = 'a'").withColumn("v", F.lit(9))], "k").collect()} == {("a", 9), ("b", 2)}
