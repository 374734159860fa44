"""What the first review found in the grouping operators."""

import numpy as np
import pytest

from sensemill.operators import cluster as C
from sensemill.operators import vectors as VO
from sensemill.plans import catalog  # noqa: F401
from sensemill.plans import registry


def _bunches(n, each, size=12):
    rng = np.random.default_rng(3)
    return np.concatenate([np.eye(size)[i] * 5 + rng.normal(0, 0.05, (each, size)) for i in range(n)])[rng.permutation(n * each)]


def test_more_clusters_than_the_former_bounds():
    x = _bunches(12, 3)
    assert len(np.unique(C.METHODS["gap_hac"](x))) > 8
    assert len(np.unique(C.METHODS["dpgmm"](np.concatenate([np.zeros((200, 12)), x]), most=8))) > 8
    assert len(np.unique(C.METHODS["gap_hac"](x, min_size=12))) <= 3


def test_a_cut_tree_is_the_clustering():
    d, merges = C.distances(_bunches(4, 6), "cosine"), []
    C.hac(d, 1, merges=merges)
    assert all((C.cut_tree(24, merges, k) == C.hac(d, k)).all() for k in range(1, 25))


def test_rows_are_bounded_for_matrix_methods_alone(spark, monkeypatch):
    df = spark.createDataFrame([("g", i, [float(i % 2), 1.0]) for i in range(5001)], "g string, k long, v array<double>")
    assert C.label_groups(df, "g", "k", "v", "kmeans", k=2).count() == 5001
    with pytest.raises(Exception, match="5001 rows"):
        C.label_groups(df, "g", "k", "v", "ha").count()


def test_near_vectors_of_two_modalities(spark):
    assert "vector_duplicates" in registry.ORACLE
    rows = [(1, [1.0, 0.0], [0.0, 1.0]), (2, [1.0, 0.003], [0.0, 2.0]), (3, [1.0, 0.003], [1.0, 1.0]), (4, [0.0, 0.0], [3.0, 1.0]), (5, [0.0, 0.0], [3.0, 1.001]), (6, [1.0, 0.2], [0.0, 1.0])]
    df = spark.createDataFrame(rows, "id long, image array<double>, text array<double>")
    assert sorted(map(tuple, VO.vector_duplicates(df, "id", "image", "text").collect())) == [(1, "duplicate"), (2, "duplicate"), (4, "duplicate"), (4, "missing"), (5, "duplicate"), (5, "missing")]
