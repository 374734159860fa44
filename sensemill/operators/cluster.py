"""Clustering: Lloyd steps on DataFrames; gap statistic, collapse and HAC inside bounded groups."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectors as VO
from .hierarchy import merges_of_vectors, unit_rows
from ..functions import vectors as V
from ..sources.workspace import Workspace, numbered

#: Rows of one group that methods with a full distance matrix take, if not told otherwise; larger groups are refused, not cut.
MOST_ROWS = 5000
#: Rows up to which a matrix of distances is made; beyond, methods work on the vectors, by so many rows at once.
DENSE, ROWS = 512, 256
#: Rows that one task makes of a tree's steps, about.
STEP_ROWS = 8 << 20


def centroids(df: DataFrame, cluster: str, vec: str, size: int) -> DataFrame:
    """cluster, mean as an array of ``size``."""
    sums = [F.avg(V.as_doubles(F.col(vec))[i]).alias(f"d{i}") for i in range(size)]
    return df.groupBy(cluster).agg(*sums).select(cluster, F.array(*(F.col(f"d{i}") for i in range(size))).alias("mean"))


def lloyd_step(df: DataFrame, key: str, vec: str, cents: DataFrame, cluster: str, metric: str = "sqeuclid", leaning: bool = False) -> DataFrame:
    """Each row with its nearest centroid; ``leaning`` as in ``nearest_centroid``."""
    return VO.nearest_centroid(df, key, vec, cents, cluster, "mean", metric, leaning=leaning)


def kmeans_fixed_init(df: DataFrame, key: str, vec: str, k: int, steps: int, size: int, metric: str = "sqeuclid", leaning: bool = False) -> DataFrame:
    """Lloyd's algorithm from the first k rows, a fixed number of steps.

    A step collects k centroids; rows stay where they are.  ``leaning`` as in ``nearest_centroid``.
    """
    start = df.orderBy(key).limit(k).select(key, V.as_doubles(F.col(vec)).alias("mean")).collect()
    spark = df.sparkSession
    cents = [(i, list(r["mean"])) for i, r in enumerate(sorted(start, key=lambda r: r[key]))]
    for step in range(steps):
        placed = lloyd_step(df, key, vec, spark.createDataFrame(cents, "c int, mean array<double>"), "c", metric, leaning)
        if step + 1 == steps:
            return placed.select(key, F.col("nearest").alias("label"))
        cents = [(r["nearest"], list(r["mean"])) for r in centroids(placed, "nearest", vec, size).collect()]
    raise ValueError("steps must be 1 or more")


def dispersion(df: DataFrame, cluster: str, vec: str, cents: DataFrame, metric: str = "sqeuclid") -> DataFrame:
    """W: over clusters, the sum of distances to the centroid over twice the size."""
    met = df.join(cents.withColumnRenamed(cluster, "_c"), F.col(cluster) == F.col("_c"))
    per = met.groupBy("_c").agg((F.sum(V.DISTANCES[metric](V.as_doubles(F.col(vec)), F.col("mean"))) / (2 * F.count("*"))).alias("w"))
    return per.agg(F.round(F.sum("w"), 6).alias("wk"), F.count("*").alias("k"))


# ----------------------------------------------------------- methods in memory


def distances(x: np.ndarray, metric: str, cut: int | None = None) -> np.ndarray:
    """Matrix of distances; weighted cosine is the mean over two modalities cut at ``cut``."""
    if metric == "weighted_cosine":
        return (distances(x[:, :cut], "cosine") + distances(x[:, cut:], "cosine")) / 2
    if metric == "cosine":
        n = np.linalg.norm(x, axis=1)
        return 1 - x @ x.T / np.where(n[:, None] * n[None] == 0, 1, n[:, None] * n[None])
    return np.maximum((x**2).sum(1)[:, None] + (x**2).sum(1)[None] - 2 * x @ x.T, 0)


def to_centres(x: np.ndarray, c: np.ndarray, metric: str) -> np.ndarray:
    if metric == "cosine":
        n = np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(c, axis=1)[None]
        return 1 - x @ c.T / np.where(n == 0, 1, n)
    return np.maximum((x**2).sum(1)[:, None] + (c**2).sum(1)[None] - 2 * x @ c.T, 0)


def kmeans(x: np.ndarray, k: int, metric: str = "cosine", steps: int = 100) -> np.ndarray:
    """Lloyd's algorithm from the first k rows; an emptied cluster keeps its centre."""
    if k == 1:
        return np.zeros(len(x), int)
    c, label, cosine = x[:k].copy(), None, metric == "cosine"
    rows = unit_rows(x) if cosine else x
    square = None if cosine else (x**2).sum(1)[:, None]
    for _ in range(steps):
        d = 1 - rows @ unit_rows(c).T if cosine else np.maximum(square + (c**2).sum(1)[None] - 2 * rows @ c.T, 0)
        new = d.round(12).argmin(1)
        if label is not None and (new == label).all():
            break
        label = new
        n = np.bincount(label, minlength=k)
        sums = (label[None] == np.arange(k)[:, None]).astype(float) @ x
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return label


def log_dispersion(x: np.ndarray, label: np.ndarray, metric: str) -> float:
    w = 0.0
    for c in np.unique(label):
        part = x[label == c]
        w += to_centres(part, part.mean(0, keepdims=True), metric).sum() / (2 * len(part))
    return float(np.log(w)) if w > 0 else -np.inf


def gap_rule(gaps: list[float], errors: list[float]) -> int:
    """Index of the first k with gap(k) >= gap(k + 1) - s(k + 1); the last one if there is none."""
    for i in range(len(gaps) - 1):
        if gaps[i] >= gaps[i + 1] - errors[i + 1]:
            return i
    return len(gaps) - 1


def k_by_gap(x: np.ndarray, most: int, references: int = 100, metric: str = "cosine", seed: int = 0, least: int = 1) -> tuple[int, np.ndarray]:
    """Number of clusters by the gap statistic, ascending from ``least``, and the labels."""
    lo, hi = x.min(0), x.max(0)
    gaps, errors, labels = [], [], []
    least = max(1, min(least, most))
    for k in range(least, max(least, most) + 1):
        labels.append(kmeans(x, k, metric))
        own = log_dispersion(x, labels[-1], metric)
        refs = []
        for b in range(references):
            u = np.random.default_rng([seed, k, b]).uniform(lo, hi, x.shape)
            refs.append(log_dispersion(u, kmeans(u, k, metric), metric))
        gaps.append(float(np.mean(refs)) - own)
        errors.append(float(np.std(refs)) * (1 + 1 / references) ** 0.5)
        if len(gaps) > 1 and gaps[-2] >= gaps[-1] - errors[-1]:
            return k - 1, labels[-2]
    return least + len(labels) - 1, labels[-1]


def cut_tree(n: int, merges: list[tuple[int, int]], k: int) -> np.ndarray:
    """The k clusters of n rows that the first n - k merges leave."""
    parent = np.arange(n)
    for i, j in merges[: n - k]:
        parent[parent == j] = i
    return np.unique(parent, return_inverse=True)[1]


def tree(x: np.ndarray, k: int = 1, linkage: str = "average", max_size: int | None = None) -> list[tuple[int, int]]:
    """Merges of vectors by cosine distance (ward: halved squared Euclidean), see ``hac_merges``; without a matrix beyond DENSE rows."""
    if len(x) > DENSE:
        return merges_of_vectors(x, k, linkage, max_size)
    return hac_merges(distances(x, "sqeuclid") / 2 if linkage == "ward" else distances(x, "cosine"), k, linkage, max_size)


def cut(x: np.ndarray, k: int, **options) -> np.ndarray:
    """Labels of ``tree`` down to k clusters, or as near as sizes allow."""
    found = tree(x, k, **options)
    return cut_tree(len(x), found, len(x) - len(found))


def log_dispersions(x: np.ndarray, merges: list[tuple[int, int]]) -> np.ndarray:
    """log W by cosine after 0, 1, 2... merges of a tree, from sums of members; clusters of equal directions have none."""
    n = len(x)
    sums, units, size = x.astype(float).copy(), unit_rows(x.astype(float)), np.ones(n)
    both, dirs, sizes = np.empty((len(merges), x.shape[1])), np.empty((len(merges), x.shape[1])), np.empty(len(merges))
    for m, (i, j) in enumerate(merges):
        sums[i] += sums[j]
        units[i] += units[j]
        size[i] += size[j]
        both[m], dirs[m], sizes[m] = sums[i], units[i], size[i]
    w = (1 - (dirs * unit_rows(both)).sum(1) / sizes) / 2
    w = np.where(w < 1e-14, 0.0, w)
    own, change = (np.linalg.norm(x, axis=1) == 0) / 2.0, np.empty(len(merges))  # a zero vector is at 1 from any, itself too
    total = own.sum()
    for m, (i, j) in enumerate(merges):
        change[m] = w[m] - own[i] - own[j]
        own[i] = w[m]
    with np.errstate(divide="ignore"):
        return np.log(np.maximum(np.concatenate([[total], total + np.cumsum(change)]), 0))


def reference(lo: np.ndarray, hi: np.ndarray, n: int, seed: int, b: int) -> np.ndarray:
    """``log_dispersions`` of the tree over a reference set."""
    u = np.random.default_rng([seed, b]).uniform(lo, hi, (n, len(lo)))
    return log_dispersions(u, tree(u))


def k_by_gap_of_trees(x: np.ndarray, start: int, refs: np.ndarray) -> tuple[int, np.ndarray]:
    """The rule of ``k_by_gap_descending``, from the references' ``log_dispersions`` (a row each)."""
    n, merges = len(x), tree(x)
    with np.errstate(invalid="ignore"):
        gaps, errors = refs.mean(0) - log_dispersions(x, merges), refs.std(0) * (1 + 1 / len(refs)) ** 0.5
        armed = False
        for k in range(start, 1, -1):
            gap = gaps[n - k + 1] - (gaps[n - k] - errors[n - k])
            if gap >= 0:
                armed = True
            elif armed:
                return k, cut_tree(n, merges, k)
    return 1, cut_tree(n, merges, 1)


def k_by_gap_descending(x: np.ndarray, start: int, references: int = 100, seed: int = 0) -> tuple[int, np.ndarray]:
    """Number of clusters by the gap statistic over an agglomerative tree, from ``start`` downwards.

    The first step with a gap of 0 or more arms the rule; the next below 0 stops it.
    The same reference sets, with a tree each, serve all numbers of clusters; a
    merge changes one cluster's share of the dispersion.
    """
    lo, hi = x.min(0), x.max(0)
    return k_by_gap_of_trees(x, start, np.stack([reference(lo, hi, len(x), seed, b) for b in range(references)]))


def collapse_small(x: np.ndarray, label: np.ndarray, least: int, metric: str = "cosine") -> np.ndarray:
    """Dissolve the largest-numbered cluster below ``least`` into the nearest others until none is left."""
    label = np.unique(label, return_inverse=True)[1]
    while True:
        n = np.bincount(label)
        small = np.flatnonzero(n < least)
        if not len(small) or len(n) == 1:
            return label
        c = int(small[-1])
        rest = [i for i in range(len(n)) if i != c]
        centres = np.array([x[label == i].mean(0) for i in rest])
        label = label.copy()
        label[label == c] = np.array(rest)[to_centres(x[label == c], centres, metric).round(12).argmin(1)]
        label[label > c] -= 1


def bisect_margin(x: np.ndarray, margin: float) -> np.ndarray:
    """Two clusters if the cosine distance of their centres is the margin or more, else one."""
    if len(x) < 2:
        return np.zeros(len(x), int)
    label = kmeans(x, 2)
    if len(np.unique(label)) < 2:
        return np.zeros(len(x), int)
    c = np.array([x[label == i].mean(0) for i in (0, 1)])
    return label if to_centres(c[:1], c[1:], "cosine")[0, 0] >= margin else np.zeros(len(x), int)


def symmetric_kl(m1: np.ndarray, v1: np.ndarray, m2: np.ndarray, v2: np.ndarray, cut: int | None = None) -> np.ndarray:
    """Symmetric KL divergence of diagonal Gaussians along the last axis; the mean of two modalities with ``cut``."""
    if cut is not None:
        return (symmetric_kl(m1[..., :cut], v1[..., :cut], m2[..., :cut], v2[..., :cut]) + symmetric_kl(m1[..., cut:], v1[..., cut:], m2[..., cut:], v2[..., cut:])) / 2
    shift = (m1 - m2) ** 2
    return ((v1 / v2 + shift / v2 - 1) + (v2 / v1 + shift / v1 - 1)).sum(-1) / 4


def hac_merges(d: np.ndarray, k: int = 1, linkage: str = "average", max_size: int | None = None, mean: np.ndarray | None = None, var: np.ndarray | None = None, pooled: bool = False) -> list[tuple[int, int]]:
    """Merges (i, j), i < j, of agglomerative clustering down to k clusters; the merged cluster goes on as i.

    Every cluster keeps its nearest later one, so a merge costs a few rows of the
    matrix; ties go by (distance, i, j).  Infinite distances are no neighbours: a pair
    that one side alone knows keeps that distance, and without neighbours nothing
    merges.  ``max_size`` vetoes merges of more leaves.  ``linkage``: average (by
    leaves), complete, or ward (on halved squared distances).  With means and
    variances, distances between common neighbours are the symmetric KL of the merged
    cluster, whose variance is the mean by leaves, or with ``pooled`` that of all its rows.
    """
    n = len(d)
    d = d.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    open_ = np.where(np.triu(np.ones((n, n), bool), 1), d, np.inf)  # pairs that may merge
    near, at = open_.min(1) if n else np.empty(0), open_.argmin(1) if n else np.empty(0, int)
    leaves, alive = np.ones(n), np.ones(n, bool)
    if mean is not None:
        mean, var = mean.astype(float).copy(), var.astype(float).copy()
    merges: list[tuple[int, int]] = []
    while n - len(merges) > k:
        i = int(near.argmin())
        if not np.isfinite(near[i]):
            break
        j = int(at[i])
        if max_size is not None and leaves[i] + leaves[j] > max_size:
            open_[i, j] = np.inf  # leaves never get fewer
            near[i], at[i] = open_[i].min(), open_[i].argmin()
            continue
        merges.append((i, j))
        a, b, wi, wj = d[i], d[j], leaves[i], leaves[j]
        with np.errstate(invalid="ignore"):
            if mean is not None:
                m = (wi * mean[i] + wj * mean[j]) / (wi + wj)
                spread = (wi * (mean[i] - m) ** 2 + wj * (mean[j] - m) ** 2) / (wi + wj) if pooled else 0
                mean[i], var[i] = m, (wi * var[i] + wj * var[j]) / (wi + wj) + spread
                both = symmetric_kl(mean[i], var[i], mean, var)
                both = np.where(np.isfinite(both), both, np.finfo(float).max)
            elif linkage == "complete":
                both = np.maximum(a, b)
            elif linkage == "ward":
                both = ((wi + leaves) * a + (wj + leaves) * b - leaves * d[i, j]) / (wi + wj + leaves)
            else:
                both = (wi * a + wj * b) / (wi + wj)
        new = np.where(np.isinf(a), b, np.where(np.isinf(b), a, both))
        alive[j] = False
        leaves[i] += leaves[j]
        new[~alive] = np.inf
        new[i] = np.inf
        d[i], d[:, i] = new, new
        d[j], d[:, j] = np.inf, np.inf
        open_[j], open_[:, j] = np.inf, np.inf
        open_[i, i + 1 :], open_[:i, i] = new[i + 1 :], new[:i]
        again = np.flatnonzero((at == i) | (at == j))
        near[j] = np.inf
        again = np.union1d(again[again != j], [i])
        near[again], at[again] = open_[again].min(1), open_[again].argmin(1)
        closer = np.flatnonzero((new[:i] < near[:i]) | ((new[:i] == near[:i]) & (i < at[:i]) & np.isfinite(new[:i])))
        near[closer], at[closer] = new[closer], i
    return merges


def labels_after(n: int, merges: list[tuple[int, int]]) -> Iterator[np.ndarray]:
    """Labels from 0, dense, after each merge."""
    head = np.arange(n)
    for i, j in merges:
        head[head == j] = i
        yield np.unique(head, return_inverse=True)[1]


def hac(d: np.ndarray, k: int, linkage: str = "average", max_size: int | None = None, mean: np.ndarray | None = None, var: np.ndarray | None = None, pooled: bool = False, merges: list | None = None) -> np.ndarray:
    """Labels of agglomerative clustering down to k clusters, or as near as neighbours and sizes allow; see ``hac_merges``."""
    found = hac_merges(d, k, linkage, max_size, mean, var, pooled)
    if merges is not None:
        merges += found
    return cut_tree(len(d), found, len(d) - len(found))


def repair_connectivity(d: np.ndarray, connected: np.ndarray) -> np.ndarray:
    """Distances with unconnected pairs infinite; components are joined at their nearest pair."""
    link = connected | connected.T
    n = len(d)
    while True:
        part = np.full(n, -1)
        c = 0
        for s in range(n):
            if part[s] < 0:
                stack = [s]
                part[s] = c
                while stack:
                    for o in np.flatnonzero(link[stack.pop()] & (part < 0)):
                        part[o] = c
                        stack.append(o)
                c += 1
        if c <= 1:
            return np.where(link, d, np.inf)
        away = np.where(part[:, None] != part[None], d, np.inf)
        i, j = np.unravel_index(away.argmin(), away.shape)
        link[i, j] = link[j, i] = True


def ward(x: np.ndarray, k: int) -> np.ndarray:
    """Ward's method down to k clusters."""
    return cut(x, k, linkage="ward")


def chain(x: np.ndarray, k: int, max_size: int | None = None) -> np.ndarray:
    """HAC in which a row's neighbours are the one before and the one after it.

    No two clusters have common neighbours, so links keep their distances: the shortest merge first.
    """
    n = len(x)
    if max_size is not None:
        return connected_hac(x, np.abs(np.subtract.outer(np.arange(n), np.arange(n))) == 1, k, max_size=max_size)
    u = unit_rows(x)
    links = 1 - (u[:-1] * u[1:]).sum(1)
    apart = np.ones(n, int)
    apart[1:][np.argsort(links, kind="stable")[: n - k]] = 0
    return np.cumsum(apart) - 1


def connected_hac(x: np.ndarray, link: np.ndarray, k: int, metric: str = "cosine", max_size: int | None = None) -> np.ndarray:
    """HAC in which only linked rows are neighbours, components joined at their nearest pairs first."""
    return hac(repair_connectivity(distances(x, metric), link), k, max_size=max_size)


def merge_test(x: np.ndarray, label: np.ndarray, references: int = 100, metric: str = "cosine", seed: int = 0) -> tuple[bool, float]:
    """Do the two clusters of ``label`` (0 and 1) look like one by the gap statistic?  The verdict and gap(1) - (gap(2) - s(2))."""
    lo, hi = x.min(0), x.max(0)
    gaps, error = [], 0.0
    for k, own in ((1, np.zeros(len(x), int)), (2, label)):
        refs = []
        for b in range(references):
            u = np.random.default_rng([seed, k, b]).uniform(lo, hi, x.shape)
            refs.append(log_dispersion(u, kmeans(u, k, metric), metric))
        gaps.append(float(np.mean(refs)) - log_dispersion(x, own, metric))
        error = float(np.std(refs)) * (1 + 1 / references) ** 0.5
    gap = gaps[0] - (gaps[1] - error)
    return gap >= 0, gap


def buckshot(x: np.ndarray, seeds: np.ndarray, link: np.ndarray, k: int, steps: int = 100) -> np.ndarray:
    """Lloyd's algorithm over x from centres that HAC finds in a sample with must-links."""
    label = connected_hac(seeds, link, k)
    c = np.array([seeds[label == i].mean(0) for i in np.unique(label)])
    last = None
    for _ in range(steps):
        new = to_centres(x, c, "cosine").round(12).argmin(1)
        if last is not None and (new == last).all():
            break
        last = new
        for i in np.unique(new):
            c[i] = x[new == i].mean(0)
    return np.unique(last, return_inverse=True)[1]


def random_unit(n: int, size: int, seed: int = 0) -> np.ndarray:
    """Vectors of length 1 in random directions."""
    g = np.random.default_rng(seed).normal(size=(n, size))
    return g / np.linalg.norm(g, axis=1, keepdims=True)


def distance_quantile(x: np.ndarray, q: float, bins: int = 1 << 16, most: int = 1 << 20) -> float:
    """As np.quantile of all n x n Euclidean distances: counts narrow its range down, then the few values in it are sorted."""
    last = len(x) ** 2 - 1
    place, bound = q * last, 2 * float(np.linalg.norm(x, axis=1).max(initial=0)) * (1 + 1e-9) + 1e-300
    first, second, low, high = int(q * last), min(int(q * last) + 1, last), 0.0, bound

    def blocks() -> Iterator[np.ndarray]:
        return (np.sqrt(to_centres(x[s : s + ROWS], x, "sqeuclid")) for s in range(0, len(x), ROWS))

    while True:
        count, below, width = np.zeros(bins, np.int64), 0, (high - low) / bins
        for d in blocks():
            below += int((d < low).sum())
            count += np.bincount(np.minimum(((d[(d >= low) & (d < high)] - low) / width).astype(np.int64), bins - 1), minlength=bins)
        a, b = np.searchsorted(below + np.cumsum(count), [first, second], "right")
        # a bin more at both ends, as a value at an edge may count on either side
        a, b = max(int(a) - 1, 0), min(int(b) + 2, bins)
        low, high = low + a * width, low + b * width
        if count[a:b].sum() <= most:
            break
        if high - low <= 1e-12 * bound:  # so many equal ones
            return max(float(d[d < high].max(initial=0)) for d in blocks())
    below, values = 0, []
    for d in blocks():
        below += int((d < low).sum())
        values.append(d[(d >= low) & (d < high)])
    one, two = np.sort(np.concatenate(values))[[first - below, second - below]]
    return float(one + (two - one) * (place - first))


def mean_shift(x: np.ndarray, bandwidth: float | None = None, steps: int = 100) -> np.ndarray:
    """Flat-kernel mean shift; modes within a bandwidth are one cluster.

    Rows move independently, ROWS at a time; one that stands still is done.
    """
    h = bandwidth or (distance_quantile(x, 0.3) if len(x) > DENSE else float(np.quantile(np.sqrt(distances(x, "sqeuclid")), 0.3))) or 1.0
    at, moving = x.copy(), np.arange(len(x))
    for _ in range(steps):
        new = np.empty((len(moving), x.shape[1]))
        for s in range(0, len(moving), ROWS):
            near = np.sqrt(to_centres(at[moving[s : s + ROWS]], x, "sqeuclid")) <= h
            new[s : s + ROWS] = near @ x / np.maximum(near.sum(1, keepdims=True), 1)
        step = np.abs(new - at[moving]).max(1)
        if step.max(initial=0) < 1e-6:
            break
        at[moving] = new
        moving = moving[step > 1e-13]
    modes, label = 0, np.full(len(x), -1)
    for i, p in enumerate(at):
        if label[i] < 0:  # a mode, with the rows from here on that are near it and no earlier one
            rest = i + np.flatnonzero(label[i:] < 0)
            label[rest[np.linalg.norm(at[rest] - p, axis=1) <= h]] = modes
            modes += 1
    return label


def spectral(x: np.ndarray, k: int) -> np.ndarray:
    """Normalised spectral clustering on cosine affinity.

    The affinity (1 + cosine) / 2 is a product of n x (size + 1) factors, whose singular
    vectors are its eigenvectors; where there are fewer rows, the matrix itself is taken.
    """
    if len(x) > max(DENSE, x.shape[1] + 1):
        f = np.column_stack([np.ones(len(x)), unit_rows(x)]) / 2**0.5
        s = 1 / np.sqrt(np.maximum(f @ f.sum(0), 1e-12))
        u = np.linalg.svd(s[:, None] * f, full_matrices=False)[0][:, :k][:, ::-1]
    else:
        a = np.clip(1 - distances(x, "cosine") / 2, 0, 1)
        s = 1 / np.sqrt(np.maximum(a.sum(1), 1e-12))
        _, vectors = np.linalg.eigh(s[:, None] * a * s[None])
        u = vectors[:, -k:]
    return kmeans(u / np.maximum(np.linalg.norm(u, axis=1, keepdims=True), 1e-12), k, "sqeuclid")


def dp_means(x: np.ndarray, most: int, alpha: float) -> np.ndarray:
    """Hard-assignment limit of a Dirichlet-process mixture: a row opens a cluster where that is cheaper."""
    spread = float(((x - x.mean(0)) ** 2).sum(1).mean())
    price = spread * (1 + 1 / max(alpha, 1e-9) ** 0.5)
    c = [x.mean(0)]
    label = np.zeros(len(x), int)
    for _ in range(30):
        for i, p in enumerate(x):
            d = ((np.array(c) - p) ** 2).sum(1)
            label[i] = d.argmin()
            if d.min() > price and len(c) < most:
                c.append(p)
                label[i] = len(c) - 1
        used = np.unique(label)
        new = [x[label == u].mean(0) for u in used]
        label = np.searchsorted(used, label)
        if len(new) == len(c) and np.allclose(new, c):
            break
        c = new
    return label


METHODS = {
    "none": lambda x, **_: np.zeros(len(x), int),
    "gap": lambda x, min_size=1, least=1, **_: k_by_gap(x, max(1, len(x) // min_size), least=least)[1],
    "gap_hac": lambda x, min_size=1, **_: k_by_gap_descending(x, max(1, len(x) // min_size))[1],
    "cosine": lambda x, margin=0.5, **_: bisect_margin(x, margin),
    "ha": lambda x, k=2, linkage="average", max_size=None, **_: cut(x, min(k, len(x)), linkage=linkage, max_size=max_size),
    "chain": lambda x, k=2, max_size=None, **_: chain(x, min(k, len(x)), max_size),
    "collapse": lambda x, k=12, least=4, **_: collapse_small(x, kmeans(x, min(k, len(x))), least),
    "ward": lambda x, k=2, **_: ward(x, min(k, len(x))),
    "kmeans": lambda x, k=2, **_: kmeans(x, min(k, len(x))),
    "ms": lambda x, **_: mean_shift(x),
    "sc": lambda x, k=2, **_: spectral(x, min(k, len(x))) if len(x) > 1 else np.zeros(len(x), int),
    "dpgmm": lambda x, alpha=1.0, **_: dp_means(x, len(x), alpha),
}
#: Those that compare all rows of a group with each other.
MATRIX_METHODS = frozenset({"gap_hac", "ha", "chain", "ward", "ms", "sc"})


def _dealt(rows: DataFrame, *by: str, at_least: int = 0) -> DataFrame:
    """Rows by the columns ``by`` in so many partitions that groups seldom share one; small partitions aren't put together."""
    spark = rows.sparkSession
    return rows.repartition(max(16 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), at_least), *by)


def _rows(df: DataFrame, group: str, key: str, vec: str) -> DataFrame:
    return df.select(F.col(group).cast("string").alias("g"), F.col(key).cast("long").alias("k"), V.as_doubles(F.col(vec)).alias("v"))


def _in_order(part: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
    part = part.sort_values("k", kind="stable")
    return part, np.array(part["v"].tolist(), float)


def label_groups(df: DataFrame, group: str, key: str, vec: str, method: str, most: int | None = MOST_ROWS, **options) -> DataFrame:
    """group, key, label: a method of METHODS run inside each group.

    Groups run in parallel, the reference sets of gap_hac too.  One of MATRIX_METHODS
    raises on a group of more than ``most`` rows, so nothing is cut silently; with None
    it takes any: memory grows with the rows, time with their square.
    """
    run, rows = METHODS[method], _rows(df, group, key, vec)
    if method == "gap_hac":
        return _label_groups_by_trees(rows, most, **options).select(F.col("g").alias(group), F.col("k").alias(key), "label")

    def one(part: pd.DataFrame) -> pd.DataFrame:
        if method in MATRIX_METHODS:
            _bounded(len(part), most)
        part, x = _in_order(part)
        return pd.DataFrame({"g": part["g"], "k": part["k"], "label": np.unique(run(x, **options), return_inverse=True)[1]})

    return _dealt(rows, "g").groupBy("g").applyInPandas(one, "g string, k long, label long").select(F.col("g").alias(group), F.col("k").alias(key), "label")


def _label_groups_by_trees(rows: DataFrame, most: int | None, min_size: int = 1, references: int = 100, seed: int = 0, **_) -> DataFrame:
    """g, k, label by ``k_by_gap_descending``; a reference set needs its group's bounds alone, so each is a row of its own."""

    def bounds(part: pd.DataFrame) -> pd.DataFrame:
        _bounded(len(part), most)
        x = np.array(part["v"].tolist(), float)
        return pd.DataFrame({"g": [part["g"].iloc[0]], "n": [len(x)], "lo": [x.min(0)], "hi": [x.max(0)]})

    def curves(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for g, n, lo, hi, b in part.itertuples(index=False):
                yield pd.DataFrame({"g": [g], "b": [b], "w": [reference(lo, hi, n, seed, b)]})

    def one(part: pd.DataFrame, refs: pd.DataFrame) -> pd.DataFrame:
        part, x = _in_order(part)
        label = k_by_gap_of_trees(x, max(1, len(x) // min_size), np.stack(refs.sort_values("b")["w"].to_list()))[1]
        return pd.DataFrame({"g": part["g"], "k": part["k"], "label": np.unique(label, return_inverse=True)[1]})

    boxes = _dealt(rows, "g").groupBy("g").applyInPandas(bounds, "g string, n long, lo array<double>, hi array<double>")
    every = _dealt(boxes.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(references - 1)))), "g", "b", at_least=2 * references)
    refs = every.mapInPandas(curves, "g string, b int, w array<double>")
    return _dealt(rows, "g").groupBy("g").cogroup(_dealt(refs, "g").groupBy("g")).applyInPandas(one, "g string, k long, label long")


def merge_steps(df: DataFrame, group: str, key: str, vec: str, k: int = 1, most: int | None = MOST_ROWS, **options) -> DataFrame:
    """group, step, key, label: labels after each merge of HAC inside each group (see ``hac_merges``).

    A group's tree is made once; its steps, with a row a step and key, are laid out by
    several tasks, STEP_ROWS each.  ``most`` as in ``label_groups``.
    """

    def trees(part: pd.DataFrame) -> pd.DataFrame:
        _bounded(len(part), most)
        part, x = _in_order(part)
        found = np.array(tree(x, k, **options), int).reshape(-1, 2)
        return pd.DataFrame({"g": [part["g"].iloc[0]], "ks": [part["k"].to_numpy()], "i": [found[:, 0]], "j": [found[:, 1]]})

    def lay(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for g, ks, i, j, first in part.itertuples(index=False):
                n, last = len(ks), min(first + _steps(len(ks)), len(i))
                head = np.arange(n)
                for m in range(first):
                    head[head == j[m]] = i[m]
                some, labels = max(1, (1 << 18) // n), []
                for m in range(first, last):
                    head[head == j[m]] = i[m]
                    labels.append((np.cumsum(head == np.arange(n)) - 1)[head])
                    if len(labels) == some or m + 1 == last:
                        yield pd.DataFrame({"g": g, "step": np.repeat(np.arange(m + 2 - len(labels), m + 2), n), "k": np.tile(ks, len(labels)), "label": np.concatenate(labels)})
                        labels = []

    made = Workspace(df.sparkSession, "trees").keep(_dealt(_rows(df, group, key, vec), "g").groupBy("g").applyInPandas(trees, "g string, ks array<long>, i array<long>, j array<long>"), "trees")
    each = F.greatest(F.lit(1), F.floor(F.lit(STEP_ROWS) / F.greatest(F.size("ks"), F.lit(1)))).cast("int")
    starts = made.where(F.size("i") > 0).withColumn("first", F.explode(F.sequence(F.lit(0), F.size("i") - 1, each)))
    parts = _dealt(starts, "g", "first", at_least=4 * starts.count())
    return parts.mapInPandas(lay, "g string, step long, k long, label long").select(F.col("g").alias(group), "step", F.col("k").alias(key), "label")


def _steps(rows: int) -> int:
    """Steps of a tree over so many rows that one task lays out."""
    return max(1, STEP_ROWS // max(rows, 1))


def merge_tests(df: DataFrame, pair: str, side: str, vec: str) -> DataFrame:
    """pair, merge, gap: ``merge_test`` of two clusters (sides 0 and 1) for each pair that has both."""

    def one(part: pd.DataFrame) -> pd.DataFrame:
        label = part["s"].to_numpy()
        if len(set(label)) < 2:
            return pd.DataFrame({"p": [], "merge": [], "gap": []}).astype({"p": "int64", "merge": "bool", "gap": "float64"})
        merge, gap = merge_test(np.array(part["v"].tolist(), float), label)
        return pd.DataFrame({"p": [part["p"].iloc[0]], "merge": [merge], "gap": [gap]})

    rows = df.select(F.col(pair).cast("long").alias("p"), F.col(side).cast("long").alias("s"), V.as_doubles(F.col(vec)).alias("v"))
    return rows.groupBy("p").applyInPandas(one, "p long, merge boolean, gap double").withColumnRenamed("p", pair)


def _bounded(rows: int, most: int | None = MOST_ROWS) -> None:
    if most is not None and rows > most:
        raise ValueError(f"a group of {rows} rows is more than {most}")


def label_clusters_kl(stats: DataFrame, cluster: str, k: int, label: str = "group", cut: int | None = None, pooled: bool = False) -> DataFrame:
    """HAC of clusters by symmetric KL of (mean, var), recomputed after each merge: cluster and its ``label``.

    One row a cluster takes part, MOST_ROWS at most.  ``cut`` parts two modalities.
    """

    def one(part: pd.DataFrame) -> pd.DataFrame:
        _bounded(len(part))
        part = part.sort_values("c")
        m, v = np.array(part["mean"].tolist()), np.array(part["var"].tolist())
        d = np.stack([symmetric_kl(m[i], v[i], m, v, cut) for i in range(len(m))])
        return pd.DataFrame({"c": part["c"], "l": hac(d, min(k, len(m)), mean=m, var=v, pooled=pooled)})

    rows = stats.select(F.lit(0).alias("g"), F.col(cluster).cast("long").alias("c"), "mean", "var")
    return rows.groupBy("g").applyInPandas(one, "c long, l long").select(F.col("c").alias(cluster), F.col("l").alias(label))


# ------------------------------------------------------------- sets and merges


def proper_subsets(sets: DataFrame, key: str, members: str) -> DataFrame:
    """Pairs where one set of two or more lies properly inside another; pairs meet over a shared member."""
    s = sets.select(F.col(key).alias("k"), F.array_sort(F.array_distinct(F.col(members))).alias("m")).where(F.size("m") > 1)
    # a subset's smallest member is in the superset too
    small = s.select(F.col("k").alias("sub"), F.col("m").alias("sm"), F.col("m")[0].alias("x"))
    large = s.select(F.col("k").alias("sup"), F.col("m").alias("lm"), F.explode("m").alias("x"))
    return small.join(large, "x").where((F.size("sm") < F.size("lm")) & (F.size(F.array_except("sm", "lm")) == 0)).select("sub", "sup")


def first_matching(pairs: DataFrame, work: Workspace, name: str) -> DataFrame:
    """The pairs (i, j) that a walk in the order of (i, j) picks, each end once.

    Rounds instead of a walk: a pair that is the first at both its ends is picked, and
    pairs that touch it go.
    """
    left, picked, step = work.keep(pairs.distinct(), f"{name}-0"), None, 0
    while not left.isEmpty():
        step += 1
        ends = left.select(F.col("i").alias("v"), "i", "j").unionByName(left.select(F.col("j").alias("v"), "i", "j"))
        first = ends.groupBy("v").agg(F.min(F.struct("i", "j")).alias("p"))
        now = work.keep(first.groupBy("p").agg(F.count("*").alias("n")).where("n = 2").select("p.i", "p.j"), f"{name}-{step}-picked")
        picked = now if picked is None else picked.unionByName(now)
        gone = now.select(F.col("i").alias("v")).unionByName(now.select(F.col("j").alias("v")))
        left = left.join(gone.select(F.col("v").alias("i")), "i", "left_anti").join(gone.select(F.col("v").alias("j")), "j", "left_anti")
        left = work.keep(left.select("i", "j"), f"{name}-{step}")
    return left if picked is None else picked


def collapse_subsets(sets: DataFrame, key: str, members: str) -> DataFrame:
    """Merge sets of which one lies properly inside the other, pair by pair in order, until there are none.

    A round merges the pairs of a walk over the sets in order: each takes the first later
    one that it lies in or that lies in it, if both are free; merged sets go behind
    the rest, in the order of their pairs.  Returns place (long, the order at the end),
    members (in the order in which they came in) and merged (how many sets went in).
    Sets of one member stay as they are.
    """
    work = Workspace(sets.sparkSession, "subsets")
    now = numbered(sets.select(F.col(key).alias("k"), F.col(members).alias("m")), ["k"], "place").select("place", "m", F.lit(1).cast("long").alias("merged"))
    now, step = work.keep(now, "sets-0"), 0
    while True:
        found = proper_subsets(now, "place", "m")
        pairs = first_matching(found.select(F.least("sub", "sup").alias("i"), F.greatest("sub", "sup").alias("j")), work, f"pairs-{step}")
        if pairs.isEmpty():
            return now
        step += 1
        one = now.select(F.col("place").alias("i"), F.col("m").alias("a"), F.col("merged").alias("ka"))
        two = now.select(F.col("place").alias("j"), F.col("m").alias("b"), F.col("merged").alias("kb"))
        joined = pairs.join(one, "i").join(two, "j").select(F.lit(1).alias("late"), F.col("i").alias("at"), F.array_union("a", "b").alias("m"), (F.col("ka") + F.col("kb")).alias("merged"))
        gone = pairs.select(F.col("i").alias("place")).unionByName(pairs.select(F.col("j").alias("place")))
        rest = now.join(gone, "place", "left_anti").select(F.lit(0).alias("late"), F.col("place").alias("at"), "m", "merged")
        now = work.keep(numbered(rest.unionByName(joined), ["late", "at"], "place").select("place", "m", "merged"), f"sets-{step}")


def reindex(clusters: DataFrame, key: str, removed: DataFrame) -> DataFrame:
    """New dense ids of the clusters that stay: the old id less the removed ones below it."""
    return numbered(clusters.select(key).distinct().join(removed, key, "left_anti"), [key], "new_id")


def merge_clusters(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """One round of merging: members of the second cluster of each pair move to the first."""
    m = pairs.groupBy(F.col("sup").alias("cluster_id")).agg(F.min("sub").alias("into"))
    return members.join(m, "cluster_id", "left").withColumn("cluster_id", F.least("cluster_id", F.coalesce("into", "cluster_id"))).drop("into")


def split_senses(term_obs: DataFrame, term: str, key: str, vec: str, method: str, **options) -> DataFrame:
    """Split every term's observations into senses: term, key, sense (dense in the term)."""
    return label_groups(term_obs, term, key, vec, method, **options).withColumnRenamed("label", "sense")


def seeds(members: DataFrame, cluster: str, key: str, k: int, seed: str) -> DataFrame:
    """cluster, key of sqrt(n k) sampled members, in bursts of 1 to 4 of a cluster, clusters in turn.

    Bursts and orders come from hashes, so any engine can repeat them.  The number of
    members is the only thing that reaches the driver.
    """
    from pyspark.sql.window import Window as W

    from ..functions.text import hashed_order

    most = int((members.count() * k) ** 0.5 + 0.5)
    place = F.row_number().over(W.partitionBy(cluster).orderBy(hashed_order(F.col(key), seed), key)) - 1
    burst = F.conv(F.substring(hashed_order(F.col(cluster), seed), 1, 4), 16, 10).cast("int") % 4 + 1
    turn = members.select(cluster, key).withColumn("_place", place).withColumn("_turn", F.floor(F.col("_place") / burst))
    # no cluster gives more than ``most``, so the sort is of what may be taken alone
    return turn.where(F.col("_place") < most).orderBy("_turn", hashed_order(F.col(cluster), seed), cluster, "_place").limit(most).select(cluster, key)


def must_links(sample: DataFrame, cluster: str, key: str) -> DataFrame:
    """Pairs (i < j) of sampled members of one cluster."""
    a, b = sample.alias("a"), sample.alias("b")
    met = a.join(b, (F.col(f"a.{cluster}") == F.col(f"b.{cluster}")) & (F.col(f"a.{key}") < F.col(f"b.{key}")))
    return met.select(F.col(f"a.{key}").alias("i"), F.col(f"b.{key}").alias("j"))


#: Ways to merge senses, with the method that labels their means.
MERGES = {"none": "none", "gap": "gap", "dpgmm": "dpgmm", "ms": "ms", "sc": "sc", "ha": "gap_hac", "ha_fixed": "ha"}


def merge_senses(senses: DataFrame, sense: str, vec: str, method: str = "ha_fixed", k: int | None = None, **options) -> DataFrame:
    """Cluster the senses by their means: sense, label.

    ``method``: none, gap, dpgmm, ms, sc, ha (the gap decides), ha_fixed and, on columns
    mean and var, ha_fixed_kl.  Where a number of clusters is needed and not given, it
    is the one expected from so many senses.  One row a sense takes part.
    """
    if method == "none":
        ids = numbered(senses.select(sense).distinct(), [sense], "label")
        return ids.select(sense, "label")
    k = k or max(1, V.estimated_k(senses.count()))
    if method == "ha_fixed_kl":
        return label_clusters_kl(senses, sense, k, "label", **options)
    return label_groups(senses.withColumn("_all", F.lit(0)), "_all", sense, vec, MERGES[method], k=k, least=k, **options).drop("_all")


def merge_senses_buckshot(members: DataFrame, sense: str, key: str, vec: str, seed: str = "buckshot", k: int | None = None) -> DataFrame:
    """sense, label: Lloyd's algorithm over the senses' means from centres that HAC finds in a sample of members.

    The sample is that of ``seeds``; members of one sense must link.  sqrt(n k) members
    and one mean a sense meet in one task, MOST_ROWS of each at most.
    """
    sizes = members.groupBy(sense).count()
    k = k or max(1, V.estimated_k(sizes.count()))
    rows = members.select(F.col(sense).cast("long").alias("s"), F.col(key).cast("long").alias("k"), V.as_doubles(F.col(vec)).alias("v"))
    picked = seeds(members, sense, key, k, seed).select(F.col(sense).cast("long").alias("s"), F.col(key).cast("long").alias("k"))
    sample = rows.join(picked, ["s", "k"]).select("s", "k", "v")
    stats = VO.as_arrays(VO.cluster_mean_var(rows, "s", "v"), "s").select("s", F.lit(None).cast("long").alias("k"), F.col("mean").alias("v"))

    def one(part: pd.DataFrame) -> pd.DataFrame:
        mine = part["k"].isna()
        _bounded(int(mine.sum()))
        _bounded(int((~mine).sum()))
        means, chosen = part[mine].sort_values("s"), part[~mine].sort_values(["s", "k"])
        x, y, owner = np.array(means["v"].tolist()), np.array(chosen["v"].tolist()), chosen["s"].to_numpy()
        label = buckshot(x, y, (owner[:, None] == owner[None]) & ~np.eye(len(y), dtype=bool), min(k, len(y)))
        return pd.DataFrame({"s": means["s"], "label": label})

    met = sample.unionByName(stats).withColumn("g", F.lit(0))
    return met.groupBy("g").applyInPandas(one, "s long, label long").select(F.col("s").alias(sense), "label")


def rebuild_senses(members: DataFrame, labels: DataFrame, sense: str, term: str, key: str, literal: bool = False) -> DataFrame:
    """Clusters from the labels of senses: label, term, key.

    A cluster has the union of its senses' terms, and all their members.  ``literal``
    keeps of a term only the members in the first sense that brings it in.
    """
    met = members.select(sense, term, key).join(labels.select(sense, "label"), sense)
    if not literal:
        return met.select("label", term, key)
    first = met.groupBy("label", term).agg(F.min(sense).alias("_first"))
    return met.join(first, ["label", term]).where(F.col(sense) == F.col("_first")).select("label", term, key)


def ordered_union(lists: DataFrame, labels: DataFrame, sense: str, terms: str) -> DataFrame:
    """label and the union of its senses' term lists: terms in the order of senses, then of their lists, each once."""
    met = lists.select(sense, F.posexplode(terms).alias("_pos", "_term")).join(labels.select(sense, "label"), sense)
    first = met.groupBy("label", "_term").agg(F.min(F.struct(sense, "_pos")).alias("_at"))
    return first.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("_at", "_term"))), lambda x: x["_term"]).alias(terms))


def balanced_negatives(members: DataFrame, cluster: str, term: str, key: str, seed: str) -> DataFrame:
    """cluster, key: for every cluster as many members of others as it has itself, each once.

    Negatives are drawn evenly over clusters, in these over terms, in these over
    members: all members stand in one order of turns (hashed, so any engine can repeat
    it), and a cluster takes the first that aren't its own.  As many as it has twice
    over are looked at, in blocks that meet by number.
    """
    from pyspark.sql.window import Window as W

    from ..functions.text import hashed_order

    h = lambda c: hashed_order(F.col(c), seed)
    rows = members.select(F.col(cluster).alias("c"), F.col(term).alias("t"), F.col(key).alias("k"))
    rows = rows.withColumn("r1", F.row_number().over(W.partitionBy("c", "t").orderBy(h("k"), "k")))
    rows = rows.withColumn("r2", F.row_number().over(W.partitionBy("c").orderBy("r1", h("t"), "t")))
    line = numbered(rows.select("r2", h("c").alias("hc"), "c", "k"), ["r2", "hc", "c"], "at").select("at", "c", "k")
    n = members.groupBy(F.col(cluster).alias("own")).agg(F.count("*").alias("n"))
    block = 1024
    wanted = n.select("own", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(2 * F.col("n") / block))).alias("b"))
    met = wanted.join(line.withColumn("b", F.floor(F.col("at") / block)), "b").where((F.col("at") < 2 * F.col("n")) & (F.col("c") != F.col("own")))
    place = F.row_number().over(W.partitionBy("own").orderBy("at"))
    return met.withColumn("p", place).where(F.col("p") <= F.col("n")).select(F.col("own").alias(cluster), F.col("k").alias(key))


def linear_svm(x: np.ndarray, y: np.ndarray, c: float = 1.0, steps: int = 50) -> np.ndarray:
    """Weights (the last one the intercept) of an SVM with squared hinge loss, by Newton's method; y is 1 or -1."""
    z = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        margin = 1 - y * (z @ w)
        active = margin > 0
        gradient = w - 2 * c * z[active].T @ (y[active] * margin[active])
        hessian = np.eye(len(w)) + 2 * c * z[active].T @ z[active]
        step = np.linalg.solve(hessian, gradient)
        w = w - step
        if np.abs(step).max() < 1e-10:
            break
    return w


def svm_models(rows: DataFrame, negatives: DataFrame, cluster: str, key: str, vec: str) -> DataFrame:
    """cluster, weights: one linear SVM a cluster, its members against as many sampled others; clusters are fitted in parallel."""
    v = V.as_doubles(F.col(vec))
    own = rows.select(cluster, v.alias("v"), F.lit(1.0).alias("y"))
    other = negatives.join(rows.select(key, v.alias("v")), key).select(cluster, "v", F.lit(-1.0).alias("y"))

    def one(part: pd.DataFrame) -> pd.DataFrame:
        w = linear_svm(np.array(part["v"].tolist()), part["y"].to_numpy()) if part["y"].nunique() == 2 else None
        return pd.DataFrame({"c": part["c"].iloc[:1], "w": [w]})

    both = own.unionByName(other).select(F.col(cluster).cast("long").alias("c"), "v", "y")
    return both.groupBy("c").applyInPandas(one, "c long, w array<double>").where("w is not null").select(F.col("c").alias(cluster), F.col("w").alias("weights"))


def svm_decisions(rows: DataFrame, models: DataFrame, cluster: str, key: str, vec: str, block: int = 256) -> DataFrame:
    """cluster, key of what each cluster's model accepts; models meet rows in blocks of bounded size."""
    m = numbered(models, [cluster], "_place").withColumn("_b", F.floor(F.col("_place") / block))
    packed = m.groupBy("_b").agg(F.sort_array(F.collect_list(F.struct(F.col(cluster).cast("long").alias("c"), F.col("weights").alias("w")))).alias("models"))
    blocks = -(-models.count() // block)
    met = rows.select(F.col(key).alias("k"), V.as_doubles(F.col(vec)).alias("v"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(blocks, 1) - 1).cast("long"))).alias("_b")).join(packed, "_b")
    score = lambda w: V.dot(F.slice(w, 1, F.size("v")), F.col("v")) + F.element_at(w, -1)
    accepted = F.filter("models", lambda x: score(x["w"]) > 0)
    return met.select(F.explode(F.transform(accepted, lambda x: x["c"])).alias(cluster), F.col("k").alias(key))


def hashed_sample(df: DataFrame, group: Iterable[str], quota, key: str, seed: str) -> DataFrame:
    """As many rows of each group as its quota, chosen by a hash that any engine can repeat."""
    from pyspark.sql.window import Window as W

    from ..functions.text import hashed_order

    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*group).orderBy(hashed_order(F.col(key), seed), key))).where(F.col("_rn") <= quota).drop("_rn")
