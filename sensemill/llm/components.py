"""Connected components of an edge table: forests of bounded shares first, then alternating large and small stars.

No vertex or edge reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Workspace, fields

#: Edges of one task's share, about; its memory is bounded by that.
SHARE = 1_000_000


def _contract(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vertex, smallest vertex joined with it) of a share of edges, by rounds of minima and pointer jumps."""
    names, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(names))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            return names, names[root]
        root = new


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if parts:
        u, v = _contract(*(np.concatenate(p) for p in zip(*parts, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])


def _state(edges: DataFrame):
    return edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()


def _star(work: Workspace, edges: DataFrame, large: bool, name: str) -> DataFrame:
    """Hang neighbours on the smallest one around: the larger ones (large) or all smaller ones and the vertex itself (small)."""
    if large:
        near = edges.select(F.col("u").alias("a"), F.col("v").alias("b")).unionByName(edges.select(F.col("v").alias("a"), F.col("u").alias("b")))
    else:
        near = edges.select(F.col("u").alias("a"), F.col("v").alias("b"))  # v < u
    least = near.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    least = work.keep(least, f"{name}-least")  # a plain table: a hub's edges can be split in the join
    met = near.join(least, "a")
    if large:
        out = met.where("b > a").select(F.col("b").alias("u"), F.col("m").alias("v"))
    else:
        out = met.select(F.col("b").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("a").alias("u"), F.col("m").alias("v")))
    return work.keep(out.where("u <> v").distinct(), name)


def components(work: Workspace, edges: DataFrame, name: str, share: int = SHARE) -> DataFrame:
    """node, root for every vertex of ``edges`` (u, v: longs); the root is the component's smallest vertex.

    Shares of ``share`` edges become forests, each in one task.  One share is the whole
    answer; several are joined by stars until nothing changes.
    """
    shares = max(1, -(-edges.count() // share))
    forest = edges.select("u", "v").repartition(shares) if shares > 1 else edges.select("u", "v").coalesce(1)
    e = work.keep(forest.mapInArrow(_forests, fields(u="long", v="long")), f"{name}-0")
    if shares == 1:
        return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    e = work.keep(e.where("u <> v").distinct(), f"{name}-1")
    state, step = _state(e), 1
    while state[0]:
        step += 1
        e = _star(work, e, True, f"{name}-{step}-large")
        e = _star(work, e, False, f"{name}-{step}-small")
        now = _state(e)
        if now == state:
            break
        state = now
    roots = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))
