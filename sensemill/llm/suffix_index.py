"""Suffix-array dedup with a logarithmic family of indexes.

A batch's index is a sampled suffix array: the suffixes that begin at winnowed anchors
(every window of 400 bytes has one), sorted by what follows and precedes the anchor
within reach of a window, equal ones as one entry.  Only equality of long stretches
matters here, so entries are sorted by fingerprints of these stretches, not by their
bytes; the bytes themselves are compared when entries of one anchor are extended.

A new batch is merge-scanned against every level of the family before it is added:
both are sorted and bucketed by anchor, so neither is exchanged.  The scan marks the
entries of both sides that match; levels of equal size then by a merge join that
leaves buckets where they are, so there are never more than log2(batches) + 1 and an entry is rewritten as often
at most.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import extend as X
from . import kernel as K
from .shared import Workspace, documents, fields, setting

WINDOW = 400
#: Bytes of an anchor.
SEED = 96
BATCHES = 3
#: Spark's setting that a bucket in one sorted file counts as sorted.
_SORTED = "spark.sql.legacy.bucketedTableScan.outputOrdering"
#: Spark's setting that a join on more columns than the buckets' exchanges both sides all the same.
_ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"

KEPT = fields(doc_id="long", n_bytes="long", n_removed="long", n_spans="long", kept_sha256="string", kept="binary")


@dataclass
class Level:
    """A sorted suffix table over so many batches, bucketed by anchor; entries say how often they stand and where first."""

    batches: int
    name: str
    table: DataFrame


class SuffixIndex:
    """Levels of sorted suffix tables, the largest first."""

    def __init__(self, work: Workspace, buckets: int):
        self.work, self.spark, self.buckets = work, work.spark, buckets
        self._old: list[Level] = []
        self.levels: list[Level] = []

    def _write(self, df: DataFrame, batches: int) -> Level:
        name = f"suffixes_{uuid.uuid4().hex}"
        df.write.bucketBy(self.buckets, "anchor").sortBy(*X.KIND).option("path", self.work.path(name)).saveAsTable(name)
        return Level(batches, name, self.spark.table(name))

    def array(self, segments: DataFrame) -> Level:
        """The suffix array of one batch."""
        return self._write(X.kinds_of(segments).repartition(self.buckets, "anchor").sortWithinPartitions(*X.KIND), 1)

    def scan(self, new: Level) -> DataFrame:
        """Entries of the new array and of the levels that stand at a shared anchor; ``n`` is over 1 where an equal entry stands elsewhere.

        Semi joins of tables bucketed alike: no exchange, and at most one row for each entry and level.
        """
        mine = new.table
        twice = mine.groupBy("anchor").agg(F.sum("n").alias("_n")).where("_n > 1").select("anchor")
        found = [mine.join(twice, "anchor", "left_semi")]
        for level in self.levels:
            old = level.table
            found.append(mine.join(old.select("anchor"), "anchor", "left_semi"))
            found.append(old.join(mine.select("anchor"), "anchor", "left_semi"))
            found.append(mine.join(old.select(*X.KIND), X.KIND, "left_semi").withColumn("n", F.col("n") + 1))
        return reduce(DataFrame.unionByName, found)

    def merge(self, a: Level, b: Level) -> Level:
        """Two levels as one: a merge join of sorted buckets, which stay where they are; counts add up, the first place is the smaller one."""
        other = b.table.select(*(F.col(c).alias(f"_{c}") for c in b.table.columns))
        same = reduce(lambda x, y: x & y, (F.col(c) == F.col(f"_{c}") for c in X.KIND))
        mine, its = (F.when(F.col(f"{p}n").isNotNull(), F.struct(*(F.col(f"{p}{c}").alias(c) for c in ("d", "v", "f")))) for p in ("", "_"))
        met = a.table.join(other, same, "full_outer").withColumn("lead", F.least(mine, its))
        either = lambda c: F.coalesce(c, f"_{c}").alias(c)
        n = (F.coalesce("n", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("n")
        merged = met.select(*map(either, X.KIND), n, F.col("lead.d").alias("d"), F.col("lead.v").alias("v"), F.col("lead.f").alias("f"), either("gap"), either("span"))
        return self._write(merged, a.batches + b.batches)

    def add(self, level: Level) -> None:
        """Levels of equal size merge; scans made before still read the merged ones."""
        while self.levels and self.levels[-1].batches == level.batches:
            old = self.levels.pop()
            merged = self.merge(old, level)
            self._old += [old, level]
            level = merged
        self.levels.append(level)

    def close(self) -> None:
        """Delete all levels; scans must have been read."""
        for level in [*self._old, *self.levels]:
            self.spark.sql(f"DROP TABLE IF EXISTS {level.name}")
            self.work.drop(level.name)
        self._old, self.levels = [], []


@contextmanager
def in_place(spark: SparkSession) -> Iterator[None]:
    """Tables bucketed and sorted alike are joined as they lie."""
    with setting(spark, _SORTED, "true"), setting(spark, _ALL_KEYS, "false"):
        yield


def index_batch(index: SuffixIndex, segments: DataFrame) -> DataFrame:
    """Scan a batch against the levels as they are, then add it; the entries found, of the batch and of the levels."""
    with in_place(index.spark), index.work.sized():
        new = index.array(segments)
        found = index.scan(new)
        index.add(new)
    return found


def remove_repeated_bytes(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, seed: int = SEED, batches: int = BATCHES, keep_bytes: bool = True, most: int = X.MOST) -> DataFrame:
    """Remove every byte covered by a string of ``window`` bytes that starts anywhere else too.

    Texts are UTF-8 bytes; matches never cross texts; overlaps count, the same text
    is included, and all occurrences go, also those of earlier batches.  Returns
    doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 and kept
    (null unless ``keep_bytes``).

    Null texts are empty.  Rows are documents of their own, but for rows equal in id
    and text, which share one result; each counts as an occurrence, so such rows
    remove each other's long strings.  Very long texts are scanned whole, with memory
    in proportion to the longest one.
    """
    work = Workspace(spark, "suffix-index", docs)
    read = X.versioned(documents(docs, id_col, text_col))
    segments = work.keep(X.scan_segments(read, X.BYTES, window, seed), "segments", few=True)
    with work.sized():
        index = SuffixIndex(work, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # a batch is what arrives together; here a hash deals the texts
    found = [index_batch(index, segments.where(F.pmod("version", F.lit(batches)) == b)) for b in range(batches)]
    lead = F.min(F.struct("d", "v", "f")).alias("lead")
    entries = reduce(DataFrame.unionByName, found).groupBy(*X.KIND).agg(F.max("n").alias("n"), lead, F.min("gap").alias("gap"), F.min("span").alias("span"))
    entries = entries.select(*X.KIND, "n", F.col("lead.d").alias("d"), F.col("lead.v").alias("v"), F.col("lead.f").alias("f"), "gap", "span")
    with in_place(spark):
        kinds = work.keep(X.in_groups(entries), "kinds", few=True)
    index.close()
    matched = X.find_repeats(work, read, segments, kinds, X.BYTES, window, directed=False, most=most)

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for i, j, buf, off in K.runs(batch.column(1)):
                gone = X.covered_units(batch.column(2).slice(i, j - i), off, len(buf), window)
                total = np.concatenate([[0], np.cumsum(gone)])
                opens = gone.copy()
                opens[1:] &= ~gone[:-1]
                edges = off[:-1][off[:-1] < len(buf)]
                opens[edges] = gone[edges]
                spans = np.concatenate([[0], np.cumsum(opens)])
                kept = [buf[a:b][~gone[a:b]].tobytes() for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i),
                        pa.array(np.diff(off)),
                        pa.array(total[off[1:]] - total[off[:-1]]),
                        pa.array(spans[off[1:]] - spans[off[:-1]]),
                        pa.array([hashlib.sha256(k).hexdigest() for k in kept]),
                        pa.array(kept, pa.binary()) if keep_bytes else pa.nulls(j - i, pa.binary()),
                    ],
                    names=KEPT.names,
                )

    return matched.mapInArrow(cut, KEPT)
