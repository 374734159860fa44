"""Benchmark decontamination: a broadcast hash set of normalised test n-grams."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernel as K
from .shared import Workspace, documents, fields

NGRAM = 13
#: Bytes of benchmark text in one broadcast set; a larger benchmark is taken in blocks of that size.
BLOCK_BYTES = 16 << 20

HITS = fields(doc_id="long", text="string", n_words="long", hits="array<int>", items="array<string>")
_FILTER_BITS = 20


class Grams:
    """Windows of one length: sorted pairs of fingerprints in columns, and the items of each, end to end.

    Some 30 bytes a window, so a block of benchmark text is bounded in memory too.
    """

    def __init__(self, first: np.ndarray, second: np.ndarray, item: np.ndarray):
        order = np.lexsort((item, second, first))
        first, second, item = first[order], second[order], item[order]
        fresh = np.ones(len(first), bool)
        fresh[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        apart = fresh.copy()
        apart[1:] |= item[1:] != item[:-1]
        at = np.flatnonzero(fresh)
        #: The second fingerprint verifies a hit; windows at[k]..at[k + 1] of ``items`` have gram k.
        self.first, self.second, self.items = first[at], second[at], item[apart]
        self.at = np.append(np.cumsum(apart)[at] - 1, len(self.items))
        self.mask = np.zeros(1 << _FILTER_BITS, bool)
        self.mask[self.first >> np.uint64(64 - _FILTER_BITS)] = True

    def lookup(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """The index of each pair of fingerprints, -1 for none."""
        out = np.full(len(one), -1)
        left = np.arange(len(one))
        k = np.searchsorted(self.first, one)
        while len(left):  # twice or more only where first fingerprints collide
            same = (k < len(self.first)) & (self.first[np.minimum(k, len(self.first) - 1)] == one[left])
            left, k = left[same], k[same]
            right = self.second[k] == two[left]
            out[left[right]] = k[right]
            left, k = left[~right], k[~right] + 1
        return out


class GramSet:
    """Fingerprints of all windows of some items, with the items that hold each; an item shorter than a window is one window."""

    def __init__(self, items: list[tuple[str | None, str | None]], ngram: int = NGRAM):
        self.ngram = ngram
        self.names = sorted({name for name, _ in items if name is not None})
        known = {name: k for k, name in enumerate(self.names)}
        number = np.array([known.get(name, -1) for name, _ in items], np.int32)
        parts: dict[int, list[tuple[np.ndarray, ...]]] = {}
        for i, _j, buf, off in K.runs(pa.array([t or "" for _, t in items], pa.large_string())):
            start, end, cuts = K.word_spans(buf, off, K.WORD_ALNUM)
            x = K.word_values(buf, start, end, lower=True)
            rolls = [K.Rolling(x, 0), K.Rolling(x, 1)]
            size = np.minimum(np.diff(cuts), ngram)
            for length in np.unique(size[size > 0]).tolist():
                rows = np.flatnonzero(size == length)
                count = np.diff(cuts)[rows] - length + 1
                row = np.repeat(rows, count)
                at = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + cuts[row]
                parts.setdefault(length, []).append((*(r.of(at, at + length) for r in rolls), number[i + row]))
        self.tables = {length: Grams(*map(np.concatenate, zip(*found, strict=True))) for length, found in parts.items()}

    def find(self, x: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, list[set[str]]]:
        """Which words are inside an occurrence, and each text's items."""
        n = len(x)
        delta = np.zeros(n + 1, np.int64)
        found: list[set[str]] = [set() for _ in range(len(cuts) - 1)]
        if not n:
            return np.zeros(0, bool), found
        one, two = K.Rolling(x, 0), None
        for length, grams in self.tables.items():
            h = one.every(length)
            maybe = np.flatnonzero(grams.mask[h >> np.uint64(64 - _FILTER_BITS)])
            text = np.searchsorted(cuts, maybe, side="right") - 1
            inside = maybe + length <= cuts[text + 1]
            maybe, text = maybe[inside], text[inside]
            if not len(maybe):
                continue
            two = two or K.Rolling(x, 1)
            gram = grams.lookup(h[maybe], two.of(maybe, maybe + length))
            hit = gram >= 0
            delta += np.bincount(maybe[hit], minlength=n + 1) - np.bincount(maybe[hit] + length, minlength=n + 1)
            for t, k in np.unique(np.stack([text[hit], gram[hit]], axis=1), axis=0).tolist():
                found[t].update(self.names[i] for i in grams.items[grams.at[k] : grams.at[k + 1]].tolist() if i >= 0)
        return np.cumsum(delta[:n]) > 0, found


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[str | None, str | None]]]:
    """Benchmark items in lists of bounded size."""
    block, size = [], 0
    for row in benchmark.toLocalIterator():
        if block and size + len(row[1] or "") > block_bytes:
            yield block
            block, size = [], 0
        block.append((row[0], row[1]))
        size += len(row[1] or "")
    if block:
        yield block


def benchmark_hits(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", ngram: int = NGRAM, block_bytes: int = BLOCK_BYTES, keep_text: bool = True) -> DataFrame:
    """For each row: text (null unless ``keep_text``), word count, positions of hit words and found items (as strings).

    Words are runs of ASCII digits and letters, lower-cased, and all characters
    beyond ASCII.  A window is ``ngram`` words of an item, or the whole of a shorter
    one.  Benchmarks beyond ``block_bytes`` are handled block by block over a table
    kept in the shared folder, so a broadcast never outgrows its bound.  Null and
    empty texts have no words; null items or texts hold no windows; items without id
    mark words but are not named; repeated rows are judged each on its own; very long
    texts are scanned whole, with memory in proportion to the longest one.
    """
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).cast("string").alias("text"))
    blocks = _blocks(items, block_bytes)
    block, after = next(blocks, []), next(blocks, None)
    out = documents(docs, id_col, text_col)
    work = Workspace(spark, "decontaminate") if after is not None else None
    while after is not None:
        out = work.keep(_scan(spark, out, GramSet(block, ngram), True), f"block-{uuid.uuid4().hex}")
        block, after = after, next(blocks, None)
    return _scan(spark, out, GramSet(block, ngram), keep_text)


def _scan(spark: SparkSession, df: DataFrame, grams: GramSet, keep_text: bool) -> DataFrame:
    shared = spark.sparkContext.broadcast(grams)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, off in K.runs(batch.column(1)):
                start, end, cuts = K.word_spans(buf, off, K.WORD_ALNUM)
                hit, found = shared.value.find(K.word_values(buf, start, end, lower=True), cuts)
                at = np.flatnonzero(hit)
                text = np.searchsorted(cuts, at, side="right") - 1
                old = batch.num_columns > 2
                if old:  # what earlier blocks have found
                    before = batch.column(3).slice(i, j - i).to_pylist(), batch.column(4).slice(i, j - i).to_pylist()
                    mine = np.split(at - cuts[text], np.searchsorted(text, np.arange(1, j - i)))
                    hits = pa.array([sorted({*a, *b.tolist()}) for a, b in zip(before[0], mine, strict=True)], pa.list_(pa.int32()))
                    found = [x | {*y} for x, y in zip(found, before[1], strict=True)]
                else:
                    hits = K.list_array((at - cuts[text]).astype(np.int32), np.bincount(text, minlength=j - i))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i) if keep_text else pa.nulls(j - i, pa.string()), pa.array(np.diff(cuts)), hits, pa.array([sorted(x) for x in found], pa.list_(pa.string()))],
                    names=HITS.names,
                )

    return df.mapInArrow(scan, HITS)


DIGEST = fields(doc_id="long", n_words="long", n_hit="long", n_items="long", items_sha256="string", contaminated="boolean")


def contamination_report(hits: DataFrame, min_percent: int = 5) -> DataFrame:
    """Counts and digests from ``benchmark_hits``; contaminated from ``min_percent`` of words hit."""
    n_hit = F.size("hits").cast("long")
    return hits.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (100 * n_hit >= min_percent * F.col("n_words"))).alias("contaminated"),
    )


def remove_hit_words(hits: DataFrame) -> DataFrame:
    """doc_id and text without the hit words; other characters stay as they are."""
    schema = fields(doc_id="long", text="string")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, off in K.runs(batch.column(1)):
                start, end, cuts = K.word_spans(buf, off, K.WORD_ALNUM)
                lists = batch.column(3).slice(i, j - i).to_pylist()
                at = np.array([cuts[r] + p for r, ps in enumerate(lists) for p in ps], np.int64)
                gone = np.zeros(len(buf) + 1, np.int64)
                np.add.at(gone, start[at], 1)
                np.add.at(gone, end[at], -1)
                keep = np.cumsum(gone[:-1]) == 0
                texts = [buf[a:b][keep[a:b]].tobytes().decode() for a, b in zip(off[:-1], off[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(texts, pa.string())], names=schema.names)

    return hits.mapInArrow(cut, schema)


def clean(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_text_col: str = "text", ngram: int = NGRAM, min_percent: int = 5, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` with all columns: contaminated ones go, from others the hit words are cut.

    A text without hits stays as it is, a null one null; repeated rows are judged alone,
    very long texts whole, and columns may have any names.  Hits of all blocks of a larger
    benchmark are united on the original text, in a table kept in the shared folder
    between two blocks, before anything is dropped or cut.
    """
    where, names = docs.columns.index(text_col), docs.columns
    width, mark = len(names), f"hits_{uuid.uuid4().hex}"
    marked = T.StructType([*docs.schema.fields, T.StructField(mark, T.ArrayType(T.IntegerType()))])

    def judge(df: DataFrame, grams: GramSet, last: bool) -> DataFrame:
        shared = spark.sparkContext.broadcast(grams)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i, j, buf, off in K.runs(batch.column(where)):
                    part = batch.slice(i, j - i)
                    start, end, cuts = K.word_spans(buf, off, K.WORD_ALNUM)
                    hit, _ = shared.value.find(K.word_values(buf, start, end, lower=True), cuts)
                    if part.num_columns > width:  # what earlier blocks have found
                        lists = part.column(width)
                        hit[np.repeat(cuts[:-1], pc.list_value_length(lists).to_numpy()) + lists.flatten().to_numpy()] = True
                        part = pa.RecordBatch.from_arrays(part.columns[:width], names=names)
                    total = np.concatenate([[0], np.cumsum(hit)])
                    n = total[cuts[1:]] - total[cuts[:-1]]
                    if not last:
                        at = np.flatnonzero(hit)
                        yield pa.RecordBatch.from_arrays([*part.columns, K.list_array((at - np.repeat(cuts[:-1], n)).astype(np.int32), n)], names=marked.names)
                        continue
                    if hit.any():
                        texts = part.column(where).to_pylist()
                        gone = np.zeros(len(buf) + 1, np.int64)
                        gone[start[hit]] += 1
                        gone[end[hit]] -= 1
                        keep = np.cumsum(gone[:-1]) == 0
                        for r in np.flatnonzero(n).tolist():
                            texts[r] = buf[off[r] : off[r + 1]][keep[off[r] : off[r + 1]]].tobytes().decode()
                        columns = [pa.array(texts, pa.string()) if c == where else part.column(c) for c in range(width)]
                        part = pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(100 * n < min_percent * np.maximum(np.diff(cuts), 1)) if min_percent else pa.array(n == 0))
                    yield part

        return df.mapInArrow(run, docs.schema if last else marked)

    blocks = _blocks(benchmark.select(F.lit(None).cast("string"), F.col(item_text_col).cast("string")), block_bytes)
    block, after = next(blocks, None), next(blocks, None)
    if block is None:
        return docs
    out, work = docs, Workspace(spark, "clean") if after is not None else None
    while after is not None:
        out = work.keep(judge(out, GramSet(block, ngram), False), f"block-{uuid.uuid4().hex}")
        block, after = after, next(blocks, None)
    return judge(out, GramSet(block, ngram), True)
