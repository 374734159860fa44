"""Quality classifier by compression: how much better does a dictionary of good text fit than one of bad text?"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents, fields

#: Labelled texts of each class that are used, at most: half for the dictionaries, half for the calibration.
SAMPLE = 1500
#: Characters of one text in the sample, at most: longer ones give SLICES equal slices, evenly spaced over the whole text (a bound for the driver; scoring has none).
SAMPLE_CHARS, SLICES = 20_000, 20
DICT_BYTES = 64 << 10
LEVEL = 1
#: A text is compressed in pieces of so many bytes, each against a fresh dictionary, so that long texts are not judged by their first words alone.
PIECE = 1024

SCORES = fields(doc_id="long", score="double")


def _features(good: int, bad: int, raw: int) -> tuple[float, float, float]:
    """Normalised size difference, ratio to the raw size, and the share of a fixed offset in short texts."""
    n = raw + 32.0
    return (bad - good) / n, min(good, bad) / n, 32.0 / n


@dataclass
class CompressionModel:
    """Two dictionaries and the calibration of the size difference."""

    good: bytes
    bad: bytes
    weights: list[float] = field(default_factory=lambda: [0.0] * 4)
    mean: list[float] = field(default_factory=lambda: [0.0] * 3)
    scale: list[float] = field(default_factory=lambda: [1.0] * 3)
    prior: float = 0.5

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_tools"}

    def sizes(self, text: bytes) -> tuple[int, int]:
        tools = self.__dict__.get("_tools")
        if tools is None:
            tools = self.__dict__["_tools"] = [
                zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
                for d in (_dictionary(self.good), _dictionary(self.bad))
            ]
        pieces = [text[i : i + PIECE] for i in range(0, len(text), PIECE)]
        return sum(len(tools[0].compress(p)) for p in pieces), sum(len(tools[1].compress(p)) for p in pieces)

    def raw(self, text: bytes) -> tuple[float, float, float]:
        return _features(*self.sizes(text), len(text))

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if not texts:
            return np.empty(0)
        x = (np.array([self.raw(t) for t in texts]) - self.mean) / self.scale
        z = self.weights[0] + x @ np.array(self.weights[1:])
        out = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        return np.where([bool(t.strip()) for t in texts], out, self.prior)


def _dictionary(content: bytes) -> zstandard.ZstdCompressionDict:
    d = zstandard.ZstdCompressionDict(content)
    d.precompute_compress(level=LEVEL)
    return d


def _train(texts: list[bytes]) -> bytes:
    """A zstandard dictionary; too few samples to train one serve as raw content."""
    try:
        return zstandard.train_dictionary(DICT_BYTES, texts, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(texts)[:DICT_BYTES] or b"\0" * 8


def fit(good: list[bytes], bad: list[bytes]) -> CompressionModel:
    """Every other text of each class builds its dictionary, the rest calibrates by logistic regression.

    A class without texts gives a constant score: the share of good texts (smoothed).
    """
    prior = (len(good) + 1) / (len(good) + len(bad) + 2)
    model = CompressionModel(_train(good[::2]), _train(bad[::2]), prior=prior)
    model.weights[0] = float(np.log(prior / (1 - prior)))
    if len(good) < 2 or len(bad) < 2:
        return model
    held = good[1::2], bad[1::2]
    x = np.array([model.raw(t) for part in held for t in part])
    y = np.array([1.0] * len(held[0]) + [0.0] * len(held[1]))
    model.mean, model.scale = x.mean(0).tolist(), (x.std(0) + 1e-6).tolist()
    z = np.column_stack([np.ones(len(x)), (x - model.mean) / model.scale])
    w = np.zeros(z.shape[1])
    for _ in range(50):  # Newton's method with a small ridge
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 0.5 * np.eye(len(w)), z.T @ (y - p) - 0.5 * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    model.weights = w.tolist()
    return model


def _sliced(text: F.Column, most: int) -> F.Column:
    """A text of ``most`` characters at most: itself, or evenly spaced slices of it."""
    n, each = F.length(text), most // SLICES
    at = lambda k: (1 + F.floor((n - each) * k / F.lit(SLICES - 1))).cast("int")
    return F.when(n <= most, text).otherwise(F.concat(*(F.substring(text, at(k), F.lit(each)) for k in range(SLICES))))


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, sample_chars: int = SAMPLE_CHARS) -> tuple[list[bytes], list[bytes]]:
    """Texts of both classes, ``sample`` of each at most, chosen by a hash of the id.

    Ids are picked from the labels alone, so only the picked rows' texts move, one for
    each id (the smallest, if rows share it); their number and length are bounded, hence
    the broadcast and the collect are too.  Null ids, null texts and other labels
    than 0 and 1 take no part.
    """
    labels = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    order = (F.md5(F.col("doc_id").cast("string")), F.col("doc_id"))
    picked = None
    for label in (0, 1):
        part = labels.where(F.col("label") == label).distinct().orderBy(*order).limit(sample)
        picked = part if picked is None else picked.unionByName(part)
    texts = documents(docs, id_col, text_col).where("text is not null").join(F.broadcast(picked), "doc_id")
    rows = texts.select("label", "doc_id", _sliced(F.col("text"), sample_chars).alias("text")).groupBy("label", "doc_id").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: (r.label, r.doc_id))
    pick = lambda label: [r.text.encode() for r in rows if r.label == label]
    return pick(1), pick(0)


def quality_scores(spark: SparkSession, docs: DataFrame, model: CompressionModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A score in [0, 1] for each row's whole text; null, empty and blank texts get the prior.

    Repeated rows get equal scores, null ids stay; other columns don't matter.  A very
    long text is compressed piece by piece, so it costs its own size alone.  No
    exchange: the model is two dictionaries of DICT_BYTES and a few numbers.
    """
    shared = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                texts = [(t or "").encode() for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(shared.value.scores(texts))], names=SCORES.names)

    return documents(docs, id_col, text_col).mapInArrow(score, SCORES)


def filter_by_quality(spark: SparkSession, docs: DataFrame, model: CompressionModel, threshold: float, text_col: str = "text") -> DataFrame:
    """The rows whose text scores ``threshold`` or more, with all their columns, whatever their names.

    Null, empty and blank texts score the prior; each of several equal rows is judged
    alone.  Texts are scored whole, in pieces.
    """
    shared = spark.sparkContext.broadcast(model)
    where = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                yield part.filter(pa.array(shared.value.scores([(t or "").encode() for t in part.column(where).to_pylist()]) >= threshold))

    return docs.mapInArrow(keep, docs.schema)


def training_rows(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Labels of the training folds: crc32 of the id's text, modulo 5, is not 0."""
    return labels.where(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 != 0)
