"""Readers and writers."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .workspace import numbered

#: Shape of a stored search response.
SEARCH_RESPONSE = "links array<string>, description array<string>, title array<string>, result_qty array<string>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """``concept<TAB>term, term`` lines."""
    from ..operators.graph import parse_pairs

    return parse_pairs(spark.read.text(path))


def read_list(spark: SparkSession, path: str, name: str = "concept_id") -> DataFrame:
    """One id a line, trimmed and lower-cased; blank lines dropped."""
    return spark.read.text(path).select(F.lower(F.trim("value")).alias(name)).where(F.length(name) > 0)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header whose names are trimmed."""
    df = spark.read.csv(path, header=True)
    return df.toDF(*(c.strip() for c in df.columns))


def write_results(df: DataFrame, path: str) -> None:
    """CSV of the rows without missing values."""
    df.na.drop().write.mode("overwrite").csv(path, header=True)


def write_by_key(df: DataFrame, key: str, path: str) -> None:
    """One folder for each key; an unchanged rerun is harmless."""
    df.repartition(key).write.mode("overwrite").partitionBy(key).parquet(path)


def read_key(spark: SparkSession, path: str, key: str, value: str) -> DataFrame:
    """One key's rows; only its folder is read."""
    return spark.read.parquet(path).where(F.col(key) == value)


def write_nested(df: DataFrame, keys: list[str], path: str) -> None:
    """Nested folders by keys; an existing output is left alone."""
    df.write.mode("ignore").partitionBy(*keys).parquet(path)


def write_table(df: DataFrame, path: str) -> None:
    """The whole table, in place of what was there."""
    df.write.mode("overwrite").parquet(path)


def in_ranges(df: DataFrame, key: str, parts: int) -> DataFrame:
    """Rows with ``slice``, of contiguous ranges of the distinct keys: slice s holds places int(s n / parts) up to int((s + 1) n / parts)."""
    ids = numbered(df.select(key).distinct(), [key], "_place")
    n = ids.count()
    return df.join(ids.select(key, (F.ceil((F.col("_place") + 1) * parts / n) - 1).cast("int").alias("slice")), key)


def write_ranges(df: DataFrame, key: str, parts: int, path: str) -> None:
    """Contiguous ranges of the key, one folder each."""
    in_ranges(df, key, parts).write.mode("overwrite").partitionBy("slice").parquet(path)


def _folders(spark: SparkSession, path: str, key: str) -> list[str]:
    """Values of the key that have a folder with files."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.globStatus(jvm.org.apache.hadoop.fs.Path(at, f"{key}=*/*")) or []
    return sorted({f.getPath().getParent().getName().split("=", 1)[1] for f in found})


def write_missing(df: DataFrame, key: str, path: str) -> list[str]:
    """Write the folders of the key that aren't there yet, and only these; returns those found in place."""
    have = _folders(df.sparkSession, path, key)
    df.where(~F.col(key).cast("string").isin(have) if have else F.lit(True)).write.mode("append").partitionBy(key).parquet(path)
    return have


def union_last(frames: list[DataFrame], key: str, warn: bool = False) -> DataFrame:
    """Union by key; of equal keys the last frame's rows stay.  ``warn`` looks for keys in several frames and says so."""
    out = frames[0].withColumn("_at", F.lit(0))
    for i, f in enumerate(frames[1:], 1):
        out = out.unionByName(f.withColumn("_at", F.lit(i)))
    last = out.groupBy(key).agg(F.max("_at").alias("_last"), F.min("_at").alias("_first"))
    if warn and (n := last.where("_first < _last").count()):
        warnings.warn(f"{n} keys stand in several tables; the last one's rows stay", stacklevel=2)
    return out.join(last.select(F.col(key), F.col("_last").alias("_at")), [key, "_at"], "left_semi").drop("_at")


def extract_features(df: DataFrame, key: str, content: str, extract: Callable[[list[bytes]], list[list[float]]], batch: int = 100) -> DataFrame:
    """key, vec: an external feature extractor, called with ``batch`` contents at a time."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for i in range(0, len(part), batch):
                some = part.iloc[i : i + batch]
                yield pd.DataFrame({key: some[key], "vec": [list(map(float, v)) for v in extract([bytes(c) for c in some[content]])]})

    rows = df.select(key, F.col(content).cast("binary").alias(content))
    return rows.mapInPandas(run, f"{key} {dict(rows.dtypes)[key]}, vec array<double>")


def run_files(spark: SparkSession, path: str) -> DataFrame:
    """Files named ``run_pol_syn_fold.kind.ext``: path, pol, syn, fold, kind; others are left out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.*.*").option("recursiveFileLookup", "true").load(path).select("path")
    name = F.element_at(F.split("path", "/"), -1)
    parts, run = F.split(name, r"\."), F.split(F.split(name, r"\.")[0], "_")
    return files.where((F.size(parts) == 3) & (F.size(run) == 4)).select("path", run[1].alias("pol"), run[2].alias("syn"), run[3].alias("fold"), parts[1].alias("kind"))


def parse_search(df: DataFrame, column: str) -> DataFrame:
    """A stored search response as columns."""
    return df.select("*", F.from_json(column, SEARCH_RESPONSE).alias("_r")).select(*df.columns, "_r.*")


def read_word_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Text format of word vectors (a word and its numbers on each line; a header line of two numbers is left out): word, vec."""
    parts = F.split(F.trim("value"), " ")
    return spark.read.text(path).where(F.size(parts) > 2).select(parts[0].alias("word"), F.slice(parts, 2, F.size(parts) - 1).cast("array<double>").alias("vec"))


def read_word_list(spark: SparkSession, path: str) -> DataFrame:
    return read_list(spark, path, "word").distinct()
