"""The corpus pipeline: five stages, each over all that its predecessor kept.

Quality classifier, n-gram Jaccard join, benchmark decontamination, personal data,
mixing to target weights.  Every stage is written as Parquet and read again as the
next one's documents, in as many files as its input has pieces of some 64 MB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensemill.llm import compression, decontaminate, jaccard_join, mixing, pii
from sensemill.llm.queries import QUALITY_THRESHOLD, quality_model
from sensemill.llm.shared import Workspace, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier doesn't reject."""
    kept = compression.filter_by_quality(spark, docs, quality_model(docs, table(spark, sf_dir, "labels")), QUALITY_THRESHOLD)
    return Workspace(spark, "quality", docs).gathered(kept)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones, that with the smallest id; those without words stay."""
    return jaccard_join.keep_one(spark, docs, shingle=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents (5 % of words hit) go; from others the hit words are cut."""
    return Workspace(spark, "decontamination", docs).gathered(decontaminate.clean(spark, docs, table(spark, sf_dir, "benchmark")))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked, disguised or not."""
    return Workspace(spark, "personal-data", docs).gathered(pii.redact(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often each document is taken to meet the sources' target weights."""
    return mixing.weighted_mix(spark, docs).select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


STAGES = [
    ("quality classifier", quality),
    ("n-gram jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("pii", personal_data),
    ("mixing to target weights", mix),
]

#: Compression, personal data and the join have no SQL form; tests hold every stage and the whole against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = work.keep(docs, f"stage-{i}")
    return docs
