"""The ten operator queries, as the driver calls them: (spark, folder of tables) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import compression, decontaminate, jaccard_join, mixing, pii, repetition, reputation, seed_extend, suffix_index, warc
from .shared import Workspace, table

#: Rules of the page filter.
RULES = [
    reputation.Rule("allow", "org", "/"),
    reputation.Rule("block", "example.org", "/es/"),
    reputation.Rule("block", "example.org", "/en/1"),
    reputation.Rule("allow", "com", "/fr/"),
    reputation.Rule("block", "com", "/de/"),
]
QUALITY_THRESHOLD = 0.3


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition_quality(table(spark, sf_dir, "documents")).drop("longest_repeat")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.weighted_mix(spark, table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seed_extend.remove_repeats(spark, table(spark, sf_dir, "documents"), keep_text=False).drop("kept_text")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontaminate.benchmark_hits(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep_text=False)
    return decontaminate.contamination_report(hits)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_index.remove_repeated_bytes(spark, table(spark, sf_dir, "documents"), keep_bytes=False).drop("kept")


def quality_model(docs: DataFrame, labels: DataFrame) -> compression.CompressionModel:
    return compression.fit(*compression.labelled_sample(docs, compression.training_rows(labels)))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scores = compression.quality_scores(spark, docs, quality_model(docs, table(spark, sf_dir, "labels")))
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    return scores.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= QUALITY_THRESHOLD).cast("int").alias("predicted"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reputation.judge_urls(spark, table(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(spark, table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Workspace(spark, "archive").path("warc")
    warc.archive_pages(spark, table(spark, sf_dir, "pages"), path)
    records = spark.read.format("warc").load(path)
    return records.select(
        warc.page_id_of(F.col("record_id")).alias("page_id"),
        F.coalesce(F.octet_length("payload").cast("long"), F.col("payload_length")).alias("payload_bytes"),
        "payload_digest",
        "record_type",
        warc.page_id_of(F.col("refers_to")).alias("refers_to"),
    )


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_array_quality": op1,
    "op2_pii_deobfuscation": op2,
    "op3_fair_queue_mix": op3,
    "op4_seed_extend_dedup": op4,
    "op5_decontamination": op5,
    "op6_suffix_index_dedup": op6,
    "op7_compression_classifier": op7,
    "op8_host_reputation": op8,
    "op9_jaccard_prefix_join": op9,
    "op10_warc_archive": op10,
    "pipeline": pipeline,
}
