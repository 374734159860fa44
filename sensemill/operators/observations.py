"""Observation tables: indexes, quotas, splits, flags and features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import hashed_order
from ..functions.vectors import repeated


def obs_index(obs: DataFrame, key: str, order: str) -> DataFrame:
    """Position (from 0) of each observation in its concept."""
    return obs.withColumn("obs_idx", (F.row_number().over(W.partitionBy(key).orderBy(order)) - 1).cast("int"))


def obs_profile(obs: DataFrame, key: str) -> DataFrame:
    n = obs.groupBy(key).agg(F.count("*").alias("n"))
    return n.agg(F.round(F.avg("n"), 6).alias("mean"), F.min("n").alias("min"), F.max("n").alias("max"), F.round(F.stddev_pop("n"), 6).alias("std"))


def obs_quota(obs: DataFrame, key: str, quota: Column, order: str) -> DataFrame:
    """The first observations of each concept, as many as its quota."""
    return obs.withColumn("rn", F.row_number().over(W.partitionBy(key).orderBy(order))).where(F.col("rn") <= quota).drop("rn")


def term_obs_assign(concept_terms: DataFrame, obs: DataFrame, seed: str, flags: DataFrame | None = None) -> DataFrame:
    """Deal a concept's shuffled observations evenly to its terms, the remainder to the last.

    concept_terms: concept_id, term; obs: concept_id, obs_id.  The term at position p of
    m gets rows floor(n p / m) up to floor(n (p + 1) / m).  Observations in ``flags``
    (the same columns) are left out first.
    """
    if flags is not None:
        obs = obs.join(flags, ["concept_id", "obs_id"], "left_anti")
    terms = concept_terms.withColumns({"p": F.row_number().over(W.partitionBy("concept_id").orderBy("term")) - 1, "m": F.count("*").over(W.partitionBy("concept_id"))})
    dealt = obs.withColumns({"i": F.row_number().over(W.partitionBy("concept_id").orderBy(hashed_order(F.col("obs_id"), seed), "obs_id")) - 1, "n": F.count("*").over(W.partitionBy("concept_id"))})
    lo, hi = F.floor(F.col("n") * F.col("p") / F.col("m")), F.when(F.col("p") == F.col("m") - 1, F.col("n")).otherwise(F.floor(F.col("n") * (F.col("p") + 1) / F.col("m")))
    return terms.join(dealt, "concept_id").where((F.col("i") >= lo) & (F.col("i") < hi)).select("concept_id", "term", "obs_id")


def split_partitions(obs: DataFrame, key: str, shares: list[float], seed: str) -> DataFrame:
    """Split each key's shuffled rows by shares, one row each at least; keys with fewer rows than parts drop out."""
    parts = len(shares)
    w = W.partitionBy(key)
    rows = obs.withColumns({"i": F.row_number().over(w.orderBy(hashed_order(F.col("obs_id"), seed), "obs_id")) - 1, "n": F.count("*").over(w)}).where(F.col("n") >= parts)
    free = F.col("n") - parts
    part, start = F.when(F.col("i") < parts, F.col("i")), F.lit(parts)
    for p, share in enumerate(shares):
        more = F.least(F.greatest(F.ceil(F.round(F.col("n") * F.lit(share), 9)) - 1, F.lit(0)), free)
        part = part.when((F.col("i") >= start) & (F.col("i") < start + more), F.lit(p))
        start, free = start + more, free - more
    return rows.select(key, "obs_id", part.otherwise(F.lit(parts - 1)).cast("int").alias("part"))


def union_term_obs(*tables: DataFrame) -> DataFrame:
    """Bag union of observation tables: term, n, and the observations in order."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.groupBy("term").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("obs_id")).cast("array<string>"), ",").alias("obs"))


def flag_union(duplicates: DataFrame, missing: DataFrame) -> DataFrame:
    return duplicates.unionByName(missing).distinct()


def exact_duplicates(df: DataFrame, id_col: str, content: str) -> DataFrame:
    """Ids of all members of groups of equal content."""
    many = df.groupBy(F.md5(content).alias("digest")).agg(F.count("*").alias("n")).where("n > 1").select("digest")
    return df.withColumn("digest", F.md5(content)).join(many, "digest", "left_semi").select(id_col)


def drop_flagged(df: DataFrame, flags: DataFrame, on: str, literal: bool = False) -> DataFrame:
    """Rows without a flag; ``literal`` keeps the flagged ones instead."""
    return df.join(flags, on, "left_semi" if literal else "left_anti")


def both_modalities(images: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """Observations with both vectors (key, image; key, text)."""
    return images.join(texts, key)


def early_fusion(df: DataFrame, image: str, text: str, image_times: int, text_times: int) -> DataFrame:
    """One vector of both modalities, each repeated so many times."""
    return df.withColumn("fused", F.concat(repeated(F.col(image), image_times), repeated(F.col(text), text_times)))
