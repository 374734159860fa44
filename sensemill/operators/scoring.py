"""Scores of a grouping against gold classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.workspace import numbered


def contingency(df: DataFrame, cls: str, cluster: str) -> DataFrame:
    """class_id, cluster_id, n of the cells that are not empty."""
    return df.groupBy(F.col(cls).alias("class_id"), F.col(cluster).alias("cluster_id")).agg(F.count("*").alias("n"))


def contingency_cube(df: DataFrame, cls: str, cluster: str) -> DataFrame:
    """Cells, row sums, column sums and the total in one pass."""
    c = df.select(F.col(cls).alias("class_id"), F.col(cluster).alias("cluster_id"))
    return c.cube("class_id", "cluster_id").agg(F.count("*").alias("n"))


def v_measure(cells: DataFrame) -> DataFrame:
    """Entropies, homogeneity, completeness and V of a contingency table; an entropy of 0 scores 1.

    The cells are few; margins come from two small aggregates, not from all rows.
    """
    s = cells.groupBy("class_id").agg(F.sum("n").alias("ns"))
    k = cells.groupBy("cluster_id").agg(F.sum("n").alias("nk"))
    t = cells.agg(F.sum("n").alias("t")).withColumn("one", F.lit(1))
    both = cells.join(s, "class_id").join(k, "cluster_id").withColumn("one", F.lit(1)).join(t, "one")
    p = F.col("n") / F.col("t")
    # a class's entropy term is spread over its cells
    h = both.agg(
        F.sum(-p * F.ln(F.col("ns") / F.col("t"))).alias("h_s"),
        F.sum(-p * F.ln(F.col("nk") / F.col("t"))).alias("h_k"),
        F.sum(-p * F.ln(F.col("n") / F.col("nk"))).alias("h_s_k"),
        F.sum(-p * F.ln(F.col("n") / F.col("ns"))).alias("h_k_s"),
    )
    score = lambda inner, whole: F.when(F.abs(whole) < 1e-12, F.lit(1.0)).otherwise(1 - inner / F.nullif(whole, F.lit(0.0)))
    h = h.withColumns({"homogeneity": score(F.col("h_s_k"), F.col("h_s")), "completeness": score(F.col("h_k_s"), F.col("h_k"))})
    v = 2 * F.col("homogeneity") * F.col("completeness") / F.nullif(F.col("homogeneity") + F.col("completeness"), F.lit(0.0))
    return h.withColumn("v", v).select(*(F.round(c, 6).alias(c) for c in ("h_s", "h_k", "h_s_k", "h_k_s", "homogeneity", "completeness", "v")))


def choose2(n: Column) -> Column:
    return n * (n - 1) / 2


def paired_f(cells: DataFrame) -> DataFrame:
    """Pair counts and the precision, recall and F of pairs."""
    same = cells.agg(F.sum(choose2(F.col("n"))).alias("same")).withColumn("one", F.lit(1))
    by_k = cells.groupBy("cluster_id").agg(F.sum("n").alias("n")).agg(F.sum(choose2(F.col("n"))).alias("in_clusters")).withColumn("one", F.lit(1))
    by_s = cells.groupBy("class_id").agg(F.sum("n").alias("n")).agg(F.sum(choose2(F.col("n"))).alias("in_classes")).withColumn("one", F.lit(1))
    p, r = F.col("same") / F.nullif(F.col("in_clusters"), F.lit(0.0)), F.col("same") / F.nullif(F.col("in_classes"), F.lit(0.0))
    out = same.join(by_k, "one").join(by_s, "one")
    return out.select("same", "in_clusters", "in_classes", F.round(p, 6).alias("p"), F.round(r, 6).alias("r"), F.round(2 * p * r / F.nullif(p + r, F.lit(0.0)), 6).alias("f"))


def term_confusion(df: DataFrame, key: str, gold: Column, predicted: Column) -> DataFrame:
    """Confusion counts, precision and recall by key; null where a denominator is 0."""
    c = df.groupBy(key).agg(F.count_if(gold & predicted).alias("tp"), F.count_if(~gold & predicted).alias("fp"), F.count_if(gold & ~predicted).alias("fn"), F.count_if(~gold & ~predicted).alias("tn"))
    zero = F.lit(0)
    return c.withColumns({"p": F.round(F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), zero), 6), "r": F.round(F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), zero), 6)})


def macro_prf(confusion: DataFrame) -> DataFrame:
    """Averages of precision and recall over keys that have them, and the F of the averages."""
    a = confusion.agg(F.avg("p").alias("p"), F.avg("r").alias("r"))
    return a.select(F.round("p", 6).alias("p"), F.round("r", 6).alias("r"), F.round(2 * F.col("p") * F.col("r") / F.nullif(F.col("p") + F.col("r"), F.lit(0.0)), 6).alias("f1"))


def accuracy(df: DataFrame, gold: str, predicted: str) -> DataFrame:
    return df.agg(F.round(F.avg((F.col(gold) == F.col(predicted)).cast("double")), 6).alias("accuracy"), F.count("*").alias("n"))


def overlap_column(cells: DataFrame, cluster: Column) -> DataFrame:
    """Overlap of one cluster with every class."""
    return cells.where(F.col("cluster_id") == cluster).select("class_id", "n")


def size_histogram(members: DataFrame, cluster: str) -> DataFrame:
    """How many clusters have each size."""
    return members.groupBy(cluster).agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("n_clusters"))


def gold_clusters(concept_terms: DataFrame, term_obs: DataFrame) -> DataFrame:
    """One cluster for each concept that has observations, of all its terms' observations."""
    met = concept_terms.join(term_obs, ["concept_id", "term"])
    ids = numbered(met.select("concept_id").distinct(), ["concept_id"], "cluster_id")
    return met.join(ids, "concept_id").select("cluster_id", "term", "obs_id")


def gold_senses(term_obs: DataFrame) -> DataFrame:
    """One cluster for each concept and term: gold senses without synonymy."""
    ids = numbered(term_obs.select("concept_id", "term").distinct(), ["concept_id", "term"], "cluster_id")
    return term_obs.join(ids, ["concept_id", "term"]).select("cluster_id", "concept_id", "term", "obs_id")


def initial_clusters(term_obs: DataFrame) -> DataFrame:
    """One cluster for each term with observations."""
    ids = numbered(term_obs.select("term").distinct(), ["term"], "cluster_id")
    return term_obs.join(ids, "term").select("cluster_id", "term", "obs_id")
