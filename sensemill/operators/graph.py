"""Concept-term graphs: ids, ambiguity, edges and profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import hashed_order
from ..sources.workspace import numbered


def parse_pairs(lines: DataFrame) -> DataFrame:
    """``concept<TAB>term, term`` lines to concept_id, term, term_pos (from 0), lower-cased."""
    parts = F.split(F.lower(F.col("value")), "\t")
    found = lines.select(parts[0].alias("concept_id"), F.posexplode(F.split(parts[1], ",")).alias("term_pos", "term"))
    return found.select("concept_id", F.trim("term").alias("term"), F.col("term_pos").cast("int").alias("term_pos"))


def term_ids(terms: DataFrame, first: Column) -> DataFrame:
    """Dense ids from 0 in the order of each term's first appearance."""
    found = terms.groupBy("term").agg(F.min(first).alias("first"))
    return numbered(found, ["first", "term"], "term_id").select(F.col("term_id").cast("int").alias("term_id"), "term")


def ambiguous_terms(concept_terms: DataFrame, literal: bool = False) -> DataFrame:
    """term, concept_id of terms with two concepts or more.

    ``literal`` leaves the last concept out.
    """
    pairs = concept_terms.select("concept_id", "term").distinct()
    if literal:
        last = pairs.agg(F.max("concept_id").alias("last"))
        pairs = pairs.join(last, pairs["concept_id"] == last["last"], "left_anti")
    many = pairs.groupBy("term").agg(F.count("*").alias("n")).where("n > 1").select("term")
    return pairs.join(many, "term").select("term", "concept_id")


def filter_lists(concept_terms: DataFrame, allow: DataFrame | None = None, block: DataFrame | None = None) -> DataFrame:
    out = concept_terms
    if block is not None:
        out = out.join(block, "concept_id", "left_anti")
    return out if allow is None else out.join(allow, "concept_id", "left_semi")


def leaf_only(concepts: DataFrame, children: DataFrame, most: int = 1) -> DataFrame:
    """Concepts with at most ``most`` descendants (children: concept_id, child_id)."""
    inner = children.groupBy("concept_id").agg(F.count("*").alias("n")).where(F.col("n") > most)
    return concepts.join(inner, "concept_id", "left_anti")


def _sizes(concept_terms: DataFrame, key: str) -> DataFrame:
    return concept_terms.groupBy(key).agg(F.count("*").alias("n"))


def graph_profile(concept_terms: DataFrame) -> DataFrame:
    """Sizes of concepts, ambiguity of terms, senses for each concept."""
    c = _sizes(concept_terms, "concept_id").agg(F.max("n").alias("max_size"), F.round(F.avg("n"), 6).alias("avg_size"), F.min("n").alias("min_size"), F.count("*").alias("n_concepts"), F.sum("n").alias("n_senses"))
    t = _sizes(concept_terms, "term").agg(F.max("n").alias("max_ambiguity"), F.round(F.avg("n"), 6).alias("avg_ambiguity"), F.count("*").alias("n_terms"))
    both = c.withColumn("k", F.lit(1)).join(t.withColumn("k", F.lit(1)), "k").drop("k")
    return both.withColumn("senses_per_concept", F.round(F.col("n_senses") / F.col("n_concepts"), 6))


def term_class_counts(concept_terms: DataFrame) -> DataFrame:
    """Terms that only have synonyms, are only ambiguous, both, or neither."""
    size = concept_terms.withColumn("size", F.count("*").over(W.partitionBy("concept_id")))
    t = size.groupBy("term").agg((F.max("size") > 1).alias("syn"), (F.count("*") > 1).alias("pol"))
    s, p = F.col("syn"), F.col("pol")
    return t.agg(F.count_if(s & ~p).alias("syn_only"), F.count_if(~s & p).alias("pol_only"), F.count_if(s & p).alias("both"), F.count_if(~s & ~p).alias("neither"))


def syn_edges(concept_terms: DataFrame) -> DataFrame:
    """Pairs of terms of one concept."""
    a, b = concept_terms.alias("a"), concept_terms.alias("b")
    return a.join(b, (F.col("a.concept_id") == F.col("b.concept_id")) & (F.col("a.term") < F.col("b.term"))).select(F.col("a.concept_id").alias("concept_id"), F.col("a.term").alias("term_a"), F.col("b.term").alias("term_b"))


def pol_edges(concept_terms: DataFrame) -> DataFrame:
    """Pairs of concepts of one term."""
    a, b = concept_terms.alias("a"), concept_terms.alias("b")
    return a.join(b, (F.col("a.term") == F.col("b.term")) & (F.col("a.concept_id") < F.col("b.concept_id"))).select(F.col("a.term").alias("term"), F.col("a.concept_id").alias("concept_a"), F.col("b.concept_id").alias("concept_b"))


def ambiguous_synonyms(concept_terms: DataFrame, least_pol: int = 2, least_syn: int = 1) -> DataFrame:
    """Terms with so many concepts, so many of them with synonyms."""
    size = concept_terms.withColumn("size", F.count("*").over(W.partitionBy("concept_id")))
    return size.groupBy("term").agg(F.count("*").alias("n_concepts"), F.count_if(F.col("size") > 1).alias("n_synonymous")).where((F.col("n_concepts") >= least_pol) & (F.col("n_synonymous") >= least_syn))


def density_alpha(concept_terms: DataFrame, term_obs: DataFrame) -> DataFrame:
    """Densities for Dirichlet processes: concepts per log observations of terms, concepts per log senses."""
    n = term_obs.groupBy("term").agg(F.count("*").alias("n"))
    c = _sizes(concept_terms, "term").withColumnRenamed("n", "c")
    per = n.join(c, "term").agg(F.sum(F.when(F.col("n") > 1, F.col("c") / F.ln("n")).otherwise(0.0)).alias("s"), F.count("*").alias("k"))
    t = concept_terms.agg(F.countDistinct("concept_id").alias("concepts"), F.count("*").alias("senses"))
    both = per.withColumn("j", F.lit(1)).join(t.withColumn("j", F.lit(1)), "j")
    return both.select(F.round(F.col("s") / F.nullif(F.col("k"), F.lit(0)), 6).alias("alpha_pol"), F.round(F.when(F.col("senses") > 1, F.col("concepts") / F.ln("senses")), 6).alias("alpha_syn"))


def trim_ambiguous(concept_terms: DataFrame, with_observations: DataFrame) -> DataFrame:
    """Terms of which two concepts or more have observations."""
    return ambiguous_terms(concept_terms.join(with_observations, "concept_id", "left_semi"))


def isolated_nodes(concept_terms: DataFrame) -> DataFrame:
    """Pairs (concept, term) without another term in the concept and without another concept of the term."""
    sized = concept_terms.withColumns({"c": F.count("*").over(W.partitionBy("concept_id")), "t": F.count("*").over(W.partitionBy("term"))})
    return sized.where("c = 1 and t = 1").select("concept_id", "term")


Node = tuple[str, str]


def chosen_nodes(syn: list[tuple[Node, Node]], pol: list[tuple[Node, Node]], alone: list[Node], size: int | None) -> tuple[list[Node], list[bool]]:
    """Nodes in the order in which rounds bring them in, until a round brings nothing new; and which kinds ran out before.

    A round takes one edge inside a concept, one across concepts and one isolated node,
    each kind while it has no more than ``size`` nodes (the largest kind's number, if
    None) and anything is left.
    """
    kinds = [(iter(edges), set()) for edges in (syn, pol, [(n,) for n in alone])]
    nodes: dict[Node, None] = {}
    short = [False] * 3
    while True:
        most = max(len(own) for _, own in kinds) if size is None else size
        before = len(nodes)
        for k, (edges, own) in enumerate(kinds):
            found = next(edges, None) if len(own) <= most else ()
            short[k] |= found is None
            own.update(found or ())
            nodes.update(dict.fromkeys(found or ()))
        if len(nodes) == before:
            return list(nodes), short


def balanced_subgraph(concept_terms: DataFrame, size: int, seed: str) -> DataFrame:
    """A sub-graph with as many ambiguous, synonymous and isolated nodes, and new dense ids.

    Edges and isolated nodes come in hashed order.  An edge may bring nothing new, so
    rounds may want more than ``size`` of them: lists of bounded length are fetched, and
    twice as long ones where one ran out.  Returns concept_idx, concept_id, term_idx,
    term, ids in the order in which nodes came in.
    """
    in_order = lambda df: df.orderBy(hashed_order(F.concat_ws("|", *df.columns), seed), *df.columns)
    lists = in_order(syn_edges(concept_terms)), in_order(pol_edges(concept_terms)), in_order(isolated_nodes(concept_terms))
    most = 2 * size + 16
    while True:
        syn, pol, alone = ([tuple(r) for r in df.limit(most).collect()] for df in lists)
        nodes, short = chosen_nodes([((c, a), (c, b)) for c, a, b in syn], [((a, t), (b, t)) for t, a, b in pol], alone, size)
        if not any(ran_out and len(x) == most for ran_out, x in zip(short, (syn, pol, alone), strict=True)):
            break
        most *= 2
    concepts, terms = (list(dict.fromkeys(n[k] for n in nodes)) for k in (0, 1))
    rows = [(concepts.index(c), c, terms.index(t), t) for c, t in nodes]
    return concept_terms.sparkSession.createDataFrame(rows, "concept_idx long, concept_id string, term_idx long, term string")
