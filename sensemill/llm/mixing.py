"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .shared import Workspace

WEIGHTS = (5, 2, 1)
#: The mix holds so many percent of all words; a document may be taken so many times.
BUDGET_PERCENT = 150
EPOCHS = 2
#: Rows that one window group of the running sums holds, about.
GROUP_ROWS = 1000


def n_words(text: Column) -> Column:
    """Words: runs of characters other than blank and 09-0D; null has none."""
    parts = F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+")
    return (F.size(parts) - (parts[0] == "").cast("int") - ((F.size(parts) > 1) & (F.element_at(parts, -1) == "")).cast("int")).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget_percent: int = BUDGET_PERCENT, epochs: int = EPOCHS) -> DataFrame:
    """Each source's target: its weight's share of the budget, at most ``epochs`` times its size.

    ``sources`` has source and source_size.  What a source can't fill is dealt to the
    others by weight, until none is above its limit.  That fixed point has a closed
    form: in the order of limit / weight a prefix of the sources is full, and the rest
    share what is left.  One row for each source takes part.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    k = len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % k + 1).cast("int")).cast("double")
    s = sources.select("source", "source_size", weight.alias("weight"))
    s = s.withColumns({"most": (epochs * F.col("source_size")).cast("double"), "budget": F.sum("source_size").over(W.partitionBy()) * budget_percent / F.lit(100.0)})
    ordered = W.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = ordered.rowsBetween(W.unboundedPreceding, -1)
    s = s.withColumn("level", (F.col("budget") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(ordered.rowsBetween(W.currentRow, W.unboundedFollowing)))
    # the first source that is not full sets the level for it and all after it
    level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("most"), F.struct(F.col("most") / F.col("weight"), "level"))).over(W.partitionBy())["level"]
    return s.withColumn("target", F.least(F.col("most"), F.coalesce(level * F.col("weight"), F.col("most")))).select("source", "source_size", "weight", "target")


def running_sum(df: DataFrame, keys: list[str], place: Column, order: list[str], value: str, fine: int, out: str, coarse: int = 1024) -> DataFrame:
    """Sum of ``value`` up to and with each row, within ``keys``, in the order of ``place`` (in [0, 1)) and ``order``.

    A range partition in three levels: coarse slots of the place, fine slots in them,
    rows in these.  Sums of slots are added first, so no window group holds more than
    ``coarse``, ``fine`` or about GROUP_ROWS rows, whatever the size of a key.
    """
    slot = F.floor(place * (coarse * fine)).cast("long")
    slot = F.least(F.greatest(slot, F.lit(0)), F.lit(coarse * fine - 1))
    rows = df.withColumn("_slot", slot)
    as_key = {k: f"_{k}" for k in keys}  # keys of the slots' tables, apart from the rows' own
    lead = list(as_key.values())
    before = lambda w: F.coalesce(F.sum("_sum").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    cells = rows.groupBy(*(F.col(k).alias(v) for k, v in as_key.items()), F.col("_slot").alias("_cell")).agg(F.sum(value).alias("_sum")).withColumn("_coarse", F.floor(F.col("_cell") / fine))
    slots = cells.groupBy(*(F.col(k).alias(f"{k}_") for k in lead), F.col("_coarse").alias("_coarse_")).agg(F.sum("_sum").alias("_sum"))
    slots = slots.select(*(f"{k}_" for k in lead), "_coarse_", before(W.partitionBy(*(f"{k}_" for k in lead)).orderBy("_coarse_")).alias("_base"))
    cells = cells.join(slots, _equal({**{k: f"{k}_" for k in lead}, "_coarse": "_coarse_"}))
    cells = cells.select(*lead, "_cell", (F.col("_base") + before(W.partitionBy(*lead, "_coarse").orderBy("_cell"))).alias("_base"))
    within = W.partitionBy(*keys, "_slot").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("_own", F.sum(value).over(within))
    joined = rows.join(cells, _equal({**as_key, "_slot": "_cell"}))
    return joined.select(*df.columns, (F.col("_base") + F.col("_own")).alias(out))


def _equal(names: dict[str, str]) -> Column:
    """Null-safe equality of pairs of columns."""
    out = F.lit(True)
    for a, b in names.items():
        out = out & F.col(a).eqNullSafe(F.col(b))
    return out


def weighted_mix(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, budget_percent: int = BUDGET_PERCENT, epochs: int = EPOCHS, seed: str = "mix") -> DataFrame:
    """How often the mix takes each document: doc_id, source, size, source_size, target, copies, taken.

    Documents are shuffled by a hash of their id.  A copy's virtual finish time is the
    running sum of its source's words, over all epochs, divided by the source's
    target; copies are sorted by it through ranges, and the mix ends where the total
    reaches the budget.  Sources of equal finish times go in order of the hash.

    Null sources form one source, after all others; null and empty texts have size 0
    and are taken for nothing; repeated rows are documents of their own, apart only
    by size; null ids are equal to each other; other columns don't matter; reruns agree.
    A very long text is taken whole or not at all.  The targets are worked out in
    windows over one row a source, so sources must be few against documents.
    """
    work = Workspace(spark, "mixing", docs)
    doc = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size"))
    doc = doc.withColumn("h", F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f"#{seed}"))))
    doc = work.keep(doc, "sizes", few=True)
    sources = doc.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    goal = work.keep(targets(sources.select("source", "source_size"), weights, budget_percent, epochs), "targets")
    total = sources.agg(F.sum("n").alias("n"), F.sum("source_size").alias("words")).first()
    rows, budget = total.n or 0, (total.words or 0) * budget_percent / 100.0
    fine = max(1, rows // (1024 * GROUP_ROWS))
    unit = F.conv(F.substring("h", 1, 12), 16, 10).cast("double") / float(1 << 48)
    queued = running_sum(doc, ["source"], unit, ["h", "doc_id", "size"], "size", fine, "upto")
    queued = queued.join(goal.withColumnRenamed("source", "_source"), _equal({"source": "_source"})).drop("_source", "weight")
    queued = work.keep(queued, "queued", few=True)
    # every copy of a document, by its finish time as a share of the last one that can matter
    copies = queued.where("size > 0").select("doc_id", "h", "size", "source", "target", "source_size", "upto", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch"))
    copies = copies.withColumn("finish", (F.col("epoch") * F.col("source_size") + F.col("upto")) / F.col("target"))
    last = copies.agg(F.max("finish")).first()[0] or 1.0
    taken = running_sum(copies, [], F.col("finish") / (last * (1 + 1e-9)), ["finish", "h", "doc_id", "size", "epoch"], "size", epochs * fine, "total")
    keys = ["doc_id", "h", "size", "source", "upto"]
    taken = taken.where(F.col("total") <= budget).groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(F.count("*").alias("n"))
    out = queued.join(taken, _equal({k: f"_{k}" for k in keys}), "left").withColumn("copies", F.coalesce("n", F.lit(0)).cast("long"))
    return work.gathered(out).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
