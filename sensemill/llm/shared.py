"""Table access, schemas and filters of the corpus operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.workspace import CLEAN_UP, Workspace, setting, shared_dir

__all__ = ["CLEAN_UP", "Workspace", "documents", "fields", "maybe_needed", "setting", "shared_dir", "table"]

#: Bits of the map of needed texts: bounded, whatever the corpus; where it fills up, more texts move and the join drops them.
NEEDED_BITS = 24


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_TYPES = {"long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(), "boolean": T.BooleanType(), "binary": T.BinaryType()}


def fields(**types: str) -> T.StructType:
    """A schema from names and the names of simple types or arrays of these."""
    kind = lambda v: T.ArrayType(_TYPES[v[6:-1]]) if v.startswith("array<") else _TYPES[v]
    return T.StructType([T.StructField(k, kind(v)) for k, v in types.items()])


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id and text alone, under fixed names, whatever other columns are called."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def maybe_needed(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose ``version`` may be among the ``v`` of ``needed``, before any exchange: a one-hash Bloom filter.

    The filter has 2**NEEDED_BITS bits, in words of 64, hence 2**(NEEDED_BITS - 6) rows
    at most; that bound is what allows the broadcast.  It lets no needed row go.
    """
    bit = lambda v: F.pmod(F.col(v), F.lit(1 << NEEDED_BITS))
    word = lambda v: F.shiftright(bit(v), 6).alias("_word")
    mask = lambda v: F.expr(f"shiftleft(1L, cast(pmod({v}, 64) as int))")
    words = needed.select(word("v"), mask("v").alias("_mask")).groupBy("_word").agg(F.bit_or("_mask").alias("_bits"))
    met = docs.withColumn("_word", word("version")).join(F.broadcast(words), "_word")
    return met.where(F.col("_bits").bitwiseAND(mask("version")) != 0).drop("_word", "_bits")
