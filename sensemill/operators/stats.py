"""Batches of result rows: constraints, grouped statistics and t-tests."""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse_constraints(text: str) -> dict[str, tuple[str, str]]:
    """``h=v,h<v,h>v`` to header -> (operator, value); the last one of a header wins."""
    out = {}
    for part in filter(None, text.split(",")):
        m = re.fullmatch(r"([^=<>]+)([=<>])([^=<>].*)", part)
        if not m:
            raise ValueError(f"not a constraint: {part!r}")
        out[m[1]] = (m[2], m[3])
    return out


def constrained(df: DataFrame, text: str) -> DataFrame:
    """Rows that meet all constraints: ``=`` compares strings, ``<`` and ``>`` numbers."""
    cond = F.lit(True)
    for header, (op, value) in parse_constraints(text).items():
        c = F.col(header)
        cond = cond & (c.cast("string") == value if op == "=" else c.cast("double") < float(value) if op == "<" else c.cast("double") > float(value))
    return df.where(cond)


def number(text: Column) -> Column:
    """A cell's number: the text None counts as 0, other text as null."""
    return F.when(text == "None", F.lit(0.0)).otherwise(text.try_cast("double"))


def unpivot(df: DataFrame, batch: str, headers: list[str]) -> DataFrame:
    """batch, header, value (string), x (number)."""
    long = df.select(F.col(batch).alias("batch"), *(F.col(h).cast("string").alias(h) for h in headers)).unpivot("batch", headers, "header", "value")
    return long.withColumn("x", number(F.col("value")))


def batch_stats(long: DataFrame) -> DataFrame:
    """Average, population deviation, least and most by batch and header; one non-numeric value makes the averages null."""
    pure = F.count_if(F.col("x").isNull() & F.col("value").isNotNull()) == 0
    return long.groupBy("batch", "header").agg(
        F.count("*").alias("n"), F.round(F.when(pure, F.avg("x")), 6).alias("avg"), F.round(F.when(pure, F.stddev_pop("x")), 6).alias("std"), F.round(F.min("x"), 6).alias("min"), F.round(F.max("x"), 6).alias("max")
    )


def batch_sizes(df: DataFrame, batch: str) -> DataFrame:
    """Rows of each batch, and of all (batch null)."""
    return df.rollup(F.col(batch).alias("batch")).agg(F.count("*").alias("n"))


def _moments(long: DataFrame) -> DataFrame:
    return long.groupBy("batch", "header").agg(F.count("x").alias("n"), F.avg("x").alias("m"), F.var_samp("x").alias("s"))


def welch(long: DataFrame) -> DataFrame:
    """t and degrees of freedom for every pair of batches; null where averages are equal."""
    a, b = _moments(long).alias("a"), _moments(long).alias("b")
    ea, eb = F.col("a.s") / F.col("a.n"), F.col("b.s") / F.col("b.n")
    differ = F.col("a.m") != F.col("b.m")
    t = F.when(differ, (F.col("a.m") - F.col("b.m")) / F.nullif(F.sqrt(ea + eb), F.lit(0.0)))
    df = F.when(differ, (ea + eb) * (ea + eb) / F.nullif(ea * ea / (F.col("a.n") - 1) + eb * eb / (F.col("b.n") - 1), F.lit(0.0)))
    met = a.join(b, (F.col("a.header") == F.col("b.header")) & (F.col("a.batch") < F.col("b.batch")))
    return met.select(F.col("a.header").alias("header"), F.col("a.batch").alias("batch_a"), F.col("b.batch").alias("batch_b"), F.round(t, 4).alias("t"), F.round(df, 2).alias("df"))


def paired_t(pairs: DataFrame) -> DataFrame:
    """t and degrees of freedom of paired values (columns x and y)."""
    d = pairs.agg(F.count("*").alias("n"), F.avg(F.col("x") - F.col("y")).alias("m"), F.stddev_samp(F.col("x") - F.col("y")).alias("s"))
    return d.select("n", F.round(F.col("m") / F.nullif(F.col("s") / F.sqrt("n"), F.lit(0.0)), 4).alias("t"), (F.col("n") - 1).alias("df"))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz)."""
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d or tiny)
    out = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / ((1 + num * d) or tiny), (1 + num / c) or tiny
            out *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return out


def t_pvalue(t: float | None, df: float | None) -> float | None:
    """Two-sided p of Student's t."""
    if t is None or df is None:
        return None
    x, a, b = df / (df + t * t), df / 2, 0.5
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) if 0 < x < 1 else 0.0
    if x in (0, 1):
        return float(x)
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def with_pvalue(tests: DataFrame) -> DataFrame:
    """Adds p to a table of tests (few rows: one for each pair of batches and header)."""

    @F.pandas_udf("double")
    def p(t: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(a) or pd.isna(b) else t_pvalue(a, b) for a, b in zip(t, df, strict=True)], dtype="float64")

    return tests.withColumn("p", p("t", "df"))


def significant(tests: DataFrame, level: float = 0.05) -> DataFrame:
    """Tests (with p) below a level of significance."""
    return tests.where(F.col("p") < level)


def grid(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Every combination of the values that keys have; values are few, so each key's travel as one row."""
    out = None
    for k in keys:
        values = runs.agg(F.collect_set(k).alias("_v")).select(F.explode("_v").alias(k)).withColumn("_one", F.lit(1))
        out = values if out is None else out.join(values, "_one")
    return out.select(*keys)


def missing_runs(wanted: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Runs wanted that left no results."""
    return wanted.join(done.select(*keys), keys, "left_anti")
