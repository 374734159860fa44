"""Run queries against their SQL equivalents: python tests/oracle_check.py FOLDER [NAME...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def normal(x):
    if isinstance(x, bool) or x is None or isinstance(x, str):
        return x
    if isinstance(x, float) or hasattr(x, "as_tuple"):
        x = float(x)
        return "nan" if math.isnan(x) else round(x, 6) + 0.0
    return x


def connect(sf_dir: str):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(normal(r[i]) for i in order) for r in rows), key=repr)


def compare(df, con, sql: str) -> str:
    got = rows_of(df.columns, df.collect())
    rel = con.execute(sql)
    want = rows_of([c[0] for c in rel.description], rel.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} instead of {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"{len(got[1])} rows instead of {len(want[1])}"
    bad = [(a, b) for a, b in zip(got[1], want[1], strict=True) if a != b]
    return f"{len(bad)} of {len(got[1])} rows differ, as {bad[0]}" if bad else ""


def main() -> None:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.log.level", "ERROR").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    con, queries, oracle = connect(sys.argv[1]), entry.queries(), entry.oracle_sql()
    for name in sys.argv[2:] or [k for k in queries if not k.startswith("op") and k != "pipeline"]:
        began = time.time()
        try:
            said = compare(queries[name](spark, sys.argv[1]), con, oracle[name]) if name in oracle else f"no SQL, {len(queries[name](spark, sys.argv[1]).collect())} rows"
        except Exception as e:
            said = f"FAILED {type(e).__name__} {str(e)[:600]}"
        print(f"{'ok  ' if not said or said.startswith('no SQL') else 'BAD '} {name} {said} {time.time() - began:.1f}s", flush=True)


if __name__ == "__main__":
    main()
