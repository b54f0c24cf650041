"""Local session and the Spark-versus-DuckDB comparison used by the tests.

``python -m tests.harness SF NAME...`` compares single queries by hand.
"""

from __future__ import annotations

import datetime
import math
import sys
import time

import duckdb
from pyspark.sql import DataFrame, SparkSession

from textjudge.plans.views import TABLES

DATA = "/root/testdata"


def local_session(cores: str = "8") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("textjudge-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.log.level", "ERROR")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    return spark


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, bool):
        return str(int(value))
    if isinstance(value, (list, tuple)):
        return str([plain(v) for v in value])
    if isinstance(value, dict):
        return str({k: plain(v) for k, v in value.items()})
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    if value is None:
        return None
    return str(value)


def spark_rows(df: DataFrame):
    names = sorted(df.columns)
    rows = [tuple(plain(v) for v in r) for r in df.select(*[f"`{n}`" for n in names]).collect()]
    return names, sorted(rows, key=str)


def duck_rows(con, sql: str):
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    rows = [tuple(plain(r[i]) for i in order) for r in cur.fetchall()]
    return [cols[i] for i in order], sorted(rows, key=str)


def difference(left, right) -> str:
    """Empty when both results hold the same columns and rows."""
    if left[0] != right[0]:
        return f"columns differ: {left[0]} / {right[0]}"
    if len(left[1]) != len(right[1]):
        only = sorted(set(left[1]) - set(right[1]), key=str)[:3]
        other = sorted(set(right[1]) - set(left[1]), key=str)[:3]
        return f"row counts differ: {len(left[1])} / {len(right[1])}\n  {only}\n  {other}"
    bad = [(a, b) for a, b in zip(left[1], right[1]) if a != b]
    return f"{len(bad)} rows differ\n  {left[0]}\n  {bad[0][0]}\n  {bad[0][1]}" if bad else ""


def main() -> None:
    import __spark_entry__ as entry

    sf_dir = f"{DATA}/sf{sys.argv[1]}"
    prefixes = sys.argv[2:]
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = [n for n in queries if not prefixes or any(n.startswith(p) for p in prefixes)]
    spark, con = local_session(), duck(sf_dir)
    failed = 0
    for name in names:
        start = time.time()
        try:
            got = spark_rows(queries[name](spark, sf_dir))
            took = time.time() - start
            text = "rows only"
            if name in oracles:
                text = difference(got, duck_rows(con, oracles[name])) or "equal"
        except Exception as error:  # report and go on with the next query
            took, text = time.time() - start, f"ERROR {str(error)[:300]}"
            got = ([], [])
        failed += text not in ("equal", "rows only")
        print(f"{name:34s} {len(got[1]):7d} rows {took:6.2f}s  {text}", flush=True)
    print(f"{len(names)} queries, {failed} failed")


if __name__ == "__main__":
    main()
