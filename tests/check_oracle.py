"""Run queries and their SQL side by side: check_oracle.py SF_DIR [names...]."""

from __future__ import annotations

import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as entry  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(
        (tuple(r[i] for i in order) for r in rows), key=lambda r: [str(v) for v in r]
    )


def compare(spark, con, sf_dir, name):
    """(message or None, number of rows, seconds of Spark, seconds of SQL)."""
    t0 = time.time()
    df = entry.queries()[name](spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    t1 = time.time()
    cur = con.execute(entry.oracle_sql()[name])
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    t2 = time.time()
    problem = None
    if got[0] != want[0]:
        problem = f"columns {got[0]} <> {want[0]}"
    elif len(got[1]) != len(want[1]):
        a, b = set(got[1]), set(want[1])
        problem = f"{len(got[1])} <> {len(want[1])} rows; {list(a - b)[:3]} | {list(b - a)[:3]}"
    else:
        for g, w in zip(got[1], want[1], strict=True):
            if g != w:
                problem = f"{g} <> {w}"
                break
            if [type(v) for v in g] != [type(v) for v in w]:
                problem = f"types {g} <> {w}"
                break
    if problem is None and not got[1]:
        problem = "no rows"
    return problem, len(got[1]), t1 - t0, t2 - t1


def main() -> None:
    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf_dir)
    for name in names or entry.queries():
        if name not in entry.oracle_sql():
            print(f"{name:28s} no SQL")
            continue
        try:
            problem, n, a, b = compare(spark, con, sf_dir, name)
        except Exception as e:  # report and go on
            problem, n, a, b = f"{type(e).__name__} {str(e)[:600]}", 0, 0.0, 0.0
        print(f"{name:28s} {n:7d} {a:6.2f} {b:6.2f} {problem or 'ok'}"[:900], flush=True)


if __name__ == "__main__":
    main()
