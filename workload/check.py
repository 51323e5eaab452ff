"""Compare queries with their SQL: ``python -m workload.check [sf_dir] [query ...]``."""

from __future__ import annotations

import sys
import time
from collections import Counter

import duckdb
from pyspark.sql import SparkSession

from workload.oracle import statements
from workload.queries import QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

# Spark type name -> type name of the other engine.
TYPES = {
    "string": "VARCHAR",
    "int": "INTEGER",
    "bigint": "BIGINT",
    "boolean": "BOOLEAN",
    "double": "DOUBLE",
    "timestamp_ntz": "TIMESTAMP",
}


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master("local[8]")
        .appName("check")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def compare(spark: SparkSession, con: duckdb.DuckDBPyConnection, sf_dir: str, name: str) -> str:
    """Empty when the query and its SQL agree in columns, types and rows."""
    df = QUERIES[name](spark, sf_dir)
    have_cols = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    sql = statements().get(name)
    cols = sorted(have_cols)
    have = Counter(tuple(r[c] for c in cols) for r in df.collect())
    if sql is None:
        return ""
    shape = con.execute(f"describe {sql}").fetchall()
    want_cols = {r[0]: r[1] for r in shape}
    if sorted(want_cols) != cols:
        return f"columns {cols} <> {sorted(want_cols)}"
    other = {c: (have_cols[c], want_cols[c]) for c in cols if TYPES.get(have_cols[c]) != want_cols[c]}
    picked = ", ".join(f'"{c}"' for c in cols)
    want = Counter(con.execute(f"select {picked} from ({sql}) t").fetchall())
    if have != want:
        return (
            f"{sum(have.values())} rows <> {sum(want.values())}; only here "
            f"{list((have - want).items())[:2]}; only there {list((want - have).items())[:2]}"
        )
    return f"types {other}" if other else ""


def main(args: list[str]) -> int:
    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    names = args[1:] or list(QUERIES)
    spark, con = session(), connect(sf_dir)
    bad = 0
    for name in names:
        start = time.time()
        try:
            problem = compare(spark, con, sf_dir, name)
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - start:.1f}s {problem}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
