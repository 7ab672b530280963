"""Run queries against their SQL counterparts: ``python -m checks.compare [sf_dir] [name ...]``."""

from __future__ import annotations

import math
import sys
import time
import traceback
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def session(cpus: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("prismcat")
        .config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else repr(value)
    return str(value)


def _rows(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_plain(r[i]) for i in order) for r in rows)


_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def differences(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None when both give the same columns, types and rows, else what differs."""
    got_cols, got = _rows(df.columns, df.collect())
    rel = con.execute(sql)
    names, types = [d[0] for d in rel.description], [str(d[1]) for d in rel.description]
    want_cols, want = _rows(names, rel.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} / {want_cols}"
    sql_types = dict(zip(names, types))
    for f in df.schema.fields:
        if _TYPES.get(f.dataType.simpleString(), "?") != sql_types[f.name]:
            return f"type of {f.name}: {f.dataType.simpleString()} / {sql_types[f.name]}"
    if len(got) != len(want):
        return f"rows {len(got)} / {len(want)}"
    for a, b in zip(got, want):
        if a != b:
            return f"{a} / {b}"
    return None


def main(argv: list[str]) -> int:
    from checks import ORACLES, QUERIES

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark, con, bad = session(), duck(sf_dir), 0
    for name, fn in QUERIES.items():
        if argv[1:] and not any(name.startswith(p) for p in argv[1:]):
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in ORACLES:
                problem = differences(df, con, ORACLES[name])
                label = "ok" if problem is None else "DIFF"
            else:
                problem, label = None, f"rows {df.count()}"
        except Exception as exc:  # report and go on with the next query
            problem, label = str(exc).split("JVM stacktrace")[0][:1500], "ERROR"
            if "-v" in sys.argv:
                traceback.print_exc()
        bad += problem is not None
        print(f"{name:36s} {label:10s} {time.time() - start:6.2f}s {problem or ''}", flush=True)
    print(f"{bad} problems at {Path(sf_dir).name}")
    return bad


if __name__ == "__main__":
    sys.exit(min(main([a for a in sys.argv[1:] if a != "-v"]), 100))
