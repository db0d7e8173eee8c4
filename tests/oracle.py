"""Comparison of a query with its SQL oracle on the same parquet files."""

from __future__ import annotations

import datetime as dt
import math
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat(" ")
    if isinstance(value, float) and math.isnan(value):
        return "NaN"
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, sf_dir, query, sql) -> str | None:
    """None when equal, otherwise a short description of the difference."""
    df = query(spark, sf_dir)
    mine_names, mine = rows_of(df.columns, df.collect())
    rel = con.execute(sql)
    sql_names, theirs = rows_of([d[0] for d in rel.description], rel.fetchall())
    if mine_names != sql_names:
        return f"columns {mine_names} != {sql_names}"
    if len(mine) != len(theirs):
        return f"rows {len(mine)} != {len(theirs)}; first {mine[:1]} {theirs[:1]}"
    bad = [(a, b) for a, b in zip(mine, theirs) if a != b]
    if bad:
        return f"{len(bad)} of {len(mine)} rows differ, e.g.\n   {bad[0][0]}\n   {bad[0][1]}"
    kinds = {type(v) for r in mine[:1] for v in r} - {int, float, str, bool, dt.date, type(None)}
    if kinds:
        return f"unexpected types {kinds}"
    return None


def main(argv):
    import time

    import __spark_entry__ as entry
    from riskloom.session import build_session

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = build_session("local[8]", **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8",
                                         "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = argv or list(queries)
    failed = []
    for name in names:
        start = time.time()
        try:
            if name in oracles:
                problem = compare(spark, con, sf_dir, queries[name], oracles[name])
                note = "ok" if problem is None else problem
            else:
                problem, note = None, f"rows only: {queries[name](spark, sf_dir).count()}"
        except Exception as error:  # noqa: BLE001
            problem = note = f"{type(error).__name__}: {str(error)[:600]}"
        if problem:
            failed.append(name)
        print(f"{name:32s} {time.time() - start:6.2f}s {note}", flush=True)
    print("FAILED:", failed)


if __name__ == "__main__":
    main(sys.argv[1:])
