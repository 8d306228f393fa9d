"""Runs registered queries in Spark and their check SQL in DuckDB and compares the rows."""
from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name: str, run, sql: str | None, sf: str) -> tuple[bool, str]:
    started = time.time()
    df = run(spark, sf)
    got = rows_of(df.columns, df.collect())
    took = time.time() - started
    if sql is None:
        return bool(got), f"{len(got)} rows, no SQL, {took:.1f}s"
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    want = rows_of(columns, cur.fetchall())
    if sorted(columns) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(columns)}"
    if got != want:
        extra = [r for r in got if r not in set(want)][:2]
        lost = [r for r in want if r not in set(got)][:2]
        return False, f"{len(got)} rows, want {len(want)}\n   extra {str(extra)[:600]}\n   lost  {str(lost)[:600]}"
    return True, f"{len(got)} rows, {took:.1f}s"


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries
    from promptloom.session import local_session
    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    extra = dict(kv.split("=") for kv in os.environ.get("SPARK_SET", "").split(",") if kv)
    spark = local_session(8, **{k.replace(".", "__"): v for k, v in extra.items()})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    wanted = sys.argv[1:]
    bad = []
    for name, run in queries().items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        try:
            ok, note = compare(spark, con, name, run, oracle_sql().get(name), sf)
        except Exception as failure:  # noqa: BLE001 - report and go on with the next query
            ok, note = False, f"{type(failure).__name__}: {str(failure)[:700]}"
        if not ok:
            bad.append(name)
        print("ok  " if ok else "BAD ", name, note, flush=True)
    print("failed:", bad)
