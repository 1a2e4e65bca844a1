"""Run named queries next to their SQL counterpart: python -m tests.check_queries <sf_dir> [name ...]."""

from __future__ import annotations

import math
import sys
import time

import duckdb

import __spark_entry__ as entry
from guichet.session import build_session

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return str(value)
    if hasattr(value, "isoformat"):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return str([normal(v) for v in value])
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        return f"{float(value):.6f}"
    return str(value)


def compare(spark, sf: str, name: str) -> str:
    started = time.time()
    frame = entry.queries()[name](spark, sf)
    columns = sorted(frame.columns)
    got = sorted([tuple(normal(r[c]) for c in columns) for r in frame.collect()], key=str)
    took = time.time() - started
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return f"rows-only {len(got)} rows, {took:.1f}s"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(names) != columns:
        return f"COLUMNS {columns} vs {sorted(names)}"
    order = [names.index(c) for c in columns]
    want = sorted([tuple(normal(r[i]) for i in order) for r in result.fetchall()], key=str)
    if got == want:
        return f"ok {len(got)} rows, {took:.1f}s"
    only_got = sorted(set(got) - set(want), key=str)[:2]
    only_want = sorted(set(want) - set(got), key=str)[:2]
    return f"DIFF {len(got)} vs {len(want)} rows\n   spark {only_got}\n   sql   {only_want}"


if __name__ == "__main__":
    session = build_session("check", master="local[8]", shuffle_partitions=8)
    session.sparkContext.setLogLevel("ERROR")
    folder = sys.argv[1]
    chosen = [k for k in entry.queries() if not sys.argv[2:] or any(k == a or (a.endswith(".") and entry.queries()[k].__module__.endswith(a[:-1])) for a in sys.argv[2:])]
    for key in chosen:
        try:
            print(key, compare(session, folder, key), flush=True)
        except Exception as error:  # report and go on
            print(key, "ERROR", str(error)[:1500].replace("\n", " | "), flush=True)
