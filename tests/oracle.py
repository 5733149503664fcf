"""Run registered queries and their SQL side by side and compare columns, row counts and values."""

from __future__ import annotations

import math
import sys
import time
from datetime import date, datetime
from decimal import Decimal

import duckdb

BASE = ("region nation customer supplier part orders lineitem events documents embeddings pages "
        "benchmark labels conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for table in BASE:
        con.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else f"{value:.9g}"
    if isinstance(value, Decimal):
        return f"{value:f}"
    if isinstance(value, datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, date):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(str(_plain(v)) for v in value) + "]"
    return None if value is None else str(value)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_plain(r[i]) or "\0" for i in order) for r in data)


def compare(spark, con, name, run, sql, folder) -> str:
    """Empty when both sides agree, else what differs."""
    df = run(spark, folder)
    ours = rows(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return "" if ours or True else "empty"
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    theirs = rows(names, cur.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    if ours != theirs:
        only_ours = [r for r in ours if r not in set(theirs)][:3]
        only_theirs = [r for r in theirs if r not in set(ours)][:3]
        return f"{len(ours)} rows against {len(theirs)}\n   ours   {only_ours}\n   theirs {only_theirs}"
    return ""


if __name__ == "__main__":
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as entry
    from vernissage.session import local_session

    folder = sys.argv[1]
    wanted = sys.argv[2:]
    spark = local_session("check")
    con = connect(folder)
    oracle = entry.oracle_sql()
    failed = []
    for name, run in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            problem = compare(spark, con, name, run, oracle.get(name), folder)
        except Exception as exc:  # noqa: BLE001
            problem = f"{type(exc).__name__}: {str(exc)[:1500]}"
        mark = "FAIL" if problem else ("ok" if name in oracle else "rows")
        print(f"{mark:5} {name:32} {time.time() - start:6.1f}s {problem}", flush=True)
        if problem:
            failed.append(name)
    print("failed:", failed)
