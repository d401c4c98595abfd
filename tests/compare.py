"""Run registered queries against their SQL and compare rows; also a command line."""

from __future__ import annotations

import math
import sys
import time

import duckdb

from poolweave.plans import registry

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


def canon(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{round(v, 5) + 0.0:.5f}"
    if isinstance(v, int):
        return f"{float(v):.5f}"
    if hasattr(v, "as_tuple"):
        return f"{float(v):.5f}"
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(canon(r[i]) for i in order) for r in rows)


# Spark type names and the SQL types they should meet.
SAME = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def type_differences(con, q, df) -> list[str]:
    theirs = {r[0]: r[1] for r in con.execute("describe " + registry.oracle(q)).fetchall()}
    return [f"{c} {t}/{theirs.get(c)}" for c, t in df.dtypes if SAME.get(t) != theirs.get(c)]


def check(spark, con, q, folder, types: bool = False) -> str:
    """Empty string when equal, else a description of the difference."""
    df = registry.runner(q)(spark, folder)
    left = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if q.sql is None:
        return "" if left[1] else "no rows"
    if types and type_differences(con, q, df):
        print("types", q.name, type_differences(con, q, df), flush=True)
    cur = con.execute(registry.oracle(q))
    right = rows_of([d[0] for d in cur.description], cur.fetchall())
    if left[0] != right[0]:
        return f"columns {left[0]} vs {right[0]}"
    if len(left[1]) != len(right[1]):
        return f"rows {len(left[1])} vs {len(right[1])}; spark {left[1][:2]} sql {right[1][:2]}"
    if not left[1]:
        return ""
    bad = [(a, b) for a, b in zip(*(x[1] for x in (left, right))) if a != b]
    return f"{len(bad)} rows differ of {len(left[1])}: {[tuple(str(y)[:60] for y in z) for z in bad[0]]}" if bad else ""


if __name__ == "__main__":
    from poolweave.session import local_session

    folder = sys.argv[1]
    wanted = sys.argv[2:]
    spark = local_session(8)
    con = connect(folder)
    queries = registry.load()
    bad = 0
    for name, q in queries.items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            result = check(spark, con, q, folder, types=True)
        except Exception as e:  # noqa: BLE001
            result = f"{type(e).__name__}: {str(e)[:600]}"
        spent = time.time() - start
        if result:
            bad += 1
        if result or spent > 6:
            print(f"{'FAIL' if result else 'ok'} {name} {spent:.1f}s {result}", flush=True)
    print("failures", bad)
