"""Compare registered queries with their checking SQL on one data folder.

``python tests/check.py [sf_dir] [key-prefix ...]``
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

STAR = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for name in STAR:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def cell(value):
    """Strict text form of a value: its type counts, -0.0 and 0.0 do not differ."""
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return f"{type(value).__name__}:{value}"


def rows_of(columns, rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


# Plan nodes that compare every row with every row, or leave the JVM.
UNWANTED = ("BroadcastNestedLoopJoin", "CartesianProduct", "EvalPython", "MapInPandas", "FlatMapGroups")


def compare(spark, con, sf_dir, build, sql) -> tuple[bool, str]:
    df = build(spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    found = [node for node in UNWANTED if node in plan]
    if found:
        return False, f"plan holds {found}"
    mine = df.collect()
    if sql is None:
        return True, f"rows {len(mine)} (no SQL)"
    theirs = con.sql(sql)
    if sorted(df.columns) != sorted(theirs.columns):
        return False, f"columns {sorted(set(df.columns) ^ set(theirs.columns))}"
    odd = [f"{n} {k}" for n, k in zip(theirs.columns, theirs.types) if str(k).startswith(("HUGEINT", "DECIMAL", "DATE", "TIME "))]
    if odd:
        return False, f"types that other readers may change: {odd}"
    a, b = rows_of(df.columns, mine), rows_of(theirs.columns, theirs.fetchall())
    if a == b:
        return True, f"rows {len(a)}"
    left, right = set(a) - set(b), set(b) - set(a)
    detail = f"rows {len(a)} vs {len(b)}, only-spark {len(left)}, only-sql {len(right)}"
    if left and right:
        x, y = min(left), min(right, key=lambda r: sum(p != q for p, q in zip(r, min(left))))
        names = sorted(df.columns)
        detail += " | " + "; ".join(f"{n}: {p} <> {q}" for n, p, q in zip(names, x, y) if p != q)
    elif left or right:
        detail += f" | {min(left or right)}"
    return False, detail


if __name__ == "__main__":
    sys.path.insert(0, __file__.rsplit("/", 2)[0])
    from bizlake.catalog import load
    from bizlake.session import build_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = tuple(sys.argv[2:]) or ("",)
    session = build_session(master="local[8]", **{"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": "8"})
    session.sparkContext.setLogLevel("ERROR")
    link = connect(folder)
    queries, oracles = load()
    bad = 0
    for key, make in queries.items():
        if not key.startswith(prefixes):
            continue
        started = time.time()
        try:
            good, text = compare(session, link, folder, make, oracles.get(key))
        except Exception as error:  # noqa: BLE001
            good, text = False, f"{type(error).__name__}: {str(error)[:600]}"
        bad += not good
        print(f"{'ok ' if good else 'BAD'} {key} {time.time() - started:.2f}s {text}", flush=True)
    print("bad:", bad)
