"""Runs registered queries and their SQL over the same tables: python tests/compare.py FOLDER [PREFIX...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path


def cell(x: object) -> object:
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}")
    return str(x) if x is not None and not isinstance(x, (int, str, bool)) else x


def rows_of(columns: list[str], rows: list) -> list:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


def connect(folder: str):
    import duckdb

    con = duckdb.connect()
    for p in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}/*.parquet')" if p.is_dir() else f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def compare(spark, folder: str, names: list[str], queries: dict, sql: dict) -> list[str]:
    con, bad = connect(folder), []
    for name in names:
        began = time.time()
        try:
            df = queries[name](spark, folder)
            mine = rows_of(df.columns, df.collect())
        except Exception as e:  # noqa: BLE001
            bad.append(name)
            print(f"{name}: FAILED {str(e)[:1500]}", flush=True)
            continue
        took = time.time() - began
        if name not in sql:
            print(f"{name}: {len(mine)} rows, no SQL, {took:.1f} s", flush=True)
            continue
        began = time.time()
        try:
            got = con.execute(sql[name])
            columns = [c[0] for c in got.description]
            theirs = rows_of(columns, got.fetchall())
        except Exception as e:  # noqa: BLE001
            bad.append(name)
            print(f"{name}: SQL FAILED {str(e)[:1500]}", flush=True)
            continue
        same = mine == theirs and sorted(df.columns) == sorted(columns)
        print(f"{name}: {'same' if same else 'DIFFERS'}, {len(mine)} rows, {took:.1f} s, SQL {len(theirs)} rows, {time.time() - began:.1f} s", flush=True)
        if not same:
            bad.append(name)
            print("  columns", sorted(df.columns), sorted(columns))
            a, b = set(map(repr, mine)), set(map(repr, theirs))
            print("  only here:", sorted(a - b)[:5], "\n  only SQL:", sorted(b - a)[:5])
    return bad


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    import __spark_entry__ as entry

    from corvane.session import local_session

    q = entry.queries()
    wanted = [n for n in q if not sys.argv[2:] or any(n.startswith(p) for p in sys.argv[2:])]
    spark = local_session(cpus="8")
    spark.sparkContext.setLogLevel("ERROR")
    failed = compare(spark, sys.argv[1], wanted, q, entry.oracle_sql())
    print("bad:", failed)
