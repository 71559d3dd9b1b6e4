"""Run registered queries against their SQL twins: python -m tests.check_oracle [sf] [names...]

With NO_SQL=1 only the Spark side runs.
"""

from __future__ import annotations

import os
import sys
import time
from pathlib import Path

import duckdb

import __spark_entry__ as entry
from trendloom.session import local_session

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        if Path(path).exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def rows_of_spark(df):
    names = sorted(df.columns)
    return names, sorted(repr(tuple(r[n] for n in names)) for r in df.collect())


def rows_of_duck(con, sql):
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    names = sorted(cols)
    order = [cols.index(n) for n in names]
    return names, sorted(repr(tuple(r[i] for i in order)) for r in cur.fetchall())


def compare(spark, con, folder, name, fn, sql):
    start = time.time()
    names, got = rows_of_spark(fn(spark, folder))
    spent = time.time() - start
    if sql is None:
        return False, f"{name}: {len(got)} rows, no twin, {spent:.1f}s"
    start = time.time()
    want_names, want = rows_of_duck(con, sql)
    sql_time = time.time() - start
    if names != want_names:
        return False, f"{name}: columns {names} != {want_names}"
    if got != want:
        extra = [r for r in got if r not in set(want)][:2]
        lacking = [r for r in want if r not in set(got)][:2]
        return False, f"{name}: {len(got)} rows vs {len(want)}\n   only spark: {str(extra)[:700]}\n   only sql:   {str(lacking)[:700]}"
    return True, f"{name}: {len(got)} rows equal, spark {spent:.1f}s, sql {sql_time:.1f}s"


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    folder = f"/root/testdata/sf{sf}"
    wanted = sys.argv[2:]
    spark, con = local_session(8), duck(folder)
    queries = entry.queries()
    oracles = {} if os.environ.get("NO_SQL") else entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if wanted and name not in wanted:
            continue
        try:
            ok, line = compare(spark, con, folder, name, fn, oracles.get(name))
        except Exception as e:
            ok, line = False, f"{name}: {type(e).__name__} {str(e)[:900]}"
        bad += not ok
        print("ok  " if ok else "BAD ", line, flush=True)
    print("bad:", bad, "of", len(wanted or queries), "without twin:", sorted(set(queries) - set(oracles)))


if __name__ == "__main__":
    main()
