"""Runs a query on Spark and its SQL on DuckDB and compares the rows.

As a script: python -m tests.oracle [sf_dir] [name-prefix ...]
"""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return int(value) if value == int(value) and abs(value) < 1e15 else round(value, 9)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(
        (tuple(_plain(r[i]) for i in order) for r in rows),
        key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r),
    )


def differences(df, con, sql: str) -> str | None:
    got = df.collect()
    found = con.execute(sql)
    columns = [d[0] for d in found.description]
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(columns)}"
    mine, theirs = rows_of(df.columns, got), rows_of(columns, found.fetchall())
    if len(mine) != len(theirs):
        return f"{len(mine)} rows against {len(theirs)}"
    for a, b in zip(mine, theirs):
        if a != b:
            return f"{sorted(columns)}\n  {str(a)[:600]}\n  {str(b)[:600]}"
    return None


def main() -> int:
    sys.path.insert(0, ".")
    from tests.conftest import build_session
    import __spark_entry__ as entry

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark, con = build_session(), connect(sf_dir)
    sql, bad = entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in sql:
                diff = differences(df, con, sql[name])
            else:
                diff = None if df.count() else "no rows"
        except Exception as e:
            diff = f"{type(e).__name__}: {str(e)[:900]}"
        bad += diff is not None
        kind = "sql " if name in sql else "rows"
        print(f"{'ok  ' if diff is None else 'FAIL'} {kind} {name} {time.time() - start:.2f}s {diff or ''}", flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(bool(main()))
