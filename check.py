"""Run registered queries beside their DuckDB oracle and compare the rows.

usage: python check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime as dt
import sys
import time
from collections import Counter
from decimal import Decimal

import duckdb

from tallybook.catalog import REGISTRY
from tallybook.fixtures import BASE_TABLES
from tallybook.session import local_session


def canonical(value):
    if isinstance(value, float):
        return repr(value)
    if isinstance(value, Decimal):
        return format(value, "f")
    if isinstance(value, (dt.datetime, dt.date)):
        return value.isoformat()
    return value if value is None or isinstance(value, bool) else str(value)


def rows_of(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(canonical(r[i]) for i in order) for r in rows)


def oracle_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in BASE_TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def compare(spark, con, sf_dir: str, name: str) -> tuple[bool, str]:
    q = REGISTRY[name]
    started = time.time()
    df = q(spark, sf_dir)
    got = df.collect()
    took = time.time() - started
    if q.oracle is None:
        return True, f"rows-only {len(got)} rows {took:.1f}s"
    result = con.execute(q.oracle_sql)
    columns = [d[0] for d in result.description]
    want = result.fetchall()
    if sorted(columns) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} vs {sorted(columns)}"
    a, b = rows_of(df.columns, got), rows_of(columns, want)
    if a != b:
        extra, missing = list((a - b).items())[:2], list((b - a).items())[:2]
        return False, f"{len(got)} vs {len(want)} rows\n  spark only {extra}\n  duckdb only {missing}\n  ({sorted(columns)})"
    return True, f"{len(got)} rows {took:.1f}s"


def main(argv: list[str]) -> int:
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or list(REGISTRY)
    spark, con = local_session(8), oracle_connection(sf_dir)
    bad = 0
    for name in names:
        try:
            ok, note = compare(spark, con, sf_dir, name)
        except Exception as error:  # report and go on with the next query
            ok, note = False, f"{type(error).__name__}: {str(error)[:1500]}"
        bad += not ok
        print(("ok   " if ok else "FAIL ") + name + ": " + note, flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
