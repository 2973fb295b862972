"""Run registered queries next to their oracle SQL and compare row by row.

    python tests/oracle.py [--sf DIR] [name prefix ...]
"""

from __future__ import annotations

import argparse
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as entry  # noqa: E402
from tests.session import spark_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _norm(value: object) -> object:
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return round(value, 9)
    if isinstance(value, (int, str)):
        return value
    return str(value)


def rows_of(columns: list[str], rows: list) -> list:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name: str, sf_dir: str) -> tuple[bool, str]:
    df = entry.queries()[name](spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return bool(got), f"{len(got)} rows, no oracle"
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    want = rows_of(columns, result.fetchall())
    if sorted(columns) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} / {sorted(columns)}"
    if got != want:
        only_got = [r for r in got if r not in set(want)][:2] if len(got) < 20000 else []
        only_want = [r for r in want if r not in set(got)][:2] if len(want) < 20000 else []
        return False, f"{len(got)} / {len(want)} rows; spark only {only_got}; oracle only {only_want}"
    return True, f"{len(got)} rows"


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark, con = spark_session(), connect(args.sf)
    failed = []
    for name in entry.queries():
        if args.names and not any(name.startswith(p) for p in args.names):
            continue
        begin = time.time()
        try:
            ok, note = compare(spark, con, name, args.sf)
        except Exception as error:  # report and go on
            ok, note = False, f"{type(error).__name__}: {str(error)[:400]}"
        print("ok  " if ok else "FAIL", name, f"{time.time() - begin:.1f}s", note[:700], flush=True)
        if not ok:
            failed.append(name)
    print(f"{len(failed)} failed", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
