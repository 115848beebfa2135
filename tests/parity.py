"""Run registered queries and their oracle SQL on the same tables and compare the rows."""

from __future__ import annotations

import decimal
import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9) + 0.0)
    if isinstance(value, decimal.Decimal):
        return str(value.normalize())
    return repr(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def spark_rows(df):
    return rows_of(df.columns, [tuple(row) for row in df.collect()])


def oracle_rows(con, sql):
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    return rows_of(names, result.fetchall())


def difference(spark_side, oracle_side) -> str | None:
    """None when equal, else the first thing that differs."""
    (names_a, a), (names_b, b) = spark_side, oracle_side
    if names_a != names_b:
        return f"columns {names_a} != {names_b}"
    if len(a) != len(b):
        return f"{len(a)} rows != {len(b)}; only here {[r for r in a if r not in b][:2]}, only there {[r for r in b if r not in a][:2]}"
    for left, right in zip(a, b):
        if left != right:
            return f"{left} != {right} (columns {names_a})"
    return None


def main(sf_dir: str, only: list[str]) -> int:
    import __spark_entry__ as entry
    from conftest import build_session

    spark = build_session()
    con = connect(sf_dir)
    oracles = entry.oracle_sql()
    failed = 0
    for name, query in entry.queries().items():
        if only and name not in only:
            continue
        start = time.time()
        try:
            got = spark_rows(query(spark, sf_dir))
            note = "rows only" if name not in oracles else difference(got, oracle_rows(con, oracles[name]))
        except Exception as error:  # report and go on with the other queries
            note = f"{type(error).__name__}: {str(error)[:600]}"
            got = ([], [])
        ok = note is None or note == "rows only"
        failed += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:24s} {len(got[1]):7d} rows {time.time() - start:6.1f}s {note or ''}", flush=True)
    return failed


if __name__ == "__main__":
    sys.path.insert(0, str(ROOT / "tests"))
    sys.exit(main(sys.argv[1], sys.argv[2:]) > 0)
