"""Compare catalogue plans with their SQL on the same tables.

Usage: python -m tests.oracle [folder] [name prefix ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def plain(value):
    """Comparable form: numbers as rounded floats, -0 as 0."""
    if value is None:
        return (0, "")
    if isinstance(value, bool):
        return (1, str(value))
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        number = float(value)
        return (2, "nan" if math.isnan(number) else repr(float(f"{number:.9g}") + 0.0))
    return (3, str(value))


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, connection, name, folder):
    """(matches, message, rows, seconds) of one catalogue entry."""
    from posequarry.plans import catalog

    started = time.time()
    df = catalog.PLANS[name](spark, folder)
    plan = df._jdf.queryExecution().executedPlan().toString()
    if "CartesianProduct" in plan or "NestedLoopJoin" in plan:
        return False, "pairs every row with every row", 0, 0.0
    got_columns, got = canonical(df.columns, df.collect())
    seconds = time.time() - started
    if name not in catalog.SQL:
        return bool(got), "rows only", len(got), seconds
    result = connection.execute(catalog.SQL[name])
    want_columns, want = canonical([d[0] for d in result.description], result.fetchall())
    if got_columns != want_columns:
        return False, f"columns {got_columns} != {want_columns}", len(got), seconds
    if got != want:
        odd = next(((a, b) for a, b in zip(got, want) if a != b), None)
        return False, f"{len(got)} rows vs {len(want)}; first difference {odd}", len(got), seconds
    return True, "equal", len(got), seconds


def main(argv):
    from posequarry.plans import catalog
    from posequarry.session import build_session

    folder = argv[0] if argv else "/root/testdata/sf0.01"
    prefixes = argv[1:]
    spark = build_session("oracle", "local[8]", spark__sql__shuffle__partitions="8",
                          spark__driver__memory="8g", spark__ui__enabled="false",
                          spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    catalog.load_all()
    connection = connect(folder)
    failed = 0
    for name in catalog.PLANS:
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        try:
            ok, message, rows, seconds = compare(spark, connection, name, folder)
        except Exception as error:  # noqa: BLE001 - report and go on
            ok, message, rows, seconds = False, f"{type(error).__name__}: {str(error)[:900]}", 0, 0.0
        failed += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:34s} {rows:7d} rows {seconds:6.2f}s  {message if not ok or message != 'equal' else ''}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
