"""Run registered queries in Spark and their check SQL in DuckDB and compare.

``python tests/compare.py [sf] [name ...]``
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()
DATA = Path("/root/testdata")


def connect(sf: str):
    import duckdb

    connection = duckdb.connect()
    connection.execute("SET TimeZone='UTC'")
    for name in TABLES:
        path = DATA / f"sf{sf}" / f"{name}.parquet"
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def plain(value):
    if value is None:
        return None
    if hasattr(value, "tzinfo"):
        return value.replace(tzinfo=None)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, bool) or isinstance(value, str):
        return value
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    return value if isinstance(value, int) else float(value)


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(row[i]) for i in order) for row in rows), key=repr)


def difference(spark_names, spark_rows, sql_names, sql_rows) -> str | None:
    """None when equal; doubles must agree exactly."""
    if sorted(spark_names) != sorted(sql_names):
        return f"columns {sorted(spark_names)} != {sorted(sql_names)}"
    left, right = rows_of(spark_names, spark_rows), rows_of(sql_names, sql_rows)
    if len(left) != len(right):
        return f"{len(left)} rows != {len(right)} rows"
    for a, b in zip(left, right):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return f"{sum(x != y for x, y in zip(left, right))} rows differ: {a!r:.300} != {b!r:.300}"
    return None


def check(spark, connection, name: str, sf: str) -> tuple[str | None, int, float, float]:
    from searchlab.plans.catalog import CHECK_SQL, QUERIES

    start = time.perf_counter()
    result = QUERIES[name](spark, str(DATA / f"sf{sf}"))
    rows = [tuple(r) for r in result.collect()]
    spark_time = time.perf_counter() - start
    if name not in CHECK_SQL:
        return None, len(rows), spark_time, 0.0
    start = time.perf_counter()
    cursor = connection.execute(CHECK_SQL[name])
    names = [d[0] for d in cursor.description]
    sql_rows = cursor.fetchall()
    return (
        difference(result.columns, rows, names, sql_rows),
        len(rows), spark_time, time.perf_counter() - start,
    )


def main() -> None:
    from searchlab.plans.catalog import QUERIES
    from tests.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    spark, connection, failed = local_session(), connect(sf), []
    for name in sys.argv[2:] or list(QUERIES):
        try:
            problem, rows, spark_time, sql_time = check(spark, connection, name, sf)
        except Exception as error:  # noqa: BLE001 - report and go on
            problem, rows, spark_time, sql_time = f"{type(error).__name__}: {str(error)[:900]}", 0, 0, 0
        print(f"{name:32} {rows:8} rows {spark_time:7.2f}s sql {sql_time:6.2f}s {problem or 'ok'}", flush=True)
        if problem:
            failed.append(name)
    print("failed:", failed)


if __name__ == "__main__":
    main()
