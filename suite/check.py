"""Compare registered queries with their oracles on one data folder.

    python -m suite.check FOLDER [NAME ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import tempfile
import time
from decimal import Decimal


def connect(folder: str):
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return value + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def canonical(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return sorted(plain, key=lambda row: tuple((v is None, str(type(v)), str(v)) for v in row))


def compare(spark, con, folder: str, query) -> str:
    """Empty when equal, otherwise the first difference."""
    df = query.run(spark, folder)
    got = canonical(df.columns, [tuple(row) for row in df.collect()])
    if query.sql is None:
        return "" if got else "no rows"
    result = con.execute(query.sql)
    names = [d[0] for d in result.description]
    want = canonical(names, result.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} expected {sorted(names)}"
    if len(got) != len(want):
        return f"{len(got)} rows, expected {len(want)}; first {got[:1]} / {want[:1]}"
    for a, b in zip(got, want):
        if [(type(x), x) for x in a] != [(type(x), x) for x in b]:
            return f"{sorted(names)}: {a} expected {b}"
    return "" if got else "equal but no rows"


def main() -> int:
    from pyspark.sql import SparkSession

    from cultiva.session import configure
    from suite import REGISTRY

    folder, names = sys.argv[1], sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark, tempfile.mkdtemp(prefix="suite-"))
    con = connect(folder)
    bad = 0
    for name, item in REGISTRY.items():
        if names and not any(name == n or (n.endswith("*") and name.startswith(n[:-1])) for n in names):
            continue
        start = time.time()
        try:
            problem = compare(spark, con, folder, item)
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:1200]}"
        kind = "sql " if item.sql else "rows"
        print(f"{'FAIL' if problem else 'ok  '} {kind} {time.time() - start:6.2f}s {name} {problem}", flush=True)
        bad += bool(problem)
    print(f"{bad} problems")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
