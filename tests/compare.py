"""Runs registered queries in Spark and DuckDB and compares names, types and values.

    python -m tests.compare SF_DIR [QUERY ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

# DuckDB type -> Spark type
TYPES = {
    "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string",
    "BOOLEAN": "boolean", "TIMESTAMP": "timestamp", "DATE": "date",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        if Path(f"{sf_dir}/{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _canonical(value):
    if value is None:
        return ""
    if isinstance(value, float):
        return repr(value + 0.0)
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return repr(value)


def _rows(rows, names) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_canonical(row[i]) for i in order) for row in rows)


def difference(frame: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """What differs, or None."""
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    types = {d[0]: TYPES.get(str(d[1]), str(d[1])) for d in cursor.description}
    if types != dict(frame.dtypes):
        return f"schema: spark {sorted(frame.dtypes)} duckdb {sorted(types.items())}"
    expected = _rows(cursor.fetchall(), names)
    found = _rows(frame.collect(), frame.columns)
    if len(found) != len(expected):
        return f"rows: spark {len(found)} duckdb {len(expected)}"
    wrong = [(f, e) for f, e in zip(found, expected) if f != e]
    return f"{len(wrong)} rows differ, first {wrong[0]}" if wrong else None


def session(cores: str = "8") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main(sf_dir: str, wanted: list[str]) -> int:
    from __spark_entry__ import oracle_sql, queries

    spark, con, failed = session(), connect(sf_dir), 0
    oracle = oracle_sql()
    for name, run in queries().items():
        if wanted and name not in wanted:
            continue
        began = time.time()
        try:
            frame = run(spark, sf_dir)
            if name in oracle:
                problem = difference(frame, con, oracle[name])
            else:
                problem = None if frame.count() else "no rows"
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failed += problem is not None
        kind = "sql" if name in oracle else "rows"
        print(f"{name:28s} {kind:5s} {time.time() - began:6.1f}s  {problem or 'ok'}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]) > 0)
