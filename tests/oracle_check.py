"""Run registered queries and their SQL side by side: ``python tests/oracle_check.py [sf_dir] [name ...]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return connection


def _plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return 0.0 if value == 0 else value
    if isinstance(value, int) or value is None or isinstance(value, (bool, str)):
        return value
    return str(value)


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return sorted(names), sorted(plain, key=repr)


def compare(spark_df, connection, sql: str) -> str:
    """Empty text if equal, else what differs."""
    left_names, left = _rows(spark_df.columns, spark_df.collect())
    cursor = connection.execute(sql)
    right_names, right = _rows([d[0] for d in cursor.description], cursor.fetchall())
    if left_names != right_names:
        return f"columns {left_names} != {right_names}"
    if len(left) != len(right):
        return f"rows {len(left)} != {len(right)}"
    types = [(n, type(a).__name__, type(b).__name__) for n, a, b in zip(left_names, left[0], right[0])] if left else []
    differing = [(a, b) for a, b in zip(left, right) if repr(a) != repr(b)]
    if differing:
        return f"{len(differing)} rows differ, e.g. {differing[0]}; types {[t for t in types if t[1] != t[2]]}"
    return ""


def main() -> None:
    from __spark_entry__ import oracle_sql, queries
    from cohortflow.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = build_session("oracle-check", 8)
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(sf_dir)
    sql = oracle_sql()
    bad = 0
    for name, function in queries().items():
        if wanted and name not in wanted:
            continue
        started = time.time()
        try:
            df = function(spark, sf_dir)
            if name in sql:
                outcome = compare(df, connection, sql[name]) or "equal"
            else:
                outcome = f"rows only: {df.count()}"
        except Exception as error:  # report and go on with the next query
            outcome = f"ERROR {type(error).__name__}: {str(error)[:600]}"
        bad += outcome != "equal" and not outcome.startswith("rows only")
        print(f"{name:28s} {time.time() - started:6.2f}s {outcome[:1500]}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
