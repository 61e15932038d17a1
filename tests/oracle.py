"""Runs a query and its SQL on the same tables and compares rows, names and types.

``python tests/oracle.py [sf_dir] [query ...]`` prints one line per query.
"""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

# Spark type -> DuckDB type
TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
    "date": "DATE", "timestamp_ntz": "TIMESTAMP",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _key(value):
    if isinstance(value, float) and math.isnan(value):
        return "NaN"
    return value


def compare(df, con, sql: str) -> str:
    """'' if equal, else what differs."""
    ours = sorted(df.columns)
    spark_rows = Counter(tuple(_key(r[c]) for c in ours) for r in df.collect())
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(names) != ours:
        return f"columns {ours} vs {sorted(names)}"
    types = dict(zip(names, (str(d[1]) for d in result.description)))
    expected = {n: TYPES.get(t, t) for n, t in df.dtypes}
    wrong = {n: (expected[n], types[n]) for n in names if expected[n] != types[n]}
    place = [names.index(c) for c in ours]
    duck_rows = Counter(tuple(_key(r[i]) for i in place) for r in result.fetchall())
    if wrong:
        return f"types {wrong}"
    if spark_rows != duck_rows:
        extra, lost = spark_rows - duck_rows, duck_rows - spark_rows
        return (
            f"rows {sum(spark_rows.values())} vs {sum(duck_rows.values())}; "
            f"only here {list(extra.items())[:2]}; only there {list(lost.items())[:2]}"
        )
    return "" if spark_rows else "both are empty"


def main() -> int:
    from panelspark.session import panel_session
    from __spark_entry__ import oracle_sql, queries

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = panel_session(
        "oracle", f"local[{cpus}]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, runs, sql = connect(sf_dir), queries(), oracle_sql()
    bad = 0
    for name in sys.argv[2:] or runs:
        start = time.time()
        try:
            problem = compare(runs[name](spark, sf_dir), con, sql[name])
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += bool(problem)
        print(f"{'ok ' if not problem else 'BAD'} {name} {time.time() - start:.1f}s {problem}", flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(main() > 0)
