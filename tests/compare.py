"""Run registered queries in Spark and DuckDB and compare the results value by value.

Command line: ``python tests/compare.py [sf_dir] [query ...]``.
"""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for file in sorted(os.listdir(sf_dir)):
        if file.endswith(".parquet"):
            db.execute(f"create view {file[:-8]} as select * from '{sf_dir}/{file}'")
    return db


def _value(v):
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else float(f"{v:.9f}") + 0.0
    return v


def _bag(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple((type(row[i]).__name__, _value(row[i])) for i in order) for row in rows)


def compare(spark, db, name: str, function, sql: str | None, sf_dir: str) -> str | None:
    """None when equal, else the reason. Without SQL only a non-empty result is asked for."""
    frame = function(spark, sf_dir)
    rows = [tuple(r) for r in frame.collect()]
    if sql is None:
        return None if rows else "no rows"
    cursor = db.execute(sql)
    columns = [d[0] for d in cursor.description]
    if sorted(columns) != sorted(frame.columns):
        return f"columns differ: {sorted(set(columns) ^ set(frame.columns))}"
    ours, theirs = _bag(frame.columns, rows), _bag(columns, cursor.fetchall())
    if ours == theirs:
        return None if rows else "no rows"
    return (f"{sum(ours.values())} vs {sum(theirs.values())} rows; only Spark {list((ours - theirs).items())[:2]}; "
            f"only SQL {list((theirs - ours).items())[:2]}")


def main() -> int:
    import __spark_entry__ as entry
    from headwise.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(entry.queries())
    spark = build_session("compare", "local[8]", 8, extra={"spark.ui.enabled": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    db, sqls, bad = connect(sf_dir), entry.oracle_sql(), 0
    for name in names:
        start = time.time()
        try:
            reason = compare(spark, db, name, entry.queries()[name], sqls.get(name), sf_dir)
        except Exception as error:  # report and go on with the next query
            reason = f"{type(error).__name__}: {str(error)[:600]}"
        bad += reason is not None
        print(f"{'ok ' if reason is None else 'BAD'} {name} {time.time() - start:.2f}s"
              f"{'' if name in sqls else ' (rows only)'}{'' if reason is None else ' ' + reason}", flush=True)
    print(f"{len(names)} queries, {bad} bad; SQL without query: {sorted(set(sqls) - set(entry.queries()))}")
    return bad


if __name__ == "__main__":
    sys.exit(main())
