"""Run registered queries in Spark and their checking SQL in DuckDB, and compare schemas and rows."""

from __future__ import annotations

import datetime
import glob
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SIMPLE = {"VARCHAR": "string", "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "DATE": "date",
          "BOOLEAN": "boolean", "TIMESTAMP": "timestamp_ntz"}


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _cell(value):
    if isinstance(value, float):
        return f"{value:.9g}"
    if isinstance(value, datetime.datetime | datetime.date):
        return value.isoformat()
    return value


def spark_rows(df):
    columns = sorted(df.columns)
    rows = [tuple(map(_cell, r)) for r in df.select(*columns).collect()]
    return columns, dict((f.name, f.dataType.simpleString()) for f in df.schema), sorted(rows, key=repr)


def sql_rows(con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    types = {d[0]: SIMPLE.get(str(d[1]), str(d[1])) for d in cur.description}
    columns = sorted(names)
    order = [names.index(c) for c in columns]
    rows = [tuple(_cell(r[i]) for i in order) for r in cur.fetchall()]
    return columns, types, sorted(rows, key=repr)


def compare(spark, con, sf_dir, name, query, sql) -> tuple[bool, str]:
    start = time.time()
    got_columns, got_types, got = spark_rows(query(spark, sf_dir))
    spark_s = time.time() - start
    if sql is None:
        return False, f"{name}: {len(got)} rows, no checking SQL, {spark_s:.1f}s"
    start = time.time()
    want_columns, want_types, want = sql_rows(con, sql)
    sql_s = time.time() - start
    problems = []
    if got_columns != want_columns:
        problems.append(f"columns {got_columns} != {want_columns}")
    elif got_types != want_types:
        problems.append(f"types {[(c, got_types[c], want_types[c]) for c in got_columns if got_types[c] != want_types[c]]}")
    if got != want:
        extra, missing = set(got) - set(want), set(want) - set(got)
        problems.append(f"rows {len(got)} != {len(want)}; extra {list(extra)[:2]}, missing {list(missing)[:2]}")
    verdict = "; ".join(problems) or "ok"
    return not problems, f"{name}: {verdict}, {len(got)} rows, spark {spark_s:.1f}s, sql {sql_s:.1f}s"


if __name__ == "__main__":
    import __spark_entry__ as entry
    from parcelweave.plans import catalog
    from parcelweave.session import get_spark

    folder = sys.argv[1]
    only = sys.argv[2:]
    session = get_spark()
    connection = connect(folder)
    checks = entry.oracle_sql()
    bad = 0
    for key, fn in entry.queries().items():
        if (only and key not in only) or (key not in checks and key not in catalog.QUERIES):
            continue
        try:
            ok, line = compare(session, connection, folder, key, fn, checks.get(key))
        except Exception as error:  # noqa: BLE001
            ok, line = False, f"{key}: {type(error).__name__} {str(error)[:600]}"
        bad += not ok
        print(("  " if ok else "X ") + line[:1200], flush=True)
    print("failed:", bad)
