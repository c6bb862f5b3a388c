"""Run registered queries and their SQL side by side and compare every value.

python tools/compare.py [--sf 0.01] [--match REGEX]
"""

from __future__ import annotations

import argparse
import re
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    return con


SAME = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
    "date": "DATE", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP",
}


def compare(df, con, sql: str) -> str:
    """'' when columns, types and rows agree, otherwise what differs."""
    relation = con.execute(sql)
    names = [d[0] for d in relation.description]
    types = [str(d[1]) for d in relation.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    theirs = [tuple(row[i] for i in order) for row in relation.fetchall()]
    columns = sorted(df.columns)
    if columns != [names[i] for i in order]:
        return f"columns {columns} != {[names[i] for i in order]}"
    note = ""
    spark_types = dict(df.dtypes)
    for i in order:
        if SAME.get(spark_types[names[i]]) != types[i]:
            note += f" type {names[i]}: {spark_types[names[i]]} / {types[i]};"
    ours = [tuple(row) for row in df.select(*[f"`{c}`" for c in columns]).collect()]
    if len(ours) != len(theirs):
        return f"rows {len(ours)} != {len(theirs)}{note}"
    a, b = Counter(map(repr, ours)), Counter(map(repr, theirs))
    if a != b:
        left, right = list((a - b).items())[:3], list((b - a).items())[:3]
        return f"values differ ({sum((a - b).values())} rows){note}\n   ours   {left}\n   theirs {right}\n   {columns}"
    return note and f"types:{note}"


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("--match", default="")
    args = parser.parse_args()
    from woonvonk.plans import catalog
    from woonvonk.session import build_session

    sf_dir = f"/root/testdata/sf{args.sf}"
    spark = build_session("compare", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = 0
    for name, job in catalog.jobs().items():
        if not re.search(args.match, name):
            continue
        start = time.time()
        try:
            df = job(spark, sf_dir)
            sql = catalog.sql().get(name)
            if sql is None:
                print(f"rows  {name}: {df.count()} ({time.time() - start:.1f}s)", flush=True)
                continue
            problem = compare(df, con, sql)
        except Exception as error:  # report and go on
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        failed += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '}  {name} ({time.time() - start:.1f}s) {problem}", flush=True)
    print(f"failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
