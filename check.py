"""Run every registered query against its SQL twin in DuckDB and report differences.

usage: python check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def canonical(value):
    if value is None:
        return "\x00null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9))
    if isinstance(value, int):
        return repr(value)
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(canonical(r[i]) for i in order) for r in rows)


def kinds_of_spark(df):
    short = {"bigint": "int", "int": "int", "double": "float", "string": "str", "boolean": "bool"}
    return {n: short.get(t, t) for n, t in df.dtypes}


def compare(spark, con, fn, sql, sf_dir):
    df = fn(spark, sf_dir)
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return "rows", len(got), ""
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    kinds = {d[0]: str(d[1]) for d in cur.description}
    want_cols, want = rows_of(cols, cur.fetchall())
    if got_cols != want_cols:
        return "COLUMNS", len(got), f"{got_cols} != {want_cols}"
    odd = [f"{n}:{k}/{kinds[n]}" for n, k in kinds_of_spark(df).items()
           if {"int": "BIGINT INTEGER HUGEINT", "float": "DOUBLE", "str": "VARCHAR", "bool": "BOOLEAN"}.get(k, kinds[n]).find(kinds[n]) < 0
           or kinds[n] == "HUGEINT"]
    note = f" types {odd}" if odd else ""
    if got != want:
        a, b = set(got) - set(want), set(want) - set(got)
        return "DIFF", len(got), f"spark {len(got)} sql {len(want)}; only spark {sorted(a)[:2]}; only sql {sorted(b)[:2]}{note}"
    return ("ok" if not odd else "TYPES"), len(got), note


def main():
    from jobloom.plans import catalog
    from jobloom.session import local_session

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    spark = local_session()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    queries, sql = catalog.load()
    bad = 0
    for name, fn in queries.items():
        if args and not any(a in name for a in args):
            continue
        start = time.time()
        try:
            status, n, note = compare(spark, con, fn, sql.get(name), sf_dir)
        except Exception as e:  # report and go on
            status, n, note = "ERROR", 0, f"{type(e).__name__}: {str(e)[:1500]}"
        bad += status not in ("ok", "rows")
        print(f"{status:8} {name:32} rows={n:<7} {time.time() - start:5.1f}s {note}", flush=True)
    print(f"{bad} problems")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
