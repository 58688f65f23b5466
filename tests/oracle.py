"""Compare registered queries with their SQL on an independent engine.

    python -m tests.oracle [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def _cell(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, float):
        return None if math.isnan(v) else v
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], [tuple(_cell(r[i]) for i in order) for r in rows]


def _key(row):
    return tuple((v is None, type(v).__name__ in ("float", "int"), round(v, 4) if isinstance(v, float) else str(v)) if not isinstance(v, (int, bool)) else (False, True, v) for v in row)


def _type(t: str) -> str:
    t = t.lower()
    return {
        "bigint": "int64", "long": "int64", "integer": "int32", "int": "int32", "double": "double", "varchar": "string",
        "string": "string", "boolean": "bool",
    }.get(t, t)


def compare(spark_df, con, sql: str) -> list[str]:
    got_cols, got = rows_of(spark_df.columns, spark_df.collect())
    cur = con.execute(sql)
    want_cols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    problems = []
    if got_cols != want_cols:
        return [f"columns {got_cols} != {want_cols}"]
    types = {f.name: _type(f.dataType.simpleString()) for f in spark_df.schema.fields}
    other = {d[0]: _type(str(d[1])) for d in cur.description}
    for c in types:
        if types[c] != other[c]:
            problems.append(f"type of {c}: {types[c]} != {other[c]}")
    if len(got) != len(want):
        return problems + [f"rows {len(got)} != {len(want)}"]
    bad = 0
    for a, b in zip(sorted(got, key=_key), sorted(want, key=_key)):
        if a != b:
            bad += 1
            if bad <= 3:
                problems.append(f"{a} != {b}")
    if bad:
        problems.append(f"{bad} of {len(got)} rows differ")
    if not got:
        problems.append("no rows")
    return problems


def main():
    import os
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from tests.conftest import make_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark = make_session()
    con = connect(sf)
    queries, sql = entry.queries(), entry.oracle_sql()
    failed = []
    for name, fn in queries.items():
        if names and not any(n in name for n in names):
            continue
        import gc; gc.collect(); start = time.time()
        try:
            if name in sql:
                problems = compare(fn(spark, sf), con, sql[name])
            else:
                problems = [] if fn(spark, sf).count() else ["no rows"]
        except Exception as e:  # report every query
            problems = [f"{type(e).__name__}: {str(e)[:600]}"]
        if problems:
            failed.append(name)
        print(f"{'FAIL' if problems else 'ok  '} {name} {time.time() - start:.2f}s", *problems, sep="\n    " if problems else " ", flush=True)
    print(len(failed), "failed", failed)


if __name__ == "__main__":
    main()
