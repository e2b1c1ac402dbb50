"""Compare registered queries with their SQL: names, row count and values."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, (float, int)):
        return round(float(value), 6)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name, query, sql, sf_dir):
    """None when equal, else a text that says how they differ; with the row count."""
    df = query(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows_of(names, cur.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}", len(want)
    if got != want:
        a, b = set(map(repr, got)), set(map(repr, want))
        return (f"{len(got)} rows, wanted {len(want)}\n   only spark: {sorted(a - b)[:2]}"
                f"\n   only sql:   {sorted(b - a)[:2]}")[:1500], len(want)
    return None, len(want)


if __name__ == "__main__":
    sys.path.insert(0, __file__.rsplit("/", 2)[0])
    import __spark_entry__ as entry
    from newsloom.session import local_session
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = sys.argv[2:]
    spark, con = local_session(8), connect(sf_dir)
    oracles = entry.oracle_sql()
    for key, query in entry.queries().items():
        if only and not any(o in key for o in only):
            continue
        start = time.time()
        try:
            if key in oracles:
                problem, n = compare(spark, con, key, query, oracles[key], sf_dir)
            else:
                problem, n = None, len(query(spark, sf_dir).collect())
                key += " (rows only)"
        except Exception as e:
            problem, n = f"{type(e).__name__}: {str(e)[:1200]}", -1
        print(f"{'ok  ' if problem is None and n else 'FAIL'} {key} rows={n} {time.time() - start:.1f}s", flush=True)
        if problem:
            print("   " + problem, flush=True)
