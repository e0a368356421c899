"""Run a registered query and its SQL and compare names, row counts and values."""
from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, decimal.Decimal):
        return ("DECIMAL", str(v))
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return round(v, 6) + 0.0
    if isinstance(v, (dt.datetime, dt.date)):
        return str(v)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=repr)


def compare(spark, name, fn, sql, sf_dir, con):
    """(ok, message)"""
    start = time.time()
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    took = time.time() - start
    if sql is None:
        return True, f"rows={len(got)} {took:.1f}s (no SQL)"
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(names)}"
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if len(a) != len(b):
        return False, f"rows {len(a)} != {len(b)}\n   only spark {[x for x in a if x not in set(b)][:3]}\n   only sql {[x for x in b if x not in set(a)][:3]}"
    for x, y in zip(a, b):
        if repr(x) != repr(y):
            return False, f"cols {sorted(names)}\n   spark {x}\n   sql   {y}"
    return True, f"rows={len(a)} {took:.1f}s"


def main(argv):
    sys.path.insert(0, ".")
    import __spark_entry__ as e
    from tallywright.session import local_session
    sf = "/root/testdata/sf0.01"
    pats = argv or [""]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    q, o = e.queries(), e.oracle_sql()
    bad = 0
    for n in q:
        if not any(n.startswith(p) for p in pats):
            continue
        try:
            ok, msg = compare(spark, n, q[n], o.get(n), sf, con)
        except Exception as ex:  # report every failure and go on
            ok, msg = False, f"{type(ex).__name__}: {str(ex)[:700]}"
        if not ok:
            bad += 1
        print(("ok   " if ok else "FAIL ") + n, msg, flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
