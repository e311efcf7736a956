"""Compare a query with its oracle SQL: same columns, rows and values."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def duck(sf: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(f)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{f}')")
    return con


def _norm(v):
    if v is None:
        return ("", "~")
    if isinstance(v, bool):
        return ("b", str(v))
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        f = float(v)
        return ("n", "nan" if math.isnan(f) else repr(f + 0.0))
    if hasattr(v, "tzinfo") and v.tzinfo is not None:
        v = v.replace(tzinfo=None)
    return ("s", str(v))


def diff(spark, con, fn, sql: str, sf: str) -> str | None:
    df = fn(spark, sf)
    cols = sorted(df.columns)
    got = [tuple(r) for r in df.select(*cols).collect()]
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    if sorted(names) != cols:
        return f"columns {cols} != {sorted(names)}"
    pos = [names.index(c) for c in cols]
    want = [tuple(r[p] for p in pos) for r in res.fetchall()]
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    if not got:
        return "no rows"
    a = sorted(tuple(_norm(v) for v in r) for r in got)
    b = sorted(tuple(_norm(v) for v in r) for r in want)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        x, y = bad[0]
        return f"{len(bad)}/{len(a)} rows differ; cols {cols}\n   got  {[v for _, v in x]}\n   want {[v for _, v in y]}"
    return None
