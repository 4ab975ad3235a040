"""Compare a query with its SQL in DuckDB."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(x):
    if isinstance(x, bool) or x is None or isinstance(x, str):
        return x
    if isinstance(x, (float, decimal.Decimal)):
        return "nan" if math.isnan(x) else round(float(x), 6) + 0.0
    if isinstance(x, (list, tuple)) and not hasattr(x, "asDict"):
        return tuple(plain(y) for y in x)
    if hasattr(x, "asDict"):
        return tuple(plain(y) for y in x)
    if isinstance(x, dict):
        return tuple(sorted((plain(k), plain(v)) for k, v in x.items())) if all(not isinstance(k, str) for k in x) else tuple(plain(v) for v in x.values())
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    return x


def rows(names, data):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in data), key=repr)


def compare(df, sql: str, con) -> str:
    """Empty if equal; else what differs."""
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    want = rows(names, cur.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    got = rows(df.columns, df.collect())
    if got == want:
        return ""
    only = [r for r in got if r not in want[:3000]][:2], [r for r in want if r not in got[:3000]][:2]
    return f"{len(got)} and {len(want)} rows; {only}"
