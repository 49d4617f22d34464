"""Holds a query's rows against its SQL as the driver does: columns by name, rows as a bag."""

from __future__ import annotations

import datetime as dt
import decimal
import glob
import math
import os
from collections import Counter

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (float, decimal.Decimal)) and not isinstance(v, int):
        v = float(v)
        return "nan" if math.isnan(v) else float(f"{v:.10g}")
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in v.items())
    if hasattr(v, "asDict"):
        return tuple((k, plain(x)) for k, x in v.asDict().items())
    return v


def kind(t):
    t = t.upper()
    return "int" if t in ("BIGINT", "INTEGER", "SMALLINT", "TINYINT", "INT", "LONG", "HUGEINT") else "float" if t.startswith(("DOUBLE", "FLOAT", "DECIMAL")) else "text" if t in ("VARCHAR", "STRING") else t


def differences(df, con, sql):
    """Nothing if the query and the SQL agree, else what doesn't."""
    names = sorted(df.columns)
    rel = con.sql(sql)
    if names != sorted(rel.columns):
        return f"columns {names} for {sorted(rel.columns)}"
    types = dict(zip(rel.columns, map(str, rel.types)))
    mine = dict(df.dtypes)
    odd = [(n, mine[n], types[n]) for n in names if kind(mine[n]) != kind(types[n]) and kind(types[n]) in ("int", "float", "text")]
    if odd:
        return f"types {odd}"
    at = [rel.columns.index(n) for n in names]
    want = Counter(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
    got = Counter(tuple(plain(r[n]) for n in names) for r in df.collect())
    if want == got:
        return None
    return f"{sum(got.values())} rows for {sum(want.values())}; only here {list((got - want).items())[:3]}; only SQL {list((want - got).items())[:3]}"
