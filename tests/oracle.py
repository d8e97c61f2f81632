"""Compare a registered query with its SQL in DuckDB."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(sf: str):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if type(v).__name__ == "Decimal":
        return round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def kind(v):
    return type(norm(v)).__name__


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return sorted(cols), sorted(out, key=lambda r: tuple((x is not None, str(x)) for x in r))


def compare(spark, con, fn, sql, sf):
    """None if equal, else a short description of the difference."""
    df = fn(spark, sf)
    left = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    right = rows_of([d[0] for d in cur.description], cur.fetchall())
    if left[0] != right[0]:
        return f"columns {left[0]} vs {right[0]}"
    if len(left[1]) != len(right[1]):
        only = [r for r in left[1] if r not in set(right[1])][:2], [r for r in right[1] if r not in set(left[1])][:2]
        return f"rows {len(left[1])} vs {len(right[1])}: {str(only)[:600]}"
    bad = [(a, b) for a, b in zip(*[left[1], right[1]]) if a != b]
    if bad:
        return f"{len(bad)}/{len(left[1])} differ; columns {left[0]}; first {str(bad[0])[:700]}"
    kinds = [(c, kind(a), kind(b)) for c, a, b in zip(left[0], left[1][0], right[1][0]) if kind(a) != kind(b)] if left[1] else []
    return f"types {kinds}" if kinds else None
