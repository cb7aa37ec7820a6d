"""Order-insensitive comparison of a Spark result with a DuckDB oracle."""

from __future__ import annotations

import datetime as _dt
import math

import duckdb

from tablelab.plans.fixtures import TABLES


def duck_connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir.rstrip('/')}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if isinstance(v, _dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if hasattr(v, "asDict"):
        return tuple(_norm(x) for x in v)
    try:
        import decimal
        if isinstance(v, decimal.Decimal):
            return round(float(v), 6)
    except Exception:  # noqa: BLE001
        pass
    return v


def spark_rows(sdf):
    cols = sdf.columns
    return cols, [tuple(r) for r in sdf.collect()]


def _key(row):
    return tuple((x is None, str(type(x)), x if x is not None else 0) if not isinstance(x, tuple)
                 else (False, "t", str(x)) for x in row)


def _close(a, b):
    if a == b:
        return True
    if isinstance(a, float) and isinstance(b, float):
        return abs(a - b) <= 1e-5 * max(1.0, abs(a), abs(b))
    if isinstance(a, (int, float)) and isinstance(b, (int, float)) and not isinstance(a, bool) and not isinstance(b, bool):
        return abs(a - b) <= 1e-5 * max(1.0, abs(a), abs(b))
    if isinstance(a, tuple) and isinstance(b, tuple) and len(a) == len(b):
        return all(_close(x, y) for x, y in zip(a, b))
    return False


def compare_frames(cols, rows, con, sql):
    rel = con.sql(sql)
    dcols = list(rel.columns)
    drows = rel.fetchall()
    if sorted(cols) != sorted(dcols):
        return False, f"columns differ: spark={cols} duck={dcols}"
    order = sorted(cols)
    si = [cols.index(c) for c in order]
    di = [dcols.index(c) for c in order]
    s = sorted((tuple(_norm(r[i]) for i in si) for r in rows), key=_key)
    d = sorted((tuple(_norm(r[i]) for i in di) for r in drows), key=_key)
    if len(s) != len(d):
        return False, f"row count spark={len(s)} duck={len(d)}"
    for a, b in zip(s, d):
        if not _close(a, b):
            return False, f"rows differ ({len(s)} rows): spark={a} duck={b}"
    return True, f"{len(s)} rows"
