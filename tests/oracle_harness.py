"""Run a registered Spark query and its DuckDB twin and compare the results."""

from __future__ import annotations

import math
from datetime import date, datetime
from decimal import Decimal

import duckdb
import pandas as pd

from tickflow.sources.tables import DRIVER_TABLES, table_path


def duck_connection(sf_dir: str):
    con = duckdb.connect()
    for t in DRIVER_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(sf_dir, t)}')")
    return con


def _norm(v):
    if v is None or v is pd.NaT:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return v
    if isinstance(v, pd.Timestamp):
        return v.to_pydatetime().replace(tzinfo=None)
    if isinstance(v, datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, date):
        return v
    if isinstance(v, Decimal):
        return float(v)
    if hasattr(v, "item") and not isinstance(v, (list, tuple, dict)):
        try:
            return _norm(v.item())
        except Exception:  # noqa: BLE001
            return v
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


def _rows(records, cols):
    out = []
    for rec in records:
        out.append(tuple(_norm(rec[c]) for c in cols))
    return out


def _key(row):
    return tuple((0, "") if v is None else (1, repr(v)) for v in row)


def _close(a, b, rel=1e-9):
    if a is None or b is None:
        return a is None and b is None
    if isinstance(a, float) or isinstance(b, float):
        try:
            return math.isclose(float(a), float(b), rel_tol=rel, abs_tol=1e-9)
        except (TypeError, ValueError):
            return False
    if isinstance(a, tuple) and isinstance(b, tuple):
        return len(a) == len(b) and all(_close(x, y, rel) for x, y in zip(a, b))
    return a == b


def compare(spark_df, con, sql: str) -> dict:
    """Column names, row count, exact and tolerant row multiset equality."""
    s_recs = [r.asDict() for r in spark_df.collect()]
    s_names = spark_df.columns
    cur = con.execute(sql)
    d_names = [d[0] for d in cur.description]
    d_recs = [dict(zip(d_names, r)) for r in cur.fetchall()]
    s_cols, d_cols = sorted(s_names), sorted(d_names)
    res = {"spark_rows": len(s_recs), "oracle_rows": len(d_recs),
           "columns_match": s_cols == d_cols, "spark_cols": s_cols, "oracle_cols": d_cols}
    if not res["columns_match"]:
        res["ok"] = False
        return res
    s_rows = sorted(_rows(s_recs, s_cols), key=_key)
    d_rows = sorted(_rows(d_recs, s_cols), key=_key)
    res["exact"] = s_rows == d_rows
    tol = len(s_rows) == len(d_rows) and all(_close(a, b) for a, b in zip(s_rows, d_rows))
    res["tolerant"] = tol
    if not tol:
        bad = [(a, b) for a, b in zip(s_rows, d_rows) if not _close(a, b)]
        res["first_diffs"] = bad[:3]
        res["n_diffs"] = len(bad)
    res["ok"] = res["columns_match"] and len(s_rows) == len(d_rows) and tol
    return res
