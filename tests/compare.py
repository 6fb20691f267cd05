"""Compare a Spark result with a DuckDB result the way the driver's gate does:
columns sorted by name, values normalised, rows compared as a multiset.

Floats are compared exactly: both sides sum exact decimals and cast last.
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os

import duckdb
import numpy as np
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, np.ma.MaskedArray):
        return tuple(None if m else norm(x) for x, m in zip(v.data.tolist(), np.ma.getmaskarray(v).tolist()))
    if hasattr(v, "asDict"):  # a Row is also a tuple: keep its field names
        return norm(v.asDict())
    if isinstance(v, dict):
        return tuple((k, norm(x)) for k, x in sorted(v.items()))
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(norm(x) for x in (v.tolist() if isinstance(v, np.ndarray) else v))
    if isinstance(v, (pd.Timestamp, dt.datetime)):
        if pd.isna(v):
            return None
        v = pd.Timestamp(v)
        if v == v.normalize():
            return v.date().isoformat()
        return v.isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, np.generic):
        v = v.item()
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return float(v)
    if isinstance(v, bool):
        return int(v)
    return v


def rows_of(pdf: pd.DataFrame) -> tuple[list[str], list[tuple]]:
    cols = sorted(pdf.columns)
    pdf = pdf[cols]
    rows = [tuple(norm(x) for x in r) for r in pdf.itertuples(index=False, name=None)]
    rows.sort(key=repr)
    return cols, rows


def compare(spark_df, sql: str, sf_dir: str) -> dict:
    left = spark_df.toPandas()
    right = duck(sf_dir).execute(sql).df()
    lc, lr = rows_of(left)
    rc, rr = rows_of(right)
    out = {"rows": (len(lr), len(rr)), "columns_match": lc == rc, "values_match": lr == rr}
    if lc != rc:
        out["columns"] = (lc, rc)
    elif lr != rr:
        diff_l = [r for r in lr if r not in set(rr)][:3]
        diff_r = [r for r in rr if r not in set(lr)][:3]
        out["sample_diff"] = (diff_l, diff_r)
    out["ok"] = out["columns_match"] and out["values_match"]
    return out
