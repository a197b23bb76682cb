"""Order-insensitive comparison of a Spark result with its DuckDB oracle.

Used by ``tools/check_oracle.py`` and the tests: both sides are turned into
sorted row tuples with floats rounded to 6 places, NULL-likes unified and
times rendered as ISO text.
"""

from __future__ import annotations

import math

import pandas as pd


def norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6) if v != int(v) or abs(v) > 2**53 else int(v)
    if isinstance(v, pd.Timestamp):
        return v.to_pydatetime().replace(tzinfo=None).isoformat()
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if hasattr(v, "item"):
        return norm(v.item())
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def rows(pdf: pd.DataFrame) -> list:
    cols = sorted(pdf.columns)
    out = [tuple(norm(x) for x in rec) for rec in pdf[cols].astype(object).itertuples(index=False)]
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


def duck(sf_dir: str):
    import duckdb

    from parkops.sources.tables import DRIVER_TABLES, table_path
    con = duckdb.connect()
    for t in DRIVER_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(sf_dir, t)}')")
    return con
