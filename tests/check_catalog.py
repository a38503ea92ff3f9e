"""Run the catalogue against DuckDB and print what differs: ``python tests/check_catalog.py SF_DIR [name ...]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _kind(s: pd.Series) -> str:
    if pd.api.types.is_bool_dtype(s):
        return "bool"
    if pd.api.types.is_integer_dtype(s):
        return "int"
    if pd.api.types.is_numeric_dtype(s):
        return "float"
    return "object"


def _plain(df: pd.DataFrame) -> pd.DataFrame:
    """Columns by name, rows sorted, numbers as plain floats or ints."""
    out = df[sorted(df.columns)].copy()
    for c in out.columns:
        if _kind(out[c]) in ("int", "float") and out[c].isna().any():
            out[c] = out[c].astype("float64")
        elif _kind(out[c]) == "object":
            out[c] = out[c].map(lambda v: None if v is None or v is pd.NA or v is pd.NaT or v != v else str(v))
    return out.sort_values(list(out.columns), ignore_index=True, na_position="first") if len(out.columns) else out


def difference(ours: pd.DataFrame, theirs: pd.DataFrame) -> str | None:
    """What differs between two results as multisets of rows, or None."""
    if sorted(ours.columns) != sorted(theirs.columns):
        return f"columns {sorted(ours.columns)} != {sorted(theirs.columns)}"
    if len(ours) != len(theirs):
        return f"{len(ours)} rows != {len(theirs)}"
    a, b = _plain(ours), _plain(theirs)
    for c in a.columns:
        x, y = a[c], b[c]
        if len(x) and {_kind(x), _kind(y)} == {"object", "float"} and not (x.isna().all() or y.isna().all()):
            return f"{c}: types {x.dtype} and {y.dtype}"
        if _kind(x) != _kind(y) and not x.isna().any() and not y.isna().any() and len(x):
            return f"{c}: types {x.dtype} and {y.dtype}"
        same = (x == y) | (x.isna() & y.isna())
        if not same.all():
            i = int(np.flatnonzero(~same.to_numpy(dtype=bool))[0])
            return f"{c}: {int((~same).sum())} rows differ, first {x[i]!r} != {y[i]!r}"
    return None


def main(sf_dir: str, names: list[str]) -> int:
    from __spark_entry__ import oracle_sql, queries
    from scorekit.staging import local_session, staging_scope

    spark, con, sql, bad = local_session(8), connect(sf_dir), oracle_sql(), 0
    for name, run in queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            with staging_scope(spark):
                ours = run(spark, sf_dir).toPandas()
            took = time.time() - start
            note = f"rows only ({len(ours)})"
            if name in sql:
                diff = difference(ours, con.sql(sql[name]).df())
                note = f"ok ({len(ours)})" if diff is None else f"DIFF {diff}"
                bad += diff is not None
        except Exception as e:  # noqa: BLE001 - report and go on to the next query
            took, note, bad = time.time() - start, f"ERROR {type(e).__name__}: {str(e)[:600]}", bad + 1
        print(f"{name:28s} {took:6.2f}s {note}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
