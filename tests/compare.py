"""Comparing a Spark result with DuckDB's, as rows in any order."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def rows(pdf):
    def say(v):
        if v is None or v is pd.NA or v != v:
            return "null"
        return repr(float(v) + 0.0) if isinstance(v, int | float) and not isinstance(v, bool) or hasattr(v, "dtype") and v.dtype.kind in "iuf" else str(v)

    columns = sorted(pdf.columns)
    for c in columns:
        if str(pdf[c].dtype).startswith("datetime"):
            pdf[c] = pdf[c].astype("datetime64[us]").astype(str)
    return columns, sorted(tuple(say(v) for v in r) for r in pdf[columns].itertuples(index=False))
