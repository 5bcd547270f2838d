"""Rows of a Spark DataFrame and of DuckDB SQL in one form."""

import math

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def text(v):
    if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, float | np.floating):
        return str(int(v)) if float(v).is_integer() else repr(float(v))
    if isinstance(v, bool | np.bool_):
        return str(bool(v))
    return str(int(v)) if isinstance(v, np.integer) else str(v)


def rows(pdf):
    pdf = pdf[sorted(pdf.columns)]
    return sorted(tuple(map(text, r)) for r in pdf.itertuples(index=False))
