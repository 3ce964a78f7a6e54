"""Comparison of a query with its SQL in DuckDB: names, types and rows."""

import math
import os

import duckdb
import numpy as np
import pandas as pd

TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "float": "FLOAT", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}


def connect(folder):
    c = duckdb.connect()
    for name in os.listdir(folder):
        if name.endswith(".parquet"):
            c.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{folder}/{name}'")
    return c


def _cell(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (int, float, np.integer, np.floating)):
        return f"{float(v):.12g}"
    return str(v)


def _rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(_cell(v) for v in r) for r in df.itertuples(index=False))


def differences(df, connection, sql):
    relation = connection.sql(sql)
    ours = sorted((n, TYPES.get(t, t)) for n, t in df.dtypes)
    theirs = sorted(zip(relation.columns, map(str, relation.types)))
    if ours != theirs:
        return f"columns {ours} and {theirs}"
    a, b = _rows(df.toPandas()), _rows(relation.df())
    if a != b:
        return f"{len(a)} and {len(b)} rows; only here {sorted(set(a) - set(b))[:3]}, only in SQL {sorted(set(b) - set(a))[:3]}"
    return ""
