"""Registered queries against their SQL."""

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(v):
    if isinstance(v, (list, np.ndarray)):
        return tuple(cell(x) for x in v)
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    return f"{float(v) + 0:.9g}" if isinstance(v, (int, float, np.integer, np.floating)) else str(v)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(map(tuple, ([cell(v) for v in r] for r in df.itertuples(index=False))), key=str)


def connection(folder):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return c


def same(spark, folder, query, sql):
    got, want = query(spark, folder).toPandas(), connection(folder).sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
