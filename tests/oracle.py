"""A registered query beside its SQL in DuckDB."""

import math
from pathlib import Path

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.sql(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def cell(x):
    if x is None or (not hasattr(x, "__len__") and pd.isna(x)):
        return "~"
    if isinstance(x, bool) or type(x).__name__ == "bool_":
        return str(bool(x))
    if hasattr(x, "__float__") and not isinstance(x, str):
        return f"{float(x):.6g}" if math.isfinite(float(x)) else str(x)
    return str(x)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(cell(x) for x in r) for r in df.itertuples(index=False))


def same(spark, con, query, sql, sf_dir):
    got, wanted = query(spark, sf_dir).toPandas(), con.sql(sql).df()
    assert sorted(got.columns) == sorted(wanted.columns)
    assert rows(got) == rows(wanted)
