"""Comparing Spark results with DuckDB's."""

import math
import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = "/root/testdata/sf0.001"


def connect(sf_dir: str = DATA):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def _plain(x):
    if x is pd.NA:
        return None
    if hasattr(x, "item"):
        x = x.item()
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 9)
    return None if x is None or x != x else x


def rows(pdf):
    """Sorted rows as text, columns by name; 3.0 and 3 are told apart by the schema check only."""
    names = sorted(pdf.columns)
    return names, sorted(repr([float(v) if isinstance(v := _plain(x), int) and not isinstance(v, bool) else v for x in r]) for r in pdf[names].itertuples(index=False))


def assert_same(df, sql: str, sf_dir: str = DATA) -> None:
    got, want = rows(df.toPandas()), rows(connect(sf_dir).execute(sql).df())
    assert got[0] == want[0]
    assert got[1] == want[1]
