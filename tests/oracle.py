"""Compares a query with its DuckDB counterpart as the driver does."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = df[c].map(lambda x: "null" if x is None or isinstance(x, float) and x != x else f"{x:.9g}" if isinstance(x, float) else str(x))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def assert_same(found: pd.DataFrame, wanted: pd.DataFrame) -> None:
    assert sorted(found.columns) == sorted(wanted.columns)
    pd.testing.assert_frame_equal(normal(found), normal(wanted))
