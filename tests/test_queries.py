"""Every query of the library against its SQL on the same tables."""

import datetime

import duckdb
import pandas as pd
import pytest

from airledger.plans import queries as library

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE"}


@pytest.fixture(scope="module")
def sql(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def ordered(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].map(lambda x: isinstance(x, datetime.date)).any():
            df[c] = pd.to_datetime(df[c])
        if str(df[c].dtype).startswith("datetime"):
            df[c] = df[c].astype("datetime64[ns]")
        if df[c].dtype == object:
            df[c] = df[c].map(lambda x: None if x is None or x is pd.NaT else x)
    return df.sort_values(list(df.columns), key=lambda s: s.astype(str)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(library.oracle_sql()))
def test_against_sql(spark, sf, sql, name):
    frame = library.queries()[name](spark, sf)
    found = ordered(frame.toPandas())
    rel = sql.execute(f"DESCRIBE {library.oracle_sql()[name]}").fetchall() if not library.oracle_sql()[name].startswith("WITH RECURSIVE") else []
    assert all(NAMES.get(t, t) == kind for (c, t) in frame.dtypes for (n, kind, *_) in rel if n == c)
    wanted = ordered(sql.execute(library.oracle_sql()[name]).df())
    pd.testing.assert_frame_equal(found, wanted, check_dtype=False, rtol=0, atol=1e-9)


@pytest.mark.parametrize("name", sorted(set(library.queries()) - set(library.oracle_sql())))
def test_rows(spark, sf, name):
    assert library.queries()[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
