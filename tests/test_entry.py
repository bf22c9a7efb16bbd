import __spark_entry__ as entry
import duckdb
import numpy as np
import pandas as pd
import pytest

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = df[c].map(lambda v: float(v) if isinstance(v, int | float | np.number) else None if v is None else str(v))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_equals_duckdb(spark, duck, name):
    want = plain(duck.execute(entry.oracle_sql()[name]).df())
    got = plain(entry.queries()[name](spark, SF).toPandas())
    pd.testing.assert_frame_equal(got, want, check_dtype=False)


def test_entry(spark):
    assert entry.entry(spark).count() == 5


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
