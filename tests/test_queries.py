"""Every registered query against its SQL on the same tables."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from annalist.plans import QUERIES, SQL

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        c.sql(f"create view {p.stem} as select * from read_parquet('{p}')")
    return c


def sorted_rows(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, name):
    got, want = sorted_rows(QUERIES[name](spark, DATA).toPandas()), sorted_rows(duck.sql(SQL[name]).df())
    assert list(got.columns) == list(want.columns)
    assert len(got) == len(want) and len(got) > 0
    pd.testing.assert_frame_equal(got, want, check_dtype=False, rtol=0, atol=1.1e-6)
