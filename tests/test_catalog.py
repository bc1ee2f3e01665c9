"""Every registered core query against its DuckDB statement on the driver's tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from terralign.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def shaped(frame: pd.DataFrame) -> list:
    frame = frame[sorted(frame.columns)]
    rows = [tuple(None if pd.isna(x) else round(float(x), 5) + 0.0 if isinstance(x, (int, float)) or hasattr(x, "dtype") else x for x in row) for row in frame.itertuples(index=False)]
    return sorted(rows, key=str)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_matches_oracle(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    want = duck.execute(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want) > 0
    assert shaped(got) == shaped(want)


def test_every_query_has_an_oracle():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)
