"""Every query with SQL agrees with DuckDB on the smallest tables; the others give rows."""

import os

import pandas as pd
import pytest

from ledgerloom.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in ("events", "documents"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list:
    one = lambda x: "" if pd.isna(x) else str(int(x)) if isinstance(x, float) and x.is_integer() else str(x)
    return sorted(tuple(map(one, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert len(got)
    if name in ORACLE_SQL:
        want = duck.execute(ORACLE_SQL[name]).fetchdf()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
