"""Every library query that has SQL, held against DuckDB on the smallest tables."""

import duckdb
import pytest

from odolith.plans.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ["events", "embeddings", "lineitem", "part"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    ours, theirs = QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    cols = sorted(ours.columns)
    ours, theirs = (x[cols].sort_values(cols).reset_index(drop=True) for x in (ours, theirs))
    assert len(ours) == len(theirs) > 0
    for c in cols:
        if ours[c].dtype.kind == "f":
            assert ((ours[c] - theirs[c]).abs().fillna(0) <= 2e-6).all(), c
            assert (ours[c].isna() == theirs[c].isna()).all(), c
        else:
            assert (ours[c].astype(str) == theirs[c].astype(str)).all(), c
