"""The catalogue against its SQL, at the smallest scale."""

import os

import duckdb
import pytest

from palimpsest.plans.catalogue import ORACLES, QUERIES
from palimpsest.session import ship

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](ship(spark), SF)
    rows = df.collect()
    assert rows
    if name in ORACLES:
        result = duck.execute(ORACLES[name])
        columns = [d[0] for d in result.description]
        assert sorted(columns) == sorted(df.columns)
        assert sorted(repr(tuple(r[c] for c in columns)) for r in rows) == sorted(repr(r) for r in result.fetchall())
    elif name == "q39_round_trip":
        assert all(r["accepts"] and r["rejects"] for r in rows)
