"""Registered training-data queries against their SQL oracles."""

import os

import duckdb
import pytest

from scorelake.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_query_equals_its_oracle(spark, key):
    duck = duckdb.connect()
    for name in os.listdir(SF):
        duck.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    df = QUERIES[key](spark, SF)
    columns = sorted(df.columns)
    expected = duck.sql(f"SELECT {', '.join(columns)} FROM ({ORACLES[key]}) q").fetchall()
    assert sorted(map(repr, (tuple(r) for r in df.select(*columns).collect()))) == sorted(map(repr, expected))
