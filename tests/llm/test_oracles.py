"""The corpus queries that have DuckDB statements give the same rows as these."""

import math

import duckdb
import pytest

from oscilla.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_as_sql(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "benchmark", "conversations"):
        duck.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    got, want = queries.QUERIES[name](spark, SF), duck.sql(queries.ORACLES[name])
    plain = lambda v: None if isinstance(v, float) and math.isnan(v) else v
    rows = lambda data, names: sorted((tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in data), key=repr)
    assert rows([tuple(r) for r in got.collect()], got.columns) == rows(want.fetchall(), want.columns)


def test_operators_are_registered():
    assert sorted(int(k.split("_")[0][2:]) for k in queries.QUERIES) == list(range(1, 14))
