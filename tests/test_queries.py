"""Every query that has a DuckDB statement gives the same rows as it."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from oscilla.plans import long_recordings, manifests, signals

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES = {**signals.QUERIES, **manifests.QUERIES, **long_recordings.QUERIES}
ORACLES = {**signals.ORACLES, **manifests.ORACLES, **long_recordings.ORACLES}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda k: names[k])
    cell = lambda v: None if isinstance(v, float) and math.isnan(v) else v
    return sorted((tuple(cell(r[k]) for k in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert plain([tuple(r) for r in got.collect()], got.columns) == plain(want.fetchall(), want.columns)


def test_every_query_without_sql_is_a_model():
    assert QUERIES.keys() - ORACLES.keys() == {"rf_importance", "rf_split_comparison", "mlp_lolo"}


def test_entry(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark).collect()
    assert rows and set(rows[0].asDict()) == {"label", "rms", "kurtosis", "skewness", "crest_factor", "peak"}
    assert entry.oracle_sql().keys() <= entry.queries().keys()


def test_models_are_whole(spark, monkeypatch):
    """Each load is left out once, and every fit has the operators' own rounds, trees and depth."""
    import inspect

    from oscilla.operators import experiments

    rows = spark.range(40).selectExpr("id AS vec_id", "cast(id % 4 AS int) AS Load", "cast(id % 3 AS int) AS Label", "cast(id / 5 AS int) AS file", "rand(1) AS f")
    monkeypatch.setattr(manifests, "_labelled", lambda *_: (rows, ["f"]))
    fits = []

    def seen(f, out):
        def run(*args, **kw):
            bound = inspect.signature(f).bind(*args, **kw)
            bound.apply_defaults()
            fits.append(bound.arguments)
            return out

        return run

    scores = spark.sql("SELECT 'A3|x' AS run, 1.0D AS accuracy, 1.0D AS f1_macro, 1L AS n_train, 1L AS n_test")
    monkeypatch.setattr(experiments, "train_and_score_runs", seen(experiments.train_and_score_runs, scores))
    monkeypatch.setattr(experiments, "importances", lambda *_: scores)
    monkeypatch.setattr(experiments, "forest", seen(experiments.forest, None))
    monkeypatch.setattr(experiments, "compare_splits", seen(experiments.compare_splits, scores))
    assert [r.name for r in QUERIES["mlp_lolo"](spark, SF).collect()] == ["x"]
    sides = {(r.run, r.part): set(r.loads) for r in fits[0]["rows"].groupBy("run", "part").agg(F.collect_set(F.col("key") % 4).alias("loads")).collect()}
    assert sides == {(f"A3|load {k} left out", part): ({k} if part == "test" else {0, 1, 2, 3} - {k}) for k in range(4) for part in ("train", "test")}
    assert len(fits) == 1 and fits[0]["rounds"] == 100
    fits.clear()
    QUERIES["rf_importance"](spark, SF)
    QUERIES["rf_split_comparison"](spark, SF)
    assert [(x["trees"], x["depth"]) for x in fits] == [(100, 20)] * 2


def test_models_end_and_split_all_rows(spark, duck):
    """The three model queries with their own settings; sizes as SQL counts them."""
    import time

    total, files = duck.sql("SELECT count(*), count(DISTINCT vec_id // 5) FROM embeddings WHERE label IS NOT NULL").fetchall()[0]
    in_test = duck.sql(
        "SELECT count(*) FROM embeddings JOIN (SELECT f, row_number() OVER (ORDER BY md5('42|' || f), f) AS r FROM (SELECT DISTINCT vec_id // 5 AS f FROM embeddings WHERE label IS NOT NULL)) ON f = vec_id // 5 "
        f"WHERE label IS NOT NULL AND r <= greatest(floor({files} * 0.3), 1)"
    ).fetchall()[0][0]
    began = time.monotonic()
    got = {r.name: r for r in QUERIES["rf_split_comparison"](spark, SF).collect()}
    assert got["random"].n_test == total * 3 // 10 and got["random"].n_train == total - got["random"].n_test
    assert got["file"].n_test == in_test and got["file"].n_train == total - in_test
    by_load = dict(duck.sql("SELECT vec_id % 4, count(*) FROM embeddings WHERE label IS NOT NULL GROUP BY 1").fetchall())
    runs = sorted(QUERIES["mlp_lolo"](spark, SF).collect(), key=lambda r: r.name)
    assert [r.n_test for r in runs] == [by_load[k] for k in range(4)] and [r.n_train for r in runs] == [total - by_load[k] for k in range(4)]
    assert all(0 <= r.acc <= 1 and 0 <= r.f1 <= 1 for r in runs)
    top = QUERIES["rf_importance"](spark, SF).collect()
    assert len(top) == 10 and sum(r.importance for r in top) <= 1 + 1e-9
    assert time.monotonic() - began < 200
