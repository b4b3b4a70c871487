import numpy as np
import pytest
from conftest_llm import rows_of

from oscilla.llm import metric
from oscilla.llm.common import least_of_components


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").selectExpr("*", "1 AS id", "2 AS n", "3 AS kind", "4 AS cell")


def want(x, labels, least=0.98):
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = (u @ u.T >= least) & (labels[:, None] == labels[None])
    np.fill_diagonal(near, False)
    root = np.arange(len(x))
    i, j = np.nonzero(near)
    if len(i):
        ids, to = least_of_components(i, j)
        root[ids] = to
    return {k: (int(near[k].sum()), int(root[k]), bool(root[k] == k)) for k in range(len(x))}


def clusters(seed, n=500, dim=16):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((40, dim))
    x = centres[rng.integers(0, 40, n)]
    x = x + rng.standard_normal((n, dim)) * 0.03 * np.linalg.norm(x, axis=1)[:, None] * rng.choice([0, 1, 2], n)[:, None]
    return x * rng.uniform(0.1, 10, n)[:, None], rng.integers(0, 2, n)


@pytest.mark.parametrize("settings", [{}, {"cell_rows": 30, "block": 16}, {"cell_rows": 100, "block": 4096}, {"cell_rows": 10, "pivots": 4}])
def test_against_brute_force(spark, monkeypatch, settings):
    monkeypatch.setattr(metric, "SHUFFLED", 1e12)  # any saving is worth it
    monkeypatch.setattr(metric, "GROUP_BYTES", 20_000)  # several tasks a cell
    levels = []
    real = metric.divided
    monkeypatch.setattr(metric, "divided", lambda *a: levels.append(real(*a)) or levels[-1])
    x, labels = clusters(1)
    x = np.vstack([x, x[:50]])  # equal vectors
    labels = np.concatenate([labels, labels[:50]])
    got = metric.near_vectors(frame(spark, [(k, v.tolist(), int(c)) for k, (v, c) in enumerate(zip(x, labels, strict=True))]), **settings)
    full = want(x, labels)
    assert sum(v[0] for v in full.values()) > 1000
    assert rows_of(got) == {k: v[:2] for k, v in full.items()}
    assert levels[0][1] >= 4  # both labels, at any settings
    assert "pivots" not in settings or len(levels) > 2  # parts are divided again


def test_pivots_replicate_less_than_all():
    x, _ = clusters(2, 2000, 32)
    u = metric.units(x)
    pivots = u[:40]
    home, present = metric.cells_of(u, pivots, float(np.sqrt(0.04)))
    near = u @ u.T >= 0.98
    assert all(present[j, home[i]] for i, j in zip(*np.nonzero(near), strict=True))  # a home cell has all partners
    assert present.sum() < 0.5 * present.size


def test_unusable_vectors_link_with_nothing(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, [1.0, 0.0], None), (4, None, 0), (5, [0.0, 0.0], 0), (6, [nan, 1.0], 0), (7, [inf, 1.0], 0), (8, [1.0, None], 0), (9, [], 0), (10, [1.0, 0.0, 0.0], 0), (11, [1.0, 0.0], 1), (12, [-1.0, 0.0], 0), (None, [1.0, 0.0], 0), (13, [1e200, 1e180], 0), (2, [0.0, 5.0], 0), (14, [0.0, 1.0], 0)]
    got = metric.op6(frame(spark, rows))
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"] and got.count() == len(rows)
    by = {(r.vec_id, r.n_links, r.component_id, r.kept) for r in got.collect()}
    assert {(1, 2, 1, True), (2, 2, 1, False), (13, 2, 1, False), (2, 1, 1, False), (14, 1, 1, False), (12, 0, 12, True), (11, 0, 11, True), (None, 0, None, True)} <= by
    assert all((k, 0, k, True) in by for k in (3, 4, 5, 6, 7, 8, 9, 10))
    assert metric.op6(frame(spark, rows).filter("false")).count() == 0


def test_query_divides_cells_at_its_own_settings(spark, monkeypatch):
    """Labels as text; one larger than a cell, with clusters: the query's own path, pivots and all."""
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((30, 64))
    x = centres[rng.integers(0, 30, 5200)] + rng.standard_normal((5200, 64)) * rng.choice([0.02, 0.1], 5200)[:, None]
    labels = np.where(np.arange(5200) % 13 == 0, 1, 0)
    made = []
    real = metric.divided
    monkeypatch.setattr(metric, "divided", lambda *a: made.append(real(*a)) or made[-1])
    names = ["2:64:a", "64:a"]
    rows = spark.createDataFrame([(k, v.tolist(), names[c]) for k, (v, c) in enumerate(zip(x, labels, strict=True))], "vec_id bigint, embedding array<double>, label string")
    assert rows_of(metric.op6(rows)) == want(x, labels)
    assert made[0][1] >= 4
    placed = made[-1][0].df
    assert placed.groupBy("kind").agg({"id": "count"}).count() == 2 and placed.select("cell").distinct().count() >= 4
    assert placed.count() < 8 * 5200


def test_unlike_vectors_are_not_divided(spark):
    rng = np.random.default_rng(7)
    x = rng.standard_normal((2600, 64))
    u = metric.units(x)
    assert metric.gain(u[:1000], np.ones(1000, bool), metric.chosen_pivots(u[:1000], 16, 0.2), 0.2, 2600)[0] < 0


def test_labels_may_be_text(spark):
    """Labels that look like a part of one another, and nulls."""
    x = [1.0, 2.0, 3.0]
    rows = [(1, x, "a"), (2, x, "a"), (3, x, "3:a"), (4, x, ""), (5, x, ""), (6, x, None), (7, x, None), (8, x, "3"), (9, [*x, 0.0], "a")]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label string").selectExpr("*", "1 AS id", "'q' AS kind")
    got = rows_of(metric.op6(df))
    assert {k: v[:2] for k, v in got.items()} == {1: (1, 1), 2: (1, 1), 3: (0, 3), 4: (1, 4), 5: (1, 4), 6: (0, 6), 7: (0, 7), 8: (0, 8), 9: (0, 9)}
