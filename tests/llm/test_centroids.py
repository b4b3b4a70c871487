import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from oscilla.llm import centroids


def plain_rounds(q, centers, rounds):
    """Lloyd rounds with Python integers; returns clusters, distances and centroids."""
    centers = [list(c) for c in centers]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(centers))

    for _ in range(rounds):
        own = [nearest(v)[1] for v in q]
        for k in range(len(centers)):
            members = [v for v, o in zip(q, own, strict=True) if o == k]
            if members:
                centers[k] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    found = [nearest(v) for v in q]
    return [k for _, k in found], [d for d, _ in found], centers


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(rows, k, rounds):
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of usable rows (vec_id, embedding)."""
    q = [[int(np.floor(1024.0 * x)) for x in v] for _, v in rows]
    order = sorted(range(len(rows)), key=lambda i: (digest(f"3:{'' if rows[i][0] is None else rows[i][0]}"), q[i]))
    cluster, distance, centers = plain_rounds(q, [q[i] for i in order[:k]], rounds)
    inertia = {c: sum(d for d, x in zip(distance, cluster, strict=True) if x == c) for c in cluster}
    return sorted(((i, c, d, inertia[c], sum(distance), digest(",".join(map(str, centers[c])))) for (i, _), c, d in zip(rows, cluster, distance, strict=True)), key=repr)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumns({c: F.lit(1) for c in ("cluster", "q", "label", "distance", "lower", "a.b")})


def clumps(count, clusters, seed, spread=0.2):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(clusters, 64))
    return [(k, (middles[rng.integers(clusters)] + spread * rng.normal(size=64)).tolist()) for k in range(count)]


@pytest.mark.parametrize(("seed", "clusters", "spread"), [(1, 8, 0.1), (2, 3, 0.5), (3, 1, 1.0)])
def test_same_as_plain_rounds(spark, seed, clusters, spread):
    rows = clumps(150, clusters, seed, spread)
    assert sorted((tuple(r) for r in centroids.op13(vectors(spark, rows)).collect()), key=repr) == expected(rows, 8, 10)


def test_ties_repeats_and_what_is_left_out(spark):
    """Coarse vectors tie often; rows with a null id or a repeated one are rows each."""
    rng = np.random.default_rng(4)
    rows = [(int(k), (rng.integers(-1, 2, 64) * (np.arange(64) < 2)).astype(float).tolist()) for k in rng.integers(0, 30, 80)]
    rows += [(None, [0.5] * 64), (None, [-0.5] * 64), (200, [-0.0001] * 64)]
    bad = [(900, None), (901, [1.0] * 63), (902, [1.0] * 65), (903, [float("nan"), *[0.0] * 63]), (904, [None, *[0.0] * 63]), (905, [float("inf"), *[0.0] * 63]), (906, []), (907, [2e5, *[0.0] * 63])]
    got = sorted((tuple(r) for r in centroids.op13(vectors(spark, rows + bad)).collect()), key=repr)
    assert got == expected(rows, 8, 10)


@pytest.mark.parametrize("count", [0, 1, 3])
def test_few_vectors(spark, count):
    rows = clumps(count, 2, 9)
    assert sorted((tuple(r) for r in centroids.op13(vectors(spark, rows)).collect()), key=repr) == expected(rows, 8, 10)


def test_long_components(spark):
    rows = [(k, [(-1.0) ** k * centroids.LIMIT] * 32 + [float(k)] * 32) for k in range(12)]
    assert sorted((tuple(r) for r in centroids.op13(vectors(spark, rows)).collect()), key=repr) == expected(rows, 8, 10)


def test_many_groups_by_bounds_alone():
    """The bounds' pass against all distances, over many rounds, groups and small integers (ties)."""
    rng = np.random.default_rng(6)
    q = rng.integers(-6, 7, (400, 3)).astype(np.int64)
    centers = q[:30].copy()
    groups = centroids.grouped(centers)
    assert groups.max() >= 5
    now, looked = centroids.begin(q, centers, groups), 0
    for _ in range(15):
        after = np.array([q[now.cluster == c].sum(0) // (now.cluster == c).sum() if (now.cluster == c).any() else centers[c] for c in range(30)])
        moved = np.sqrt(((after - centers).astype(float) ** 2).sum(1))
        centers = after
        now = centroids.advance(q, centers, groups, moved, now)
        all_ = ((q[:, None] - centers[None]) ** 2).sum(2)
        assert (now.cluster == all_.argmin(1)).all() and (now.distance == all_.min(1)).all()
        others = np.sqrt(all_.astype(float))
        others[np.arange(len(q)), now.cluster] = np.inf
        for g in range(groups.max() + 1):
            assert (now.lower[:, g] <= others[:, groups == g].min(1) + 1e-6).all()
        looked += now.scanned.sum()
    assert looked < 0.5 * 15 * len(q) * 30


def test_settled_vectors_are_not_looked_at(spark):
    """Well apart, only the first pass looks at all centroids."""
    made = centroids.clustered(vectors(spark, clumps(400, 8, 11, 0.02)), group=2)
    assert made.rows.df.agg(F.sum("scanned")).first()[0] == 0
    made.rows.drop()
