import numpy as np
import pytest
from pyspark.sql import functions as F

from oscilla.operators import experiments, forests


def test_grown_as_by_recursion():
    """Nodes, shares and gains as a plain search over all features and borders finds them."""
    rng = np.random.default_rng(1)
    b, y, w = rng.integers(0, 6, (80, 3)).astype(np.uint8), rng.integers(0, 3, 80), rng.integers(1, 4, 80)
    gain = np.zeros(3)

    def gini(rows):
        n = np.bincount(y[rows], w[rows], 3)
        return (n * n).sum() / max(n.sum(), 1)

    def tree(rows, depth):
        share = np.bincount(y[rows], w[rows], 3)
        share = tuple(np.round(share / share.sum(), 9))
        found = [(gini(rows[b[rows, f] <= e]) + gini(rows[b[rows, f] > e]) - gini(rows), -f, -e) for f in range(3) for e in range(6)]
        best = max(x[0] for x in found)
        if not depth or best < 1e-9:
            return share
        f, e = next((-f, -e) for g, f, e in found if g > best - 1e-9)
        gain[f] += best
        return share, f, e, tree(rows[b[rows, f] <= e], depth - 1), tree(rows[b[rows, f] > e], depth - 1)

    feature, edge, left, share, made = forests.grown(b, y, w, 3, 3, 7, rng)

    def read(k):
        own = tuple(np.round(share[k], 9))
        return own if feature[k] < 0 else (own, feature[k], edge[k], read(left[k]), read(left[k] + 1))

    assert read(0) == tree(np.arange(80), 7)
    np.testing.assert_allclose(made, gain)


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.range(3000).select("id", F.rand(1).alias("a.b"), F.rand(2).alias("b"), F.rand(3).alias("noise"))
    return df.withColumn("y", F.when(F.col("noise") < 0.05, 2).otherwise((F.col("`a.b`") + F.col("b") > 1).cast("int"))).repartition(3, "id").localCheckpoint()


def test_the_size_of_groups_changes_nothing(spark, rows):
    """Split by histograms of all tasks or in a group, a tree is the same: one that looks at all features, so that no draw differs."""
    names = ["a.b", "b", "noise"]
    whole, divided = (forests.fit(rows, names, "y", trees=1, depth=9, group_rows=n) for n in (10_000, 150))
    assert len(whole.uppers[0].feature) == 1 and len(divided.uppers[0].feature) > 20 and divided.parts.count() > 10
    # no group was given more rows than it takes, and none of the upper nodes is on the driver below that size
    assert all(sum(w) > 150 for w, left in zip(divided.uppers[0].weights, divided.uppers[0].left, strict=True) if left)
    np.testing.assert_allclose(whole.importances, divided.importances, atol=1e-12)
    a, b = ({r.id: (r.prediction, [round(p, 9) for p in r.probability]) for r in forests.predicted(m, rows, names).collect()} for m in (whole, divided))
    assert len(a) == 3000 and a == b


def test_forest_learns_and_is_read_again(spark, rows, tmp_path):
    names = ["a.b", "b", "noise"]
    train, test = rows.filter("id % 3 > 0"), rows.filter("id % 3 = 0")
    model = forests.fit(train, names, "y", trees=20, group_rows=200)
    assert experiments.score(model, test, names, "y").first().accuracy > 0.93
    assert abs(sum(model.importances) - 1) < 1e-9 and max(model.importances) < 0.6
    model.save(str(tmp_path / "m"))
    again = forests.load(spark, str(tmp_path / "m"))
    assert sorted(forests.predicted(again, test, names).select("id", "prediction").collect()) == sorted(forests.predicted(model, test, names).select("id", "prediction").collect())


def test_bags_are_poisson():
    n = np.concatenate([forests.copies(np.arange(50_000), tree, 42) for tree in range(3)])
    assert abs(n.mean() - 1) < 0.02 and abs(n.var() - 1) < 0.03 and abs((n == 0).mean() - np.exp(-1)) < 0.01


def test_unusable_rows_and_none(spark):
    rows = spark.createDataFrame([(k, float(k % 2), k % 2) for k in range(60)] + [(100, None, 0), (101, float("nan"), 1), (102, 1.0, None)], "id int, x double, y int")
    model = forests.fit(rows, ["x"], "y", trees=5)
    got = {r.id: r.prediction for r in forests.predicted(model, rows, ["x"]).collect()}
    assert len(got) == 61 and all(got[k] == k % 2 for k in range(60)) and got[102] == 1
    assert forests.predicted(model, rows.filter("false"), ["x"]).count() == 0
    with pytest.raises(ValueError):
        forests.fit(rows.withColumn("y", F.lit(-1)), ["x"], "y", trees=1)


def test_the_driver_holds_no_grown_nodes(spark):
    """Labels that can't be learned make trees as large as their table; what the driver holds doesn't grow with them."""
    rows = spark.range(4000).select("id", F.rand(1).alias("a"), F.rand(2).alias("b"), (F.rand(3) * 4).cast("int").alias("y"))
    model = forests.fit(rows, ["a", "b"], "y", trees=10)
    assert sum(len(u.feature) for u in model.uppers) == 10
    assert model.parts.agg(F.sum(F.size("feature"))).first()[0] > 10_000


def test_jobs_do_not_follow_the_depth(spark):
    """A node that a group holds is grown there to its end; no level of it is a job of its own."""
    rows = spark.range(2000).select("id", F.rand(1).alias("a"), F.rand(2).alias("b"), (F.rand(3) * 4).cast("int").alias("y")).localCheckpoint()
    jobs = []
    for depth in (2, 20):
        spark.sparkContext.setJobGroup(f"forest-{depth}", "")
        experiments.importances(spark, experiments.forest(rows, ["a", "b"], "y", trees=5, depth=depth), ["a", "b"]).collect()
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"forest-{depth}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] == jobs[1] > 0


def test_sums_of_all_bins_and_of_sorted_rows_agree(monkeypatch):
    """However a level's bins are added up, the tree is the same to the last bit; levels of large nodes aren't sorted."""
    rng = np.random.default_rng(3)
    b, y, w = rng.integers(0, 32, (3000, 6)).astype(np.uint8), rng.integers(0, 4, 3000), rng.integers(1, 4, 3000)
    plain, made, rows_sorted = np.argsort, [], []

    def counted(x, **kw):
        rows_sorted[-1] += len(x)
        return plain(x, **kw)

    monkeypatch.setattr(np, "argsort", counted)
    for cells in (0, forests.CELLS_A_ROW, 10_000):
        monkeypatch.setattr(forests, "CELLS_A_ROW", cells)
        rows_sorted.append(0)
        made.append(forests.grown(b, y, w, 4, 3, 12, np.random.default_rng(7)))
    assert all(np.array_equal(x, z) for other in made[1:] for x, z in zip(made[0], other, strict=True))
    assert rows_sorted[0] > 2 * rows_sorted[1] and rows_sorted[2] == 0


def test_a_pass_follows_only_ways_to_the_nodes_it_splits():
    """A row that leaves them goes no further, so that late passes, for few nodes, don't walk every tree to its ends."""
    upper = forests.Upper()
    upper.add(0, [])
    for k in range(7):  # three full levels, each by a feature of its own
        upper.feature[k], upper.edge[k], upper.left[k] = upper.depth[k], 1, len(upper.feature)
        for _ in range(2):
            upper.add(upper.depth[k] + 1, [])
    b = np.array([[x, y, z] for x in (0, 3) for y in (0, 3) for z in (0, 3)], np.uint8)
    assert forests.reached(b, *upper.arrays()).tolist() == [7, 8, 9, 10, 11, 12, 13, 14]
    assert forests.reached(b, *forests.towards(upper, {8: 0})).tolist() == [7, 8, 4, 4, 2, 2, 2, 2]
