import pytest
from pyspark.sql import functions as F

from oscilla.operators import experiments, quality, splits, summary


def test_file_split_sizes(spark):
    files = spark.createDataFrame([(f"{n}-{k}", n, 0) for n in (1, 3, 4, 7) for k in range(n)], "f string, label int, load int")
    got = splits.stratified_files(files, "label", "load", "f").groupBy("label").pivot("split", ["train", "val", "test"]).count().na.fill(0).orderBy("label").collect()
    assert [tuple(r) for r in got] == [(1, 1, 0, 0), (3, 1, 1, 1), (4, 2, 1, 1), (7, 5, 1, 1)]


def test_exact_test_sizes_and_no_leak(spark):
    rows = spark.range(1001).select("id", (F.col("id") % 13).alias("f"), (F.col("id") % 3).alias("y"))
    assert splits.random_rows(rows, "id").filter("split = 'test'").count() == 300
    assert splits.leaking_files(splits.random_rows(rows, "id"), "f").count() == 13
    assert splits.leaking_files(splits.by_file(rows, "f"), "f").count() == 0
    assert splits.by_file(rows.filter("f = 1"), "f").filter("split = 'test'").count() == 77  # at least one file is test
    assert splits.random_rows(rows.filter("false"), "id").count() == 0
    holed = rows.select(F.when(F.col("id") > 9, F.col("id")).alias("id"), "y")
    assert splits.random_rows(holed, "id").count() == splits.stratified_rows(holed, "y", "id").count() == 1001


def test_imbalance_and_empty_shares(spark):
    counts = spark.createDataFrame([("a", 30), ("b", 10)], "k string, n bigint")
    assert tuple(summary.imbalance(counts).first()) == (30, 10, 3.0, True)
    assert spark.range(0).agg(summary.share(F.col("id") > 0)).first()[0] == 0


def test_boxplot_by_sketch_is_near(spark):
    rows = spark.range(10_000).select((F.col("id") % 2).alias("g"), F.col("id").cast("double").alias("v")).unionByName(spark.createDataFrame([(0, None), (0, float("nan"))], "g bigint, v double"))
    exact, near = (summary.boxplot(rows, "g", "v", a).orderBy("g").collect() for a in (None, 10_000))
    assert [r.n for r in exact] == [r.n for r in near] == [5000, 5000]
    assert all(abs(a[k] - b[k]) <= 4 for a, b in zip(exact, near, strict=True) for k in ("q1", "median", "q3", "low", "high"))


def test_jaccard_of_empty_sets_is_null(spark):
    sets = spark.createDataFrame([(1, ["a", "b"]), (2, ["b", "c"]), (3, [])], "k int, m array<string>")
    got = {(r.left, r.right): r.jaccard for r in summary.jaccard_pairs(sets, "k", "m").collect()}
    assert got == {(1, 2): pytest.approx(1 / 3), (1, 3): 0, (2, 3): 0}


def test_missing_pick_is_an_error(spark):
    rows = spark.createDataFrame([("IR", 1, 7, "a")], "label string, load_hp int, fault_diameter_mils int, path string")
    assert summary.pick_file(rows, "IR", 1, 7).count() == 1
    with pytest.raises(LookupError):
        summary.pick_file(rows, "IR", 2)


def test_macro_f1_counts_labels_of_both_sides(spark):
    pairs = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 1), (2, 3)], "t int, p int")
    row = experiments.accuracy_macro_f1(pairs, "t", "p").first()
    assert row.accuracy == 0.6 and row.f1_macro == pytest.approx((2 / 3 + 4 / 5 + 0 + 0) / 4) and row.n == 5


def test_scaling_of_a_constant(spark):
    rows = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "`a.b` double, c double")
    known = experiments.scaling(rows, ["a.b", "c"])
    assert known == {"a.b": (2.0, 1.0), "c": (5.0, 1.0)}


def test_sixteen_runs_in_two_fits(spark, monkeypatch):
    from oscilla.operators import networks

    rows = spark.range(400).select("id", (F.col("id") % 4).cast("int").alias("Label"), (F.col("id") / 4 % 4).cast("int").alias("Load"), F.format_string("f%d", (F.col("id") / 8).cast("int")).alias("Filepath"), (F.col("id") % 4 + F.rand(1) / 4).alias("RMS"), F.rand(2).alias("Amp.x"))
    groups = list(experiments.standard_runs(rows, rows, ["RMS", "Amp.x"], "Label", "Load", "Filepath", "id", (0, 1, 2, 3), best=1))
    parts = [{(r.run, r.part): r["count"] for r in df.groupBy("run", "part").count().collect()} for _, df in groups]
    assert [(name, len({run for run, _ in p})) for (name, _), p in zip(groups, parts, strict=True)] == [("all", 10), ("top 1", 6)]
    assert all(parts[0][f"{s}|load {k} left out", "test"] == 100 and parts[0][f"{s}|load {k} left out", "train"] == 300 for s in ("A3", "B2") for k in range(4))
    assert {size for (size,) in groups[1][1].select(F.size("x")).distinct().collect()} == {1}
    jobs = []
    monkeypatch.setattr(networks, "fit_all", lambda rows, *a, f=networks.fit_all, **k: jobs.append(rows.select("run").distinct().count()) or f(rows, *a, **k))
    results = experiments.standard_experiments(rows, rows, ["RMS", "Amp.x"], "Label", "Load", "Filepath", "id", (0, 1, 2, 3), 4, best=1, rounds=60).collect()
    assert jobs == [10, 6] and len(results) == 16 and all(r.acc > 0.6 and r.n_train > 0 for r in results)
    assert experiments.fold_means(spark.createDataFrame(results, experiments.RESULT)).count() == 7


def test_top_features_by_fold(spark, tmp_path):
    rows = spark.range(200).select("id", (F.col("id") % 2).cast("int").alias("y"), (F.col("id") % 3).cast("int").alias("load"), (F.col("id") % 2 + F.rand(1) / 4).alias("good"), F.rand(2).alias("noise"))
    top = experiments.top_by_fold(rows, ["good", "noise"], "y", "load", (0, 1, 2), 1, trees=5, depth=4)
    assert {tuple(r.features) for r in top.collect()} == {("good",)}
    assert summary.jaccard_pairs(top, "fold", "features").filter("jaccard = 1").count() == 3
    model = experiments.forest(rows, ["good", "noise"], "y", trees=5, depth=4)
    assert experiments.class_scores(model, rows, ["good", "noise"]).filter("argmax <> prediction").count() == 0
    experiments.save(model, str(tmp_path / "m"), ["good", "noise"])
    assert spark.read.json(str(tmp_path / "m-features")).count() == 2


def test_rules_without_samples_are_skipped(spark):
    rows = spark.createDataFrame([(None, None, None, 28, None, None)], "n_samples_DE bigint, load_hp int, label string, fault_diameter_mils int, or_position string, rpm_from_file double")
    assert tuple(quality.flagged(rows).select("warnings", "has_warning").first()) == ("", False)


def test_network_learns_stops_early_and_has_right_gradients():
    import numpy as np

    from oscilla.operators import networks

    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 2))
    y = ((x[:, 0] * x[:, 1]) > 0).astype(int)  # not linear
    made = networks.trained(x[:400], y[:400], x[400:500], y[400:500], 2)
    assert (networks.probabilities(made, x[500:]).argmax(1) == y[500:]).mean() > 0.9
    noise = rng.integers(0, 2, 500)
    stopped = networks.trained(x[:300], noise[:300], x[300:500], noise[300:500], 2, rounds=100)
    longer = networks.trained(x[:300], noise[:300], x[300:500], noise[300:500], 2, rounds=100, patience=1000)
    assert networks.loss(stopped, x[300:500], noise[300:500]) < 0.8
    assert networks.loss(longer, x[300:500], noise[300:500]) <= networks.loss(stopped, x[300:500], noise[300:500])
    layers = networks.first_layers([2, 5, 3], rng)
    labels, masks = rng.integers(0, 3, 7), [rng.integers(0, 2, (7, 5)) * 1.25]

    def cost():
        h = np.maximum(x[:7] @ layers[0][0] + layers[0][1], 0) * masks[0]
        return -np.log(networks.probabilities(layers[1:], h)[np.arange(7), labels]).mean()

    flat = [p for layer in layers for p in layer]
    for p, g in zip(flat, networks.gradients(layers, x[:7], labels, masks), strict=True):
        for at in np.ndindex(p.shape):
            old, step = p[at], 1e-6
            p[at] = old + step
            up = cost()
            p[at] = old - step
            down = cost()
            p[at] = old
            assert abs((up - down) / (2 * step) - g[at]) < 1e-5


def test_network_leaves_out_unusable_rows(spark):
    from oscilla.operators import networks

    rows = spark.createDataFrame([(k, float(k % 2), k % 2) for k in range(60)] + [(100, None, 0), (101, float("nan"), 1), (102, 1.0, None)], "id int, `a.b` double, y int")
    layers = networks.fit(rows, ["a.b"], "y", F.col("id") > 49, "id", 2, rounds=60)
    got = networks.predicted(rows.filter("id < 110"), layers, ["a.b"], "y")
    assert got.count() == 61 and got.filter("y = prediction").count() == 60
    assert networks.predicted(rows.filter("false"), networks.fit(rows.filter("false"), ["a.b"], "y", F.lit(False), "id", 2), ["a.b"], "y").count() == 0


def _numbered_runs(spark, seed=7):
    """Rows of two runs of different widths, some held back."""
    import numpy as np

    rng = np.random.default_rng(seed)
    rows = []
    for run, width, count in (("a", 3, 240), ("b", 2, 160)):
        x = rng.normal(size=(count, width))
        rows += [(run, k, k % 5 == 0, int(v[0] + v[1] > 0), v.tolist()) for k, v in enumerate(x)]
    return spark.createDataFrame(rows, "run string, key bigint, held boolean, y int, x array<double>")


def test_one_lane_is_the_sequential_fit(spark):
    import numpy as np

    from oscilla.operators import networks

    rows = _numbered_runs(spark)
    fitted = networks.fit_all(rows, 2, hidden=(8,), rounds=12, patience=3)
    lanes, runs = networks.lanes_of(rows)
    assert runs == {"a": (3, 1), "b": (2, 1)} and lanes.df.count() == 2
    # by rounds, a job each, it is the same fit
    by_rounds = {run: networks.fresh(width, 2, (8,), 42) for run, (width, _) in runs.items()}
    for turn in range(2):
        for r in networks.a_round(lanes.df, by_rounds, 42, turn, True):
            by_rounds[r.run].unpacked(np.array(r.numbers) / r.rows)
    for r in lanes.df.collect():
        sides = [(np.array(x).reshape(-1, runs[r.run][0]), np.array(y, int)) for x, y in ((r.train_x, r.train_y), (r.test_x, r.test_y))]
        two = networks.trained(*sides[0], np.zeros((0, 1)), np.zeros(0), 2, hidden=(8,), rounds=2, run=r.run)
        assert all(np.allclose(w, v, atol=1e-9) and np.allclose(b, c, atol=1e-9) for (w, b), (v, c) in zip(two, by_rounds[r.run].layers, strict=True))
        want = networks.trained(*sides[0], *sides[1], 2, hidden=(8,), rounds=12, patience=3, run=r.run)
        for (w, b), (v, c) in zip(want, fitted[r.run], strict=True):
            np.testing.assert_allclose(w, v, atol=1e-9)
            np.testing.assert_allclose(b, c, atol=1e-9)
    lanes.drop()


def test_lanes_are_averaged_whatever_the_tasks(spark):
    """Several lanes learn as well, and one task gives what four give."""
    import numpy as np

    from oscilla.operators import networks

    rows, made = _numbered_runs(spark), []
    for tasks in (1, 4):
        spark.conf.set("spark.sql.shuffle.partitions", tasks)
        made.append(networks.fit_all(rows.coalesce(tasks), 2, hidden=(8,), rounds=10, lane_values=300))
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    lanes, runs = networks.lanes_of(rows, 300)
    assert runs == {"a": (3, 3), "b": (2, 2)} and lanes.df.count() == 5
    lanes.drop()
    for run in ("a", "b"):
        for (w, b), (v, c) in zip(made[0][run], made[1][run], strict=True):
            np.testing.assert_allclose(w, v, atol=1e-9)
            np.testing.assert_allclose(b, c, atol=1e-9)
    for run, (width, _) in runs.items():
        x, y = (np.array(v) for v in zip(*((r.x, r.y) for r in rows.filter(F.col("run") == run).collect()), strict=True))
        assert networks.loss(made[0][run], x, y) < 0.97 * networks.loss(networks.fresh(width, 2, (8,), 42).layers, x, y)


def test_scaling_by_run(spark):
    rows = spark.createDataFrame([("a", True, [1.0, 5.0]), ("a", True, [3.0, 5.0]), ("a", False, [2.0, 6.0]), ("b", True, [10.0]), ("b", None, [12.0]), ("c", False, [4.0])], "run string, held boolean, x array<double>")
    got = sorted((r.run, r.x) for r in experiments.scaled_by_run(rows, F.col("held")).collect())
    assert got == [("a", [-1.0, 0.0]), ("a", [0.0, 1.0]), ("a", [1.0, 0.0]), ("b", [0.0]), ("b", [2.0]), ("c", [4.0])]


def test_scratch_tables_go(spark):
    from pathlib import Path

    from oscilla.staging import Staged, scratch, staged

    with scratch(spark) as kept:
        gone = Staged(spark.range(3), "gone")
        here = Staged(gone.df, "here")
        with scratch(spark) as inner:
            inner.append(Staged(spark.range(4), "inner"))
        kept.append(here)
        path = Path(inner[0].path.removeprefix("file://"))
        assert path.exists()
    assert not path.exists() and not Path(gone.path.removeprefix("file://")).exists()
    assert here.df.count() == 3 and staged(here.df, "again").count() == 3


def test_messages_hold_the_values(spark):
    rows = spark.createDataFrame([(480000, 0, "OR", 28, None, 1700.0)], "n_samples_DE bigint, load_hp int, label string, fault_diameter_mils int, or_position string, rpm_from_file double")
    said = quality.flagged(rows).first().messages.split("; ")
    assert [x.split(":")[0] for x in said] == quality.flagged(rows).first().codes
    assert "n_samples=480000 -> 40.0s" in said[0] and "(1700)" in said[1] and "0HP (1797)" in said[1] and "28 mils" in said[2]
