"""Metrics, scaling, models and the experiment runner.

Fits read their rows many times: pass them tables that are written (``staging.staged``)
or cheap to read. What is split here is written first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import staged
from . import forests, networks, splits

RESULT = "stage string, name string, features string, acc double, f1 double, n_train bigint, n_test bigint"


def accuracy_macro_f1(pairs: DataFrame, truth: str, predicted: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(accuracy, f1_macro, n), of each group of by: F1 without weights over all labels that occur on either side, 0 where it has no base."""
    cells = pairs.groupBy(*by, F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    hit = F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)
    sides = cells.select(*by, F.col("t").alias("label"), hit.alias("hit"), F.col("n").alias("true"), F.lit(0).alias("said")).unionByName(
        cells.select(*by, F.col("p").alias("label"), F.lit(0).alias("hit"), F.lit(0).alias("true"), F.col("n").alias("said"))
    )
    by_label = sides.groupBy(*by, "label").agg(F.sum("hit").alias("hit"), F.sum("true").alias("true"), F.sum("said").alias("said"))
    f1 = 2.0 * F.col("hit") / (F.col("true") + F.col("said"))
    return by_label.groupBy(*by).agg((F.sum("hit") / F.sum("true")).alias("accuracy"), F.avg(f1).alias("f1_macro"), F.sum("true").cast("long").alias("n"))


def scaling(train: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of each column, a deviation of 0 as 1; one pass."""
    row = train.agg(*(f(F.col(f"`{c}`")).alias(f"{n}{k}") for k, c in enumerate(columns) for n, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    return {c: (row[f"m{k}"] or 0.0, row[f"s{k}"] or 1.0) for k, c in enumerate(columns)}


def scaled(df: DataFrame, known: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (F.col(f"`{c}`") - m) / s for c, (m, s) in known.items()})


def forest(train: DataFrame, columns: list[str], label: str, seed: int = 42, trees: int = 100, depth: int = 20) -> forests.Forest:
    return forests.fit(train, columns, label, seed, trees, depth)


def importances(spark: SparkSession, model, columns: list[str], k: int | None = None) -> DataFrame:
    """(feature, importance), the largest first."""
    rows = spark.createDataFrame([(c, float(v)) for c, v in zip(columns, model.importances, strict=True)], "feature string, importance double")
    ordered = rows.orderBy(F.desc("importance"), "feature")
    return ordered.limit(k) if k else ordered


def score(model, test: DataFrame, columns: list[str], label: str) -> DataFrame:
    """accuracy_macro_f1 of the model on test."""
    return accuracy_macro_f1(forests.predicted(model, test, columns).select(F.col(label).cast("double").alias("y"), "prediction"), "y", "prediction")


def class_scores(model, df: DataFrame, columns: list[str]) -> DataFrame:
    """df with the class of the largest score, the first of equal ones."""
    return forests.predicted(model, df, columns).withColumn("argmax", F.array_position("probability", F.array_max("probability")) - 1)


def scaled_by_run(rows: DataFrame, learned_from: Column) -> DataFrame:
    """rows (run, x ...) with x scaled by the mean and population deviation of each run's rows with learned_from; one pass."""
    width = rows.agg(F.max(F.size("x"))).first()[0] or 0
    value = lambda k: F.when(learned_from, F.get("x", F.lit(k)))
    pairs = [F.struct(F.coalesce(F.avg(value(k)), F.lit(0.0)).alias("m"), F.coalesce(F.nullif(F.stddev_pop(value(k)), F.lit(0.0)), F.lit(1.0)).alias("s")) for k in range(width)]
    known = rows.groupBy("run").agg(F.array(*pairs).alias("_known"))  # a row a run
    return rows.join(F.broadcast(known), "run").withColumn("x", F.transform("x", lambda v, k: (v - F.get("_known", k)["m"]) / F.get("_known", k)["s"])).drop("_known")


def train_and_score_runs(rows: DataFrame, classes: int, rounds: int = 100, seed: int = 42) -> DataFrame:
    """(run, accuracy, f1_macro, n_train, n_test) of all runs in rows (run, part: train or test, key, y, x), trained together.

    15 percent of a run's training rows are held back by label to stop its fit; scaling is
    learned from the others. Rows with a null label or a null or non-finite number in x take no part.
    """
    usable = F.col("y").isNotNull() & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = staged(rows.select("run", "part", "key", F.col("y").cast("int").alias("y"), F.col("x").cast("array<double>").alias("x")).filter(F.coalesce(usable, F.lit(False))), "runs")
    train = rows.filter("part = 'train'").withColumn("stratum", F.struct("run", "y"))
    train = splits.stratified_rows(train, "stratum", "key", 0.15, seed).select("run", "key", "y", "x", (F.col("split") == "test").alias("held"))
    test = rows.filter("part = 'test'").select("run", "key", "y", "x", F.lit(None).cast("boolean").alias("held"))
    ready = staged(scaled_by_run(train.unionByName(test), ~F.col("held")), "runs-scaled")
    fitted = networks.fit_all(ready.filter("held is not null"), classes, rounds=rounds, seed=seed)
    scores = accuracy_macro_f1(networks.predicted_by_run(ready.filter("held is null"), fitted), "y", "prediction", ("run",))
    sizes = ready.groupBy("run").agg(F.count("held").alias("n_train"))
    return scores.join(sizes, "run").select("run", "accuracy", "f1_macro", "n_train", F.col("n").alias("n_test"))


def run_rows(df: DataFrame, run: str | Column, part: Column, columns: list[str], label: str, key: str) -> DataFrame:
    """Rows of df for ``train_and_score_runs``; those whose part is null are in neither."""
    x = F.array(*(F.col(f"`{c}`").cast("double") for c in columns))
    run = F.lit(run) if isinstance(run, str) else run
    return df.select(run.alias("run"), part.alias("part"), F.col(key).alias("key"), F.col(label).alias("y"), x.alias("x")).filter("part is not null")


def loads_left_out(df: DataFrame, stage: str, columns: list[str], label: str, load: str, key: str, loads: Iterable[int]) -> DataFrame:
    """The rows of one run for each load, named stage|load k left out: each row once a run. Rows without a load are in none."""
    held = F.explode(F.array(*(F.lit(k) for k in loads))).alias("_held")
    each = df.filter(F.col(load).isNotNull()).select("*", held)
    run = F.concat(F.lit(f"{stage}|load "), F.col("_held").cast("string"), F.lit(" left out"))
    return run_rows(each, run, F.when(F.col(load) == F.col("_held"), "test").otherwise("train"), columns, label, key)


def results_of(scores: DataFrame, features: Column) -> DataFrame:
    """RESULT rows of scores (run as stage|name ...)."""
    stage, name = (F.split("run", r"\|")[k] for k in (0, 1))
    return scores.select(stage.alias("stage"), name.alias("name"), features.alias("features"), F.col("accuracy").alias("acc"), F.col("f1_macro").alias("f1"), "n_train", "n_test")


def train_and_score_perceptron(train: DataFrame, test: DataFrame, columns: list[str], label: str, classes: int, key: str, rounds: int = 100) -> DataFrame:
    """(accuracy, f1_macro, n_train, n) of one run."""
    sides = [run_rows(df, "", F.lit(part), columns, label, key) for df, part in ((train, "train"), (test, "test"))]
    return train_and_score_runs(sides[0].unionByName(sides[1]), classes, rounds).select("accuracy", "f1_macro", "n_train", F.col("n_test").alias("n"))


def compare_splits(features: DataFrame, columns: list[str], label: str, key: str, file: str, seed: int = 42, trees: int = 100, depth: int = 20) -> DataFrame:
    """A forest on a random and on a file split: name, accuracy, f1_macro, n_train, n_test."""
    features = staged(features.select(key, file, label, *(F.col(f"`{c}`") for c in columns)), "split-features")
    out = None
    for name, split in (("random", splits.random_rows(features, key, seed=seed)), ("file", splits.by_file(features, file, seed=seed))):
        split = staged(split, f"split-{name}")
        train, test = split.filter("split = 'train'"), split.filter("split = 'test'")
        model = forest(train, columns, label, seed, trees, depth)
        row = score(model, test, columns, label).select(F.lit(name).alias("name"), "accuracy", "f1_macro", F.lit(train.count()).cast("long").alias("n_train"), F.col("n").alias("n_test"))
        out = row if out is None else out.unionByName(row)
    return out


def top_by_fold(features: DataFrame, columns: list[str], label: str, load: str, loads: Iterable[int], k: int, trees: int = 100, depth: int = 20) -> DataFrame:
    """(fold, features): the k most important features of each fold's forest; one ranking, nothing is eliminated by steps."""
    spark, rows = features.sparkSession, []
    for held in loads:
        model = forest(features.filter(F.col(load) != held), columns, label, trees=trees, depth=depth)
        rows.append((held, [r.feature for r in importances(spark, model, columns, k).collect()]))
    return spark.createDataFrame(rows, "fold int, features array<string>")


def run_experiments(spark: SparkSession, plan: Iterable[tuple[str, str, str, Callable[[], DataFrame]]]) -> DataFrame:
    """One row an experiment: plan gives stage, name, features and what makes its (accuracy, f1_macro, n)."""
    out = spark.createDataFrame([], RESULT)
    for stage, name, features, make in plan:
        row = make()
        n_train = F.col("n_train") if "n_train" in row.columns else F.lit(None)
        out = out.unionByName(row.select(F.lit(stage).alias("stage"), F.lit(name).alias("name"), F.lit(features).alias("features"), F.col("accuracy").alias("acc"), F.col("f1_macro").alias("f1"), n_train.cast("long").alias("n_train"), F.col("n").alias("n_test")))
    return out


def fold_means(results: DataFrame) -> DataFrame:
    """Mean accuracy and mean macro F1, each of its own, over the folds of a stage."""
    return results.groupBy("stage", "features").agg(F.avg("acc").alias("acc"), F.avg("f1").alias("f1"), F.count(F.lit(1)).alias("folds"))


def standard_runs(hilbert: DataFrame, square_law: DataFrame, columns: list[str], label: str, load: str, file: str, key: str, loads: Iterable[int], best: int = 30) -> Iterator[tuple[str, DataFrame]]:
    """The sixteen runs in two groups of rows, each with the name of its features. On Hilbert features: A1 random rows,
    A2 random files, A3 each load left out. On square-law features: B2 each load left out; then with the best features of
    a forest over all rows, C3 each load left out, D1 random rows, D2 random files (the validation files stay out)."""
    loads = list(loads)

    def by_rows(df: DataFrame, stage: str, names: list[str]) -> DataFrame:
        return run_rows(splits.stratified_rows(df, label, key), f"{stage}|random rows", F.col("split"), names, label, key)

    def by_files(df: DataFrame, stage: str, names: list[str]) -> DataFrame:
        kinds = splits.stratified_files(df.select(file, label, load).distinct(), label, load, file).select(file, "split")
        return run_rows(df.join(kinds, file), f"{stage}|random files", F.when(F.col("split") != "val", F.col("split")), names, label, key)

    def by_load(df: DataFrame, stage: str, names: list[str]) -> DataFrame:
        return loads_left_out(df, stage, names, label, load, key, loads)

    first = by_rows(hilbert, "A1", columns), by_files(hilbert, "A2", columns), by_load(hilbert, "A3", columns), by_load(square_law, "B2", columns)
    yield "all", reduce(DataFrame.unionByName, first)
    top = [r.feature for r in importances(square_law.sparkSession, forest(square_law, columns, label), columns, best).collect()]
    second = by_load(square_law, "C3", top), by_rows(square_law, "D1", top), by_files(square_law, "D2", top)
    yield f"top {best}", reduce(DataFrame.unionByName, second)


def standard_experiments(hilbert: DataFrame, square_law: DataFrame, columns: list[str], label: str, load: str, file: str, key: str, loads: Iterable[int], classes: int, best: int = 30, rounds: int = 100) -> DataFrame:
    """The results of the sixteen runs: those of a group are trained together."""
    groups = standard_runs(hilbert, square_law, columns, label, load, file, key, loads, best)
    return reduce(DataFrame.unionByName, [results_of(staged(train_and_score_runs(rows, classes, rounds), "run-scores"), F.lit(features)) for features, rows in groups])


def save(model, path: str, columns: list[str]) -> None:
    """The model, and beside it the list of its features."""
    model.save(path)
    SparkSession.active().createDataFrame([(k, c) for k, c in enumerate(columns)], "place int, feature string").coalesce(1).write.mode("overwrite").json(f"{path}-features")
