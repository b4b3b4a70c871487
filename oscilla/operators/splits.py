"""Train and test splits as a column; orders come from MD5 of seed and key.

A global order is needed only where the number of test rows must be exact. The
split at a rank is then found by an aggregate over leading digits of the hash,
and only the one bucket in which it falls is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shuffled(key: str | Column, seed: int = 42) -> Column:
    key = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(key.cast("string"), F.lit(""))))


def _first(df: DataFrame, key: str, count_of, seed: int) -> DataFrame:
    """df with split: the first count_of(number of rows) rows in shuffled order are test."""
    rows = df.withColumn("_order", shuffled(key, seed)).withColumn("_bucket", F.substring("_order", 1, 3))
    sizes = rows.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_size"))  # at most 4096 rows
    up_to = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sizes = sizes.withColumn("_before", F.sum("_size").over(up_to) - F.col("_size")).withColumn("_test", count_of(F.sum("_size").over(everything)))
    placed = rows.join(F.broadcast(sizes), "_bucket")
    return _split_at(placed, ["_bucket"], key).drop("_order", "_bucket", "_size", "_before", "_test")


def _split_at(placed: DataFrame, bucket: list[str], key: str) -> DataFrame:
    """placed with split: the first _test rows of the order are test. A bucket has _before rows before it and _size of its own; only one that holds the border is ranked."""
    rank = F.row_number().over(Window.partitionBy(*bucket).orderBy("_order", key))
    clear = F.when(F.col("_before") + F.col("_size") <= F.col("_test"), "test").when(F.col("_before") >= F.col("_test"), "train")
    sure = placed.withColumn("split", clear).filter("split is not null")
    edge = placed.filter((F.col("_before") < F.col("_test")) & (F.col("_before") + F.col("_size") > F.col("_test")))
    edge = edge.withColumn("split", F.when(F.col("_before") + rank <= F.col("_test"), "test").otherwise("train"))
    return sure.unionByName(edge)


def random_rows(df: DataFrame, key: str, ratio: float = 0.3, seed: int = 42) -> DataFrame:
    """Leaky on purpose: windows of one recording fall on both sides."""
    return _first(df, key, lambda n: F.floor(n * ratio), seed)


def by_file(df: DataFrame, file: str, ratio: float = 0.3, seed: int = 42) -> DataFrame:
    """Whole files; at least one is test. The file list joins back by key, so it may be of any size."""
    files = _first(df.select(file).distinct(), file, lambda n: F.greatest(F.floor(n * ratio), F.lit(1)), seed)
    return df.join(files, file)


def stratified_files(files: DataFrame, label: str, load: str, file: str, train: float = 0.7, validation: float = 0.15, seed: int = 42) -> DataFrame:
    """train, val, test by label and load; small groups keep a file for each as far as they go."""
    group = Window.partitionBy(label, load)
    n = F.count(F.lit(1)).over(group)
    rank = F.row_number().over(group.orderBy(shuffled(file, seed), file))
    a = F.greatest(F.lit(1), F.bround(n * train).cast("int"))
    b = F.greatest(F.lit(1), F.bround(n * validation).cast("int"))
    short = a + b >= n
    a, b = F.when(short, F.greatest(F.lit(1), n - 2)).otherwise(a), F.when(short, 1).otherwise(b)
    return files.withColumn("split", F.when(rank <= a, "train").when(rank <= a + b, "val").otherwise("test"))


def stratified_rows(df: DataFrame, label: str, key: str, ratio: float = 0.2, seed: int = 42) -> DataFrame:
    """The share of each label goes to test.

    Only the bucket of the shuffled order in which a label's last test row falls is ranked.
    """
    rows = df.withColumn("_order", shuffled(key, seed)).withColumn("_bucket", F.substring("_order", 1, 3))
    sizes = rows.groupBy(label, "_bucket").agg(F.count(F.lit(1)).alias("_size"))
    by_label = Window.partitionBy(label)
    sizes = sizes.withColumn("_before", F.sum("_size").over(by_label.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_size"))
    sizes = sizes.withColumn("_test", F.round(F.sum("_size").over(by_label) * ratio)).withColumnsRenamed({label: "_label", "_bucket": "_b"})
    placed = rows.join(sizes, F.col(label).eqNullSafe(F.col("_label")) & (F.col("_bucket") == F.col("_b")))
    return _split_at(placed, ["_label", "_bucket"], key).drop("_order", "_bucket", "_size", "_before", "_test", "_label", "_b")


def leave_one_load_out(df: DataFrame, load: str, held: int) -> DataFrame:
    return df.withColumn("split", F.when(F.col(load) == held, "test").otherwise("train"))


def folds(loads: DataFrame, load: str = "load") -> DataFrame:
    """(test_load, trainval_loads) of every load; the others sorted."""
    test = loads.select(F.col(load).alias("test_load")).distinct()
    other = loads.select(F.col(load).alias("_other")).distinct()
    pairs = test.join(other, F.col("test_load") != F.col("_other"), "left")
    return pairs.groupBy("test_load").agg(F.array_sort(F.collect_list("_other")).alias("trainval_loads"))


def leaking_files(df: DataFrame, file: str, split: str = "split") -> DataFrame:
    """Files that are on both sides, with their rows on each."""
    sides = df.groupBy(file).agg(F.count_if(F.col(split) == "train").alias("n_train"), F.count_if(F.col(split) == "test").alias("n_test"))
    return sides.filter("n_train > 0 and n_test > 0")
