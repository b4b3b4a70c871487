"""Relational summaries of manifests and features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import selection


def counts_by(df: DataFrame, *keys: str) -> DataFrame:
    """Rows by key; rows with a null key don't count."""
    return df.dropna(subset=list(keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def pivot_counts(df: DataFrame, row: str, column: str, values: list, counted: str, prefix: str = "load_") -> DataFrame:
    """Counts of counted by row and column, a column a value, 0 where there is none."""
    cells = (F.count(F.when(F.col(column) == v, F.col(counted))).cast("long").alias(f"{prefix}{v}") for v in values)
    return df.filter(F.col(row).isNotNull() & F.col(column).isNotNull()).groupBy(row).agg(*cells)


def imbalance(counts: DataFrame, limit: float = 1.5) -> DataFrame:
    """Of (key, n): most, least, their ratio, and whether it is above limit."""
    ratio = F.try_divide(F.max("n"), F.min("n"))
    return counts.agg(F.max("n").alias("most"), F.min("n").alias("least"), ratio.alias("ratio"), (ratio > limit).alias("imbalanced"))


def share(flag: Column, total: Column | None = None) -> Column:
    """Percent of rows with the flag; 0 without rows."""
    return 100.0 * F.count_if(flag) / F.greatest(F.count(F.lit(1)), F.lit(1))


def boxplot(df: DataFrame, by: str, value: str, accuracy: int | None = None) -> DataFrame:
    """Quartiles (interpolated), whiskers (the furthest values within 1.5 quartile ranges) and mean by group.

    Exact quartiles are selected by refining histograms (``selection``), so no task holds a
    group's values. With accuracy, they come from a sketch instead, with a rank error of
    1 / accuracy, in one pass.
    """
    clean = df.select(by, value).filter(F.col(value).isNotNull() & ~F.isnan(value) & F.col(by).isNotNull())
    if accuracy is None:
        q = selection.quantiles(clean, by, value, [0.25, 0.5, 0.75])
    else:
        q = clean.groupBy(by).agg(F.percentile_approx(value, [0.25, 0.5, 0.75], accuracy).alias("q"), F.count(F.lit(1)).alias("n"))
    q = q.select(by, "n", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    reach = (F.col("q3") - F.col("q1")) * 1.5
    v = F.col(value)
    within = (v >= F.col("q1") - reach) & (v <= F.col("q3") + reach)
    rest = clean.join(q.select(by, "q1", "q3"), by).groupBy(by).agg(F.avg(value).alias("mean"), F.min(F.when(within, v)).alias("low"), F.max(F.when(within, v)).alias("high"))
    return q.join(rest, by).filter("low is not null").select(by, "n", "mean", "q1", "median", "q3", "low", "high")


def representatives(df: DataFrame, by: str, load: str, preferred: int, order: str) -> DataFrame:
    """One row a class: the first with the preferred load, else the first. An aggregate: classes aren't sorted."""
    later = F.struct((~F.coalesce(F.col(load) == preferred, F.lit(False))).alias("other"), F.col(order).alias("order"))
    rows = df.filter(F.col(by).isNotNull())
    return rows.groupBy(by).agg(F.min_by(F.struct("*"), later).alias("row")).select("row.*")


def pick_file(df: DataFrame, label: str, load: int, mils: int | None = None, order: str = "path") -> DataFrame:
    """The first matching row in path order; an error at once if none matches, for which one job looks."""
    rows = df.filter((F.col("label") == label) & (F.col("load_hp") == load))
    if mils is not None:
        rows = rows.filter(F.col("fault_diameter_mils") == mils)
    found = rows.orderBy(order).limit(1)
    if found.isEmpty():
        raise LookupError(f"no recording of {label} at load {load}")
    return found


def top(df: DataFrame, by: str, k: int, tie: str) -> DataFrame:
    return df.orderBy(F.desc(by), tie).limit(k)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; null if both are empty."""
    return F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def jaccard_pairs(sets: DataFrame, key: str, members: str) -> DataFrame:
    """(left, right, jaccard) of every pair of rows; for a few named sets, as folds or features are."""
    a = sets.select(F.col(key).alias("left"), F.col(members).alias("_a"))
    b = sets.select(F.col(key).alias("right"), F.col(members).alias("_b"))
    return a.join(b, F.col("left") < F.col("right")).select("left", "right", jaccard(F.col("_a"), F.col("_b")).alias("jaccard"))


def percent_text(value: Column) -> Column:
    """A share as percent with two decimals at most, as text."""
    return F.concat(F.round(value * 100, 2).cast("string"), F.lit("%"))
