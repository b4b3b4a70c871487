"""Sliding windows over array signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def step_of(size: int, overlap: float) -> int:
    return max(int(size * (1 - overlap)), 1)


def frames(df: DataFrame, signal: str, size: int, overlap: float, inclusive: bool, into: str = "window") -> DataFrame:
    """A row a window, with start_idx. inclusive: the window that ends with the signal is one too.

    Narrow: no shuffle. Signals that are too short, or null, have no windows. A row carries
    the signal until its window is cut; for features of long recordings use
    ``feature_tables.of_recordings``, which makes no such rows.
    """
    last = F.size(signal) - size - (0 if inclusive else 1)
    starts = F.when(last >= 0, F.sequence(F.lit(0), last, F.lit(step_of(size, overlap))))
    return df.withColumn("start_idx", F.explode(starts)).withColumn(into, F.slice(signal, F.col("start_idx") + 1, F.lit(size)))


def prefix(signal: str | Column, count: int) -> Column:
    return F.slice(signal, 1, count)


def time_axis(signal: str | Column, fs: float, milliseconds: bool = False) -> Column:
    """(i, t, x) of every sample, as an array of structs; explode it where rows are wanted."""
    unit = 1000.0 if milliseconds else 1.0
    return F.transform(signal, lambda v, i: F.struct(i.alias("i"), (i * unit / fs).alias("t"), v.alias("x")))


def shared_share(size: int, overlap: float) -> float:
    """Share of samples that a window has in common with the next."""
    return max(0, size - step_of(size, overlap)) / size


def adjacent_difference(key: str, feature: str) -> Column:
    """Difference in percent between a window's feature and the next one's."""
    after = F.lead(feature).over(Window.partitionBy(key).orderBy("start_idx"))
    return F.abs(F.col(feature) - after) / (F.abs(feature) + 1e-8) * 100
