"""Statistics of array-valued signals, as built-in expressions.

``with_statistics`` adds one struct that two passes over the array fill; all
features are arithmetic over it. Moments are those of the population. A constant
or empty signal has null skewness and kurtosis.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import EPS
from .batches import row_sizes, stacked

_SUMS = ("m2", "m3", "m4", "absolute", "squares", "peak", "c_absolute", "c_peak")


def rounded(c: Column, digits: int = 6) -> Column:
    """c to so many decimals, without negative zero."""
    r = F.round(c, digits)
    return F.when(r == 0, F.lit(0.0)).otherwise(r)


def mean_of(signal: str | Column) -> Column:
    total = F.aggregate(signal, F.lit(0.0), lambda a, v: a + v)
    return F.try_divide(total, F.size(signal).cast("double"))


def centered(signal: str, mean: str | Column) -> Column:
    m = F.col(mean) if isinstance(mean, str) else mean
    return F.transform(signal, lambda v: v - m)


def with_statistics(df: DataFrame, signal: str = "x", into: str = "stats") -> DataFrame:
    """df with a struct column: n, mean and the sums of _SUMS (c_: about the mean)."""
    mean = F.col("_mean")

    def add(a: Column, v: Column) -> Column:
        d = v - mean
        return F.struct(
            (a["m2"] + d * d).alias("m2"),
            (a["m3"] + d * d * d).alias("m3"),
            (a["m4"] + d * d * d * d).alias("m4"),
            (a["absolute"] + F.abs(v)).alias("absolute"),
            (a["squares"] + v * v).alias("squares"),
            F.greatest(a["peak"], F.abs(v)).alias("peak"),
            (a["c_absolute"] + F.abs(d)).alias("c_absolute"),
            F.greatest(a["c_peak"], F.abs(d)).alias("c_peak"),
        )

    zero = F.struct(*(F.lit(0.0).alias(k) for k in _SUMS))
    summed = df.withColumn("_mean", mean_of(signal)).withColumn("_sums", F.aggregate(signal, zero, add))
    return summed.withColumn(into, F.struct(F.size(signal).cast("double").alias("n"), F.col("_mean").alias("mean"), "_sums.*")).drop("_mean", "_sums")


def _sums(x: np.ndarray) -> list[np.ndarray]:
    """n, mean and _SUMS of the rows of x."""
    n, mean = np.full(len(x), float(x.shape[1])), x.mean(1)
    c = x - mean[:, None]
    c2 = c * c
    return [n, mean, c2.sum(1), (c2 * c).sum(1), (c2 * c2).sum(1), np.abs(x).sum(1), (x * x).sum(1), np.abs(x).max(1), np.abs(c).sum(1), np.abs(c).max(1)]


def _statistics(column: pa.Array) -> pa.Array:
    names = ["n", "mean", *_SUMS]
    out = np.zeros((len(names), len(column)))
    sizes = row_sizes(column)
    for rows, x in stacked(column, sizes):
        out[:, rows] = _sums(x)
    empty = sizes <= 0
    fields = [pa.array(v, mask=empty if k == "mean" else sizes < 0) for k, v in zip(names, out, strict=True)]
    return pa.StructArray.from_arrays(fields, names=names)


_statistics.__annotations__ = {"column": pa.Array, "return": pa.Array}


def with_fast_statistics(df: DataFrame, signal: str = "x", into: str = "stats") -> DataFrame:
    """with_statistics by an Arrow function: for long windows, where interpreted array lambdas take most of the time."""
    kind = "struct<" + ", ".join(f"{k}: double" for k in ("n", "mean", *_SUMS)) + ">"
    return df.withColumn(into, F.arrow_udf(_statistics, kind)(F.col(signal)))


def skewness(s: Column) -> Column:
    return F.try_divide(F.sqrt(s["n"]) * s["m3"], F.pow(s["m2"], 1.5))


def pearson_kurtosis(s: Column) -> Column:
    return F.try_divide(s["n"] * s["m4"], s["m2"] * s["m2"])


def windowed_features(s: Column) -> dict[str, Column]:
    """The six of a window whose mean was removed; epsilon in the denominators."""
    rms = F.sqrt(F.try_divide(s["m2"], s["n"]))
    return {
        "RMS": rms,
        "Peak": s["c_peak"],
        "Kurtosis": pearson_kurtosis(s),
        "Skewness": skewness(s),
        "Crest_Factor": s["c_peak"] / (rms + EPS),
        "Shape_Factor": rms / (F.try_divide(s["c_absolute"], s["n"]) + EPS),
    }


def simple_features(s: Column) -> dict[str, Column]:
    """The five of a window as it is; excess kurtosis."""
    return {
        "rms": F.sqrt(F.try_divide(s["squares"], s["n"])),
        "kurtosis": pearson_kurtosis(s) - 3,
        "skewness": skewness(s),
        "peak": s["peak"],
        "std": F.sqrt(F.try_divide(s["m2"], s["n"])),
    }


def recording_features(s: Column) -> dict[str, Column]:
    """The nine of a whole recording; crest and shape are null unless rms and mean size are positive."""
    rms = F.sqrt(F.try_divide(s["squares"], s["n"]))
    size = F.try_divide(s["absolute"], s["n"])
    return {
        "mean": s["mean"],
        "std": F.sqrt(F.try_divide(s["m2"], s["n"])),
        "rms": rms,
        "peak": s["peak"],
        "kurtosis": pearson_kurtosis(s) - 3,
        "skewness": skewness(s),
        "crest_factor": F.when(rms > 0, F.try_divide(s["peak"], rms)),
        "shape_factor": F.when(size > 0, F.try_divide(rms, size)),
        "n_samples": s["n"].cast("long"),
    }


def long_form_features(rows: DataFrame, key: str, value: str) -> DataFrame:
    """recording_features over rows (key, value), a sample a row: partial aggregates, no array is built."""
    v = F.col(value).cast("double")
    sums = rows.groupBy(key).agg(
        F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.sqrt(F.avg(v * v)).alias("rms"), F.max(F.abs(v)).alias("peak"),
        F.kurtosis(v).alias("kurtosis"), F.skewness(v).alias("skewness"), F.avg(F.abs(v)).alias("_size"), F.count(v).alias("n_samples"),
    )
    crest = F.when(F.col("rms") > 0, F.try_divide("peak", "rms"))
    shape = F.when(F.col("_size") > 0, F.try_divide("rms", "_size"))
    return sums.select(key, "mean", "std", "rms", "peak", "kurtosis", "skewness", crest.alias("crest_factor"), shape.alias("shape_factor"), "n_samples")
