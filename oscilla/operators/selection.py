"""Exact quantiles of groups of any size, by refining histograms.

The values at the wanted ranks are found without sorting or holding a group: a group's
range of values is divided into BINS, the values are counted by bin (partial counts in
the tasks, so at most BINS rows a group and task are shuffled), and of each rank only its
bin is kept, with the least and the largest value in it as the next range. Values outside
the kept ranges are left out when the rest is written for the next round. A range of one
value is an answer; a range that holds several ranks is refined once. A round or two
divide a range of any numbers by their exponents until its ends are within a factor of
WIDE of each other, five or six divide that evenly down to neighbouring doubles; data
with few distinct values take fewer.

Nulls and NaN are no values; infinities count, and are answers where a rank falls on them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import Staged, scratch, staged
from .long_signals import SMALL

BINS = 4096
#: Ranges whose ends are further apart than by this factor are divided by exponents.
WIDE = 65_536.0


def _level(v: Column) -> Column:
    """A number that never decreases with v, by sign and exponent."""
    size = F.log2(F.abs(v)) + 1076
    return F.when(v == 0, 0.0).otherwise(F.signum(v) * size)


def _bin(v: Column, low: Column, high: Column, bins: int) -> Column:
    """The bin of a value of the range; bins never decrease with v, and the ends are in different ones.

    Ranges over zero or many powers of two are divided by exponents, others evenly.
    """
    even = ((low > 0) & (high / WIDE <= low)) | ((high < 0) & (low / WIDE >= high))
    share = F.when(even, F.try_divide(v - low, high - low)).otherwise(F.try_divide(_level(v) - _level(low), _level(high) - _level(low)))
    return F.least(F.floor(share * bins), F.lit(bins - 1))


def at_ranks(values: DataFrame, wanted: DataFrame, bins: int = BINS) -> DataFrame:
    """(g, rank, v) for wanted (g, rank, low, high): the rank-th value (from 0) of the group's finite values (g, v), which lie in low ... high."""
    with scratch(values.sparkSession) as kept:
        done, open_, rest, first = [], wanted.withColumn("within", F.col("rank")), values, True
        while True:
            open_ = staged(open_, "ranks")
            done.append(open_.filter("low = high").select("g", "rank", F.col("low").alias("v")))
            wide = open_.filter("low < high")
            if not (left := wide.count()):
                break
            # ranges of a group don't overlap, so a value is in one of them at most
            ranges = wide.select("g", "low", "high").distinct()
            inside = rest.join(F.broadcast(ranges) if left <= SMALL else ranges, "g").filter((F.col("v") >= F.col("low")) & (F.col("v") <= F.col("high")))
            if not first:
                inside = staged(inside, "values")
            counts = inside.groupBy("g", "low", "high", _bin(F.col("v"), F.col("low"), F.col("high"), bins).alias("bin")).agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("least"), F.max("v").alias("most"))
            up_to = Window.partitionBy("g", "low", "high").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
            counts = counts.withColumn("after", F.sum("c").over(up_to))  # at most BINS rows a range
            found = wide.join(counts, ["g", "low", "high"]).filter((F.col("within") >= F.col("after") - F.col("c")) & (F.col("within") < F.col("after")))
            open_ = found.select("g", "rank", F.col("least").alias("low"), F.col("most").alias("high"), (F.col("within") - (F.col("after") - F.col("c"))).alias("within"))
            rest, first = (values if first else inside.select("g", "v")), False
        result = Staged(reduce(DataFrame.unionByName, done), "ranked")
        kept.append(result)
    return result.df


def quantiles(df: DataFrame, by: str, value: str, shares: list[float], bins: int = BINS) -> DataFrame:
    """(by, n, q): of every group its rows and its quantiles, linearly interpolated, in the order of shares. Groups that are null are left out."""
    v = F.col(value).cast("double")
    rows = df.select(F.col(by).alias("g"), v.alias("v")).filter(v.isNotNull() & ~F.isnan(v) & F.col(by).isNotNull())
    finite = F.abs("v") < float("inf")
    sizes = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("v") == float("-inf")).alias("below"), F.count_if(finite).alias("mid"), F.min(F.when(finite, F.col("v"))).alias("low"), F.max(F.when(finite, F.col("v"))).alias("high"))
    sizes = staged(sizes, "group-sizes")
    place = lambda p: F.lit(float(p)) * (F.col("n") - 1)
    ranks = F.array_distinct(F.array(*(f(place(p)).cast("long") for p in shares for f in (F.floor, F.ceil))))
    wanted = sizes.select("g", "below", "mid", "low", "high", F.explode(ranks).alias("place")).withColumn("rank", F.col("place") - F.col("below"))
    wanted = staged(wanted, "wanted")
    inner = at_ranks(rows.filter(finite), wanted.filter("rank >= 0 and rank < mid").select("g", "rank", "low", "high"), bins)
    outer = wanted.filter("rank < 0 or rank >= mid").select("g", "place", F.when(F.col("rank") < 0, float("-inf")).otherwise(float("inf")).alias("v"))
    found = inner.join(wanted.select("g", "rank", "place"), ["g", "rank"]).select("g", "place", "v").unionByName(outer)
    held = found.groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("place", "v"))).alias("at"))  # two a share

    def quantile(p: float) -> Column:
        low, high = F.floor(place(p)).cast("long"), F.ceil(place(p)).cast("long")
        a, b = F.element_at("at", low), F.element_at("at", high)
        return F.when(a == b, a).otherwise(a + (b - a) * (place(p) - low))

    return sizes.join(held, "g").select(F.col("g").alias(by), "n", F.array(*map(quantile, shares)).alias("q"))
