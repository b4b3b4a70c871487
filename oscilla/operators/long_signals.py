"""Recordings longer than a row: samples numbered, put into blocks, and cut into windows, no task holding a recording.

Three forms are used here and in ``long_filters`` and ``long_spectra``:

* samples: (key, i, n, x), a row a sample, i its number in the recording and n the recording's length;
* blocks: (key, n, block, start, end, first, x), x an array that begins with sample ``first``.
  Blocks of ``size`` samples share out a recording; its last block has from ``size`` to
  2 ``size`` - 1 (all, if the recording is shorter), so every edge has enough samples.
  A block may carry samples of its neighbours as well (a halo): ``start`` and ``end``
  bound its own;
* pieces: (key, n, at, x), runs of samples that begin with number ``at``, of any size.

Recordings have keys: samples whose key is null belong to none and are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import staged
from . import feature_tables, framing

#: Samples of a block.
BLOCK = 65_536
#: Samples that the windows of a block may have in all.
WINDOWED = 1 << 22
#: Rows of a broadcast side; larger sides are joined by shuffle.
SMALL = 100_000


def few(df: DataFrame, limit: int = SMALL) -> DataFrame:
    """df, a staged table, with a broadcast hint if it has no more rows than limit."""
    return F.broadcast(df) if df.count() <= limit else df


def numbered(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Samples from rows in any order, numbered by order within their key.

    Rows are dealt out by ranges of (key, order) and numbered within their task; a table
    of one row for each key and task that has rows of it says where each run begins. So
    a recording of any length is numbered by many tasks, where a window function would
    sort it in one.
    """
    rows = rows.select(F.col(key).alias("key"), *(F.col(c).alias(f"o{k}") for k, c in enumerate(order)), F.col(value).cast("double").alias("x")).filter("key is not null")
    by = ["key", *(f"o{k}" for k in range(len(order))), "x"]
    placed = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    placed = staged(placed.select("key", "x", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), "samples-placed")
    runs = placed.groupBy("key", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("count"))
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("key", "part", (F.coalesce(F.sum("count").over(before), F.lit(0)) - F.col("first")).alias("shift"), F.sum("count").over(Window.partitionBy("key")).alias("n"))
    return placed.join(few(staged(runs, "samples-runs")), ["key", "part"]).select("key", (F.col("at") + F.col("shift")).alias("i"), "n", "x")


def _own(i: Column, n: Column, size: int) -> Column:
    """The block of sample i."""
    return F.least(F.floor(i / size), F.greatest(F.floor(n / size) - 1, F.lit(0)))


def _bounded(blocks: DataFrame, size: int) -> DataFrame:
    last = F.col("block") == F.greatest(F.floor(F.col("n") / size) - 1, F.lit(0))
    return blocks.withColumns({"start": F.col("block") * size, "end": F.when(last, F.col("n")).otherwise((F.col("block") + 1) * size)})


_BLOCKS = ("key", "n", "block", "start", "end", "first", "x")


def blocks_of(samples: DataFrame, size: int = BLOCK, before: int = 0, after: int = 0) -> DataFrame:
    """Blocks, with halos of so many samples before and after their own; one shuffle.

    Only the samples of halos are copied, to the blocks they are next to.
    """
    i, n = F.col("i"), F.col("n")
    rows = samples.select("key", "n", "i", "x", F.explode(F.sequence(_own(F.greatest(i - after, F.lit(0)), n, size), _own(F.least(i + before, n - 1), n, size))).alias("block"))
    rows = rows.groupBy("key", "n", "block").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("s"))
    rows = rows.select("key", "n", "block", F.col("s")[0]["i"].alias("first"), F.transform("s", lambda s: s["x"]).alias("x"))
    return _bounded(rows, size).select(*_BLOCKS)


def reblocked(pieces: DataFrame, size: int = BLOCK, before: int = 0, after: int = 0) -> DataFrame:
    """Blocks from pieces, cut where blocks and halos end; one shuffle of arrays."""
    end = F.col("at") + F.size("x")
    first, last = _own(F.greatest(F.col("at") - after, F.lit(0)), F.col("n"), size), _own(F.least(end - 1 + before, F.col("n") - 1), F.col("n"), size)
    rows = pieces.filter(F.size("x") > 0).select("key", "n", "at", "x", F.explode(F.sequence(first, last)).alias("block"))
    rows = _bounded(rows, size)
    low = F.greatest(F.col("start") - before, F.col("at"))
    high = F.least(F.col("end") + after, F.col("at") + F.size("x"))
    rows = rows.withColumns({"low": low, "high": high}).filter("low < high")
    part = F.slice("x", (F.col("low") - F.col("at") + 1).cast("int"), (F.col("high") - F.col("low")).cast("int"))
    rows = rows.groupBy("key", "n", "block").agg(F.array_sort(F.collect_list(F.struct(F.col("low").alias("at"), part.alias("x")))).alias("s"))
    rows = rows.select("key", "n", "block", F.col("s")[0]["at"].alias("first"), F.flatten(F.transform("s", lambda s: s["x"])).alias("x"))
    return _bounded(rows, size).select(*_BLOCKS)


def with_halo(blocks: DataFrame, size: int = BLOCK, before: int = 0, after: int = 0) -> DataFrame:
    """Blocks without halos, such as a filter gives, with halos: each block's edges are copied to its neighbours."""
    return reblocked(blocks.select("key", "n", F.col("start").alias("at"), "x"), size, before, after)


def samples_of(blocks: DataFrame) -> DataFrame:
    """(key, i, x) of the blocks' own samples, a row each."""
    own = F.slice("x", (F.col("start") - F.col("first") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int"))
    return blocks.select("key", "start", F.posexplode(own).alias("p", "x")).select("key", (F.col("start") + F.col("p")).alias("i"), "x")


def block_size(size: int, overlap: float) -> int:
    """A block whose windows have WINDOWED samples at most (one window at least)."""
    step = framing.step_of(size, overlap)
    return max(1, min(BLOCK, step * max(1, WINDOWED // size)))


def _first_window(step: int) -> Column:
    return F.ceil(F.col("start") / step) * step


def _last_window(size: int, inclusive: bool) -> Column:
    """The largest place at which a window that begins in the block may begin."""
    return F.least(F.col("end") - 1, F.col("n") - size - (0 if inclusive else 1))


def frames(blocks: DataFrame, size: int, overlap: float, inclusive: bool, into: str = "window") -> DataFrame:
    """(key, start_idx, window) of blocks with a halo of size samples after them: ``framing.frames`` for long recordings.

    A window belongs to the block in which it begins. Narrow: no shuffle.
    """
    step = framing.step_of(size, overlap)
    first, last = _first_window(step), _last_window(size, inclusive)
    starts = F.when(last >= first, F.sequence(first, last, F.lit(step).cast("long")))
    cut = F.transform(starts, lambda s: F.struct(s.alias("start_idx"), F.slice("x", (s - F.col("first") + 1).cast("int"), F.lit(size)).alias(into)))
    return blocks.select("key", F.inline(cut))


def features(blocks: DataFrame, size: int = 1024, overlap: float = 0.5, demod: str = "hilbert", load: str | None = None, **others) -> DataFrame:
    """The features of the windows of blocks with a halo of size samples, a row a window, computed where the block is.

    With load (a column of blocks) the twenty of ``feature_tables.of_recordings`` with its
    inclusive framing; without, the five of ``simple_of_recordings``, exclusive unless
    inclusive is given. Windows are no rows until they are numbers.
    """
    inclusive = others.pop("inclusive", load is not None)
    step = framing.step_of(size, overlap)
    first, last = _first_window(step), _last_window(size, inclusive)
    # the block from its first window to the end of its last one, as a recording of its own
    whole = F.slice("x", (first - F.col("first") + 1).cast("int"), (last - first + size).cast("int"))
    rows = blocks.filter(last >= first).select("key", first.alias("_from"), *([F.col(load).alias("Load")] if load else []), whole.alias("signal"))
    if load:
        made = feature_tables.of_recordings(rows, "signal", size, overlap, demod, **others)
    else:
        made = feature_tables.simple_of_recordings(rows, "signal", size, overlap, inclusive=True)
    return made.withColumn("start_idx", F.col("_from") + F.col("start_idx")).drop("_from")
