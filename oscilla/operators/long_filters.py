"""Zero-phase filters over recordings in blocks: a prefix scan of filter states.

A recursive filter takes a block and the state before it to outputs and the state after
it, and both are affine in the state: the state after block k is M s + e, with M a power
of the filter's own matrix (its exponent the block's length) and e what the block gives
from rest. So one pass computes e of every block, a scan along each recording gives
every block its start state, and a second pass filters the blocks, all independently.
The backward half of a zero-phase filter does the same from the end.

The scan itself goes in two levels: GROUP neighbouring blocks are composed into one
affine map in a task, the maps of a recording are scanned (a row for each GROUP blocks),
and the states within groups follow. So the one task that sees a whole recording sees a
row of a few numbers for each GROUP * BLOCK samples.

Recordings no longer than the filter's padding have no output, as elsewhere.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from ..config import FS
from ..functions import filters
from ..staging import staged
from .long_signals import BLOCK, few

#: Blocks whose maps are composed in one task.
GROUP = 1024


@lru_cache(64)
def cascade(made: filters.Filter) -> tuple[np.ndarray, np.ndarray]:
    """The matrix of all sections' states together, and the state in which a constant input of one stays as it is."""
    step, drive, seen, through, steady, scale = np.zeros((0, 0)), np.zeros(0), np.zeros(0), 1.0, [], 1.0
    for b, a in made.sections:
        own, push = filters.state_matrices(b, a)
        n = len(push)
        look = np.eye(n)[0]
        # what goes into this section is what the sections before it show of their states
        step = np.block([[step, np.zeros((len(step), n))], [np.outer(push, seen), own]])
        drive, seen = np.concatenate([drive, push * through]), np.concatenate([b[0] / a[0] * seen, look])
        through *= b[0] / a[0]
        steady.append(filters.steady_state(b, a) * scale)
        scale *= sum(b) / sum(a)
    return step, np.concatenate(steady)


@lru_cache(256)
def over(made: filters.Filter, length: int) -> np.ndarray:
    """What the state before length samples contributes to the one after them."""
    return np.linalg.matrix_power(cascade(made)[0], length)


def run(made: filters.Filter, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One signal through all sections: outputs and the state after it."""
    y, at, ends = x[None, :], 0, []
    for b, a in made.sections:
        n = max(len(a), len(b)) - 1
        y, end = filters.run_on(b, a, y, state[None, at : at + n])
        ends.append(end[0])
        at += n
    return y[0], np.concatenate(ends)


def _lists(rows: list[np.ndarray]) -> pa.Array:
    at = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([np.zeros(0), *rows])))


def _signal(column: pa.Array, k: int) -> np.ndarray:
    return column[k].values.to_numpy(zero_copy_only=False).astype(float)


def _schema(df: DataFrame, *fields: StructField) -> StructType:
    return StructType([StructField("key", df.schema["key"].dataType), StructField("turn", LongType()), *fields])


def _numbers(name: str) -> StructField:
    return StructField(name, ArrayType(DoubleType()))


def start_states(ends: DataFrame, made: filters.Filter, group: int = GROUP) -> DataFrame:
    """(key, turn, state): the state before each block. ends: key, turn (0, 1, ... in the filter's direction), size, x0 (the first block's first sample), e."""
    width = len(cascade(made)[1])
    ends = ends.withColumn("g", F.floor(F.col("turn") / group))

    def compose(_: tuple, part: pa.Table) -> pa.Table:
        part = part.sort_by("turn")
        m, v = np.eye(width), np.zeros(width)
        for size, e in zip(part["size"].to_pylist(), part["e"].to_pylist(), strict=True):
            power = over(made, size)
            m, v = power @ m, power @ v + np.array(e)
        return pa.table([part["key"][:1], part["g"][:1], part["x0"][:1], _lists([m.ravel()]), _lists([v])], names=["key", "turn", "x0", "m", "v"])

    def along(_: tuple, part: pa.Table) -> pa.Table:
        part = part.sort_by("turn")
        state, found = cascade(made)[1] * part["x0"][0].as_py(), []
        for m, v in zip(part["m"].to_pylist(), part["v"].to_pylist(), strict=True):
            found.append(state)
            state = np.array(m).reshape(width, width) @ state + np.array(v)
        return pa.table([part["key"], part["turn"], _lists(found)], names=["key", "turn", "state"])

    def within(_: tuple, part: pa.Table) -> pa.Table:
        part = part.sort_by("turn")
        state, found = np.array(part["begin"][0].as_py()), []
        for size, e in zip(part["size"].to_pylist(), part["e"].to_pylist(), strict=True):
            found.append(state)
            state = over(made, size) @ state + np.array(e)
        return pa.table([part["key"], part["turn"], _lists(found)], names=["key", "turn", "state"])

    maps = ends.groupBy("key", "g").applyInArrow(compose, _schema(ends, StructField("x0", DoubleType()), _numbers("m"), _numbers("v")))
    begins = staged(maps.groupBy("key").applyInArrow(along, _schema(ends, _numbers("state"))), "filter-groups")
    begun = ends.join(few(begins.select("key", F.col("turn").alias("g"), F.col("state").alias("begin"))), ["key", "g"])
    return begun.groupBy("key", "g").applyInArrow(within, _schema(ends, _numbers("state")))


def directed(blocks: DataFrame, made: filters.Filter, backward: bool, name: str, group: int = GROUP) -> DataFrame:
    """Staged blocks (key, n, block, turn, x) through the filter in one direction, from the steady state of the first sample met; staged.

    turn counts blocks in the filter's direction; backward ones are read from their end and
    given out in their own order.
    """
    turned = (lambda x: x[::-1]) if backward else (lambda x: x)
    rest = np.zeros(len(cascade(made)[1]))

    def from_rest(batches):
        for batch in batches:
            x = [turned(_signal(batch.column("x"), k)) for k in range(batch.num_rows)]
            e = _lists([run(made, v, rest)[1] for v in x])
            columns = [batch.column("key"), batch.column("turn"), pa.array([len(v) for v in x], pa.int64()), pa.array([float(v[0]) for v in x], pa.float64()), e]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "turn", "size", "x0", "e"])

    def filtered(batches):
        for batch in batches:
            x = [turned(run(made, turned(_signal(batch.column("x"), k)), _signal(batch.column("state"), k))[0]) for k in range(batch.num_rows)]
            kept = ["key", "n", "block", "turn"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), _lists(x)], names=[*kept, "x"])

    ends = blocks.select("key", "turn", "x").mapInArrow(from_rest, _schema(blocks, StructField("size", LongType()), StructField("x0", DoubleType()), _numbers("e")))
    states = staged(start_states(staged(ends, f"{name}-ends"), made, group), f"{name}-states")
    kept = blocks.select("key", "n", "block", "turn", "x")
    return staged(kept.join(few(states), ["key", "turn"]).select(*kept.columns, "state").mapInArrow(filtered, kept.schema), name)


def zero_phase(blocks: DataFrame, made: filters.Filter, size: int = BLOCK, group: int = GROUP) -> DataFrame:
    """Blocks of size samples (more than the filter's padding; without halos) forward and backward through the filter.

    The recording is extended oddly at either end: its first and its last block have all the
    samples that this needs, and give the extension back in the end.
    """
    pad = made.pad
    if size <= pad:
        raise ValueError(f"blocks of {size} samples are too short for a padding of {pad}")
    last = F.greatest(F.floor(F.col("n") / size) - 1, F.lit(0))
    x, count = F.col("x"), F.size("x")
    left = F.transform(F.sequence(F.lit(pad), F.lit(1), F.lit(-1)), lambda k: 2 * F.get(x, F.lit(0)) - F.get(x, k))
    right = F.transform(F.sequence(F.lit(2), F.lit(pad + 1)), lambda k: 2 * F.get(x, count - 1) - F.get(x, count - k))
    none = F.array().cast("array<double>")
    is_first, is_last = F.col("block") == 0, F.col("block") == last
    extended = F.concat(F.when(is_first, left).otherwise(none), x, F.when(is_last, right).otherwise(none))
    rows = blocks.filter(F.col("n") > pad).select("key", "n", "block", F.col("block").alias("turn"), extended.alias("x"))
    forward = directed(staged(rows, "filter-extended"), made, False, "filter-forward", group)
    found = directed(forward.withColumn("turn", last - F.col("block")), made, True, "filter-backward", group)
    lead, trail = F.when(is_first, pad).otherwise(0), F.when(is_last, pad).otherwise(0)
    start = F.col("block") * size
    own = F.slice("x", lead + 1, F.size("x") - lead - trail)
    return found.select("key", "n", "block", start.alias("start"), F.when(is_last, F.col("n")).otherwise(start + size).alias("end"), start.alias("first"), own.alias("x"))


def bandpass(blocks: DataFrame, fs: float = FS, low: float = 1000.0, high: float = 4000.0, order: int = 4, sections: bool = False, size: int = BLOCK) -> DataFrame:
    return zero_phase(blocks, filters.bandpass(low, high, fs, order, sections), size)


def lowpass(blocks: DataFrame, fs: float = FS, cutoff: float = 500.0, order: int = 2, size: int = BLOCK) -> DataFrame:
    return zero_phase(blocks, filters.lowpass(cutoff, fs, order), size)


def square_law_envelope(blocks: DataFrame, fs: float = FS, low: float = 2000.0, high: float = 5000.0, cutoff: float = 500.0, order: int = 2, sections: bool = True, size: int = BLOCK) -> DataFrame:
    """The low-passed square of the band-passed recordings."""
    squares = bandpass(blocks, fs, low, high, order, sections, size).withColumn("x", F.transform("x", lambda v: v * v))
    return lowpass(squares, fs, cutoff, 2, size)
