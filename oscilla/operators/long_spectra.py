"""Fourier transforms of recordings longer than a row: four steps, with shuffles as the transposes.

A recording of n = n1 n2 samples is a matrix of n1 rows and n2 columns. Its transform is
one of each column, a factor for every cell, and one of each row; what was computed down
the columns is needed along the rows, so the cells change tasks in between. Columns go to
tasks in bundles of about CELLS cells, rows likewise: a task holds that much of a
recording, or one column or row (at most LONGEST cells), however long it is.

Bin k1 + n1 k2 comes out in row k1, which is how a transform back can begin at once, along
the same rows. So the envelope takes three shuffles: columns, rows, columns.

A length without two factors of LONGEST or less (a large prime, say) is computed as a
convolution with a chirp, whose length is a power of two (Bluestein's way). The chirp
depends on the length only and is made in the tasks.

Samples are pieces (see ``long_signals``); recordings without samples have no output.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from ..staging import staged

#: Cells of a task's bundle.
CELLS = 1 << 19
#: The longest column or row, which a task holds whole.
LONGEST = 1 << 21


@lru_cache(4096)
def factors(n: int) -> tuple[int, int]:
    """n1 <= n2 with n1 n2 = n, as near each other as can be."""
    n1 = next(k for k in range(int(n**0.5) + 1, 0, -1) if n % k == 0 and k * k <= n)
    return n1, n // n1


def length_of(n: int, longest: int = LONGEST) -> int:
    """The length of the transform for n samples: n, or that of a convolution."""
    return n if factors(n)[1] <= longest else 1 << (2 * n - 2).bit_length()


def phases(k: np.ndarray, n: int) -> np.ndarray:
    """exp(-i pi k^2 / n); squares are exact modulo 2 n, for n below 2**41."""
    k = k % (2 * n)
    high, low = k >> 21, k & ((1 << 21) - 1)
    turns = ((k * high % (2 * n) << 21) % (2 * n) + k * low % (2 * n)) % (2 * n)
    return np.exp(-1j * np.pi * turns / n)


def chirp(k: np.ndarray, n: int, m: int) -> np.ndarray:
    """Cells k of the chirp that is convolved, m long and closed to a ring."""
    away = np.minimum(k, m - k)
    return np.where(away < n, phases(away, n).conj(), 0)


def analytic(k: np.ndarray, n: int) -> np.ndarray:
    """By what bin k is multiplied for the analytic signal."""
    return np.where((k == 0) | (2 * k == n), 1.0, np.where(2 * k < n, 2.0, 0.0))


def _between(rows: np.ndarray, columns: np.ndarray, total: int, sign: int) -> np.ndarray:
    """The factors between two steps."""
    return np.exp(sign * 2j * np.pi * (rows[:, None] * columns[None, :]) / total)


def _run_schema(df: DataFrame, *more: StructField) -> StructType:
    """n: samples, m: the transform's length; re, im: cells that begin at place at."""
    longs = [StructField(c, LongType()) for c in ("n", "m")]
    lists = [StructField(c, ArrayType(DoubleType())) for c in ("re", "im")]
    return StructType([StructField("key", df.schema["key"].dataType), *longs, *more, StructField("at", LongType()), *lists])


def _runs(key: pa.Array, values: np.ndarray, sizes: np.ndarray, **numbers: np.ndarray | int) -> pa.Table:
    """A table of runs of cells (values in runs of these sizes) with numbers of their own; key has one of them, or one a run."""
    count = len(sizes)
    at = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    lists = {c: pa.ListArray.from_arrays(at, pa.array(np.ascontiguousarray(v))) for c, v in (("re", values.real), ("im", values.imag))}
    keys = key if len(key) == count else key.slice(0, 1).take(pa.array(np.zeros(count, np.int64)))
    longs = {c: pa.array(np.broadcast_to(v, count).astype(np.int64)) for c, v in numbers.items()}
    return pa.table({"key": keys, **longs, **lists})


def _cells(part: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The cells of all runs in one array, and the runs' sizes."""
    re, im = (part[c].combine_chunks() for c in ("re", "im"))
    flat = re.flatten().to_numpy(zero_copy_only=False) + 1j * im.flatten().to_numpy(zero_copy_only=False)
    return flat, re.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)


def _one(part: pa.Table) -> tuple[int, int, int, int, int, pa.Array]:
    n, m, bundle = (part[c][0].as_py() for c in ("n", "m", "bundle"))
    return n, m, *factors(m), bundle, part["key"].combine_chunks()


_BUNDLE = (StructField("bundle", LongType()), StructField("tag", LongType()))


def _scattered(runs: DataFrame, cells: int) -> DataFrame:
    """runs (key, n, m, at, re, im) cut to bundles of columns; for a convolution times the phases.

    The run with a recording's first cell also asks for the chirp in every bundle (tag 1, without cells).
    """
    schema = _run_schema(runs, *_BUNDLE)

    def one(row: pa.RecordBatch) -> Iterator[pa.Table]:
        n, m, at = (row.column(c)[0].as_py() for c in ("n", "m", "at"))
        values, _ = _cells(pa.Table.from_batches([row]))
        n2 = factors(m)[1]
        width = max(1, cells // factors(m)[0])
        if m != n:
            values = values * phases(at + np.arange(len(values)), n)
        lines = np.arange(at // n2, (at + len(values) - 1) // n2 + 1)
        edges = (lines[:, None] * n2 + np.arange(0, n2, width)[None, :]).ravel()
        edges = np.concatenate([[at], edges[(edges > at) & (edges < at + len(values))], [at + len(values)]])
        yield _runs(row.column("key"), values, np.diff(edges), n=n, m=m, bundle=edges[:-1] % n2 // width, tag=0, at=edges[:-1])
        if m != n and at == 0:
            every = np.arange(-(-n2 // width))
            yield _runs(row.column("key"), np.zeros(0, complex), np.zeros(len(every), int), n=n, m=m, bundle=every, tag=1, at=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                for table in one(batch.slice(k, 1)):
                    yield from table.select(schema.names).to_batches()

    return runs.filter(F.size("re") > 0).select("key", "n", "m", "at", "re", "im").mapInArrow(run, schema)


def _handed_on(key: pa.Array, n: int, m: int, tag: int, matrix: np.ndarray, first: int, height: int) -> pa.Table:
    """The rows of a matrix in bundles of height rows; first: the number of its first column."""
    rows, columns = matrix.shape
    sizes = np.diff(np.append(np.arange(0, rows, height), rows)) * columns
    return _runs(key, matrix.ravel(), sizes, n=n, m=m, bundle=np.arange(len(sizes)), tag=tag, at=first)


def _gathered(part: pa.Table, tag: int, rows: int, columns: int) -> np.ndarray:
    """A bundle's rows whole, from blocks of columns."""
    part = part.filter(pc.equal(part["tag"], tag))
    flat, sizes = _cells(part)
    out, ends = np.zeros((rows, columns), complex), np.cumsum(sizes)
    for at, size, end in zip(part["at"].to_pylist(), sizes, ends, strict=True):
        out[:, at : at + size // rows] = flat[end - size : end].reshape(rows, -1)
    return out


def _columns(cells: int) -> Callable[[tuple, pa.Table], pa.Table]:
    """First step: transforms of a bundle of columns, times the factors."""

    def run(_: tuple, part: pa.Table) -> pa.Table:
        n, m, n1, n2, bundle, key = _one(part)
        width = max(1, cells // n1)
        columns = np.arange(bundle * width, min((bundle + 1) * width, n2))
        some = part.filter(pc.equal(part["tag"], 0))
        flat, sizes = _cells(some)
        places = np.repeat(some["at"].to_numpy() - np.cumsum(sizes) + sizes, sizes) + np.arange(len(flat))
        matrix = np.zeros((n1, len(columns)), complex)
        matrix[places // n2, places % n2 - columns[0]] = flat
        matrices = [matrix] if m == n else [matrix, chirp(np.arange(n1)[:, None] * n2 + columns[None, :], n, m)]
        factor = _between(np.arange(n1), columns, m, -1)
        return pa.concat_tables(_handed_on(key, n, m, tag, np.fft.fft(x, axis=0) * factor, int(columns[0]), max(1, cells // n2)) for tag, x in enumerate(matrices))

    return run


def _rows(cells: int, then: str) -> Callable[[tuple, pa.Table], pa.Table]:
    """Second step: transforms of a bundle of rows. then: bins gives them out as runs, the others go on with the
    transform back along the rows: convolve after multiplying by the chirp's, analytic by the analytic signal's."""

    def run(_: tuple, part: pa.Table) -> pa.Table:
        n, m, n1, n2, bundle, key = _one(part)
        height = max(1, cells // n2)
        rows = np.arange(bundle * height, min((bundle + 1) * height, n1))
        made = np.fft.fft(_gathered(part, 0, len(rows), n2), axis=1)
        if then == "bins":
            return _runs(key, made.T.ravel(), np.full(n2, len(rows)), n=n, m=m, at=rows[0] + n1 * np.arange(n2))
        made *= np.fft.fft(_gathered(part, 1, len(rows), n2), axis=1) if then == "convolve" else analytic(rows[:, None] + n1 * np.arange(n2)[None, :], n)
        back = np.fft.ifft(made, axis=1) * _between(rows, np.arange(n2), m, 1)
        return _handed_on(key, n, m, 0, back.T, int(rows[0]), max(1, cells // n1))

    return run


def _back(cells: int) -> Callable[[tuple, pa.Table], pa.Table]:
    """Last step of a transform back: runs of cells; those of a convolution times the phases."""

    def run(_: tuple, part: pa.Table) -> pa.Table:
        n, m, n1, n2, bundle, key = _one(part)
        height = max(1, cells // n1)
        columns = np.arange(bundle * height, min((bundle + 1) * height, n2))
        made = np.fft.ifft(_gathered(part, 0, len(columns), n1), axis=1).T
        at = n2 * np.arange(n1) + columns[0]
        if m == n:
            return _runs(key, made.ravel(), np.full(n1, len(columns)), n=n, m=m, at=at)
        places = at[:, None] + np.arange(len(columns))[None, :]
        inside = places < n
        return _runs(key, (made[inside] * phases(places[inside], n)), inside.sum(1), n=n, m=m, at=at)

    return run


def _stepped(runs: DataFrame, cells: int, then: str) -> DataFrame:
    bundled, plain = _run_schema(runs, *_BUNDLE), _run_schema(runs)
    by = ("key", "n", "m", "bundle")

    def grouped(df: DataFrame, f: Callable[[tuple, pa.Table], pa.Table], schema: StructType) -> DataFrame:
        return df.groupBy(*by).applyInArrow(lambda k, part: f(k, part).select(schema.names), schema)

    handed = grouped(_scattered(runs, cells), _columns(cells), bundled)
    if then == "bins":
        return grouped(handed, _rows(cells, then), plain)
    return grouped(grouped(handed, _rows(cells, then), bundled), _back(cells), plain)


def _prepared(pieces: DataFrame, longest: int) -> DataFrame:
    """Pieces as runs, with m; staged, as they are read for either way."""

    def lengths(n: pa.Array) -> pa.Array:
        return pa.array([length_of(v, longest) for v in n.to_pylist()], pa.int64())

    lengths.__annotations__ = {"n": pa.Array, "return": pa.Array}
    m = F.arrow_udf(lengths, "bigint")(F.col("n"))
    return staged(pieces.filter(F.size("x") > 0).select("key", "n", m.alias("m"), F.col("at").cast("long").alias("at"), F.col("x").alias("re"), F.transform("x", lambda _: F.lit(0.0)).alias("im")), "spectra-pieces")


def transform(pieces: DataFrame, longest: int = LONGEST, cells: int = CELLS) -> DataFrame:
    """Runs (key, n, m, at, re, im) of the discrete Fourier transform of every recording: bins at, at + 1, ...

    Two shuffles; three for lengths without fitting factors.
    """
    runs = _prepared(pieces, longest)
    return _stepped(runs.filter("m = n"), cells, "bins").unionByName(_stepped(runs.filter("m <> n"), cells, "convolve").filter(F.size("re") > 0))


def magnitudes(pieces: DataFrame, longest: int = LONGEST, cells: int = CELLS) -> DataFrame:
    """(key, k, mag): the one-sided raw spectrum of every recording (``spectral.raw_spectrum``), a row a bin."""
    runs = transform(pieces, longest, cells).filter(2 * F.col("at") <= F.col("n"))
    sizes = F.transform(F.arrays_zip("re", "im"), lambda z: F.hypot(z["re"], z["im"]))
    return runs.select("key", "n", "at", F.posexplode(sizes).alias("p", "v")).select("key", (F.col("at") + F.col("p")).alias("k"), (F.col("v") / F.col("n")).alias("mag"), "n").filter(2 * F.col("k") <= F.col("n")).drop("n")


def envelope(pieces: DataFrame, longest: int = LONGEST, cells: int = CELLS) -> DataFrame:
    """Pieces (key, n, at, x) of every recording's envelope by the Hilbert transform (``spectral.hilbert_envelope``)."""
    runs = _prepared(pieces, longest)
    straight = _stepped(runs.filter("m = n"), cells, "analytic")
    # by convolution: the transform back is that of the conjugate
    bins = staged(_stepped(runs.filter("m <> n"), cells, "convolve").filter(F.size("re") > 0), "spectra-bins")
    k = lambda i: F.col("at") + i
    weight = lambda i: F.when((k(i) == 0) | (2 * k(i) == F.col("n")), 1.0).when(2 * k(i) < F.col("n"), 2.0).otherwise(0.0)
    weighed = bins.withColumns({"re": F.transform("re", lambda v, i: v * weight(i) / F.col("n")), "im": F.transform("im", lambda v, i: -v * weight(i) / F.col("n"))})
    runs = straight.unionByName(_stepped(weighed, cells, "convolve").filter(F.size("re") > 0))
    return runs.select("key", "n", "at", F.transform(F.arrays_zip("re", "im"), lambda z: F.hypot(z["re"], z["im"])).alias("x"))


def pieces_of(blocks: DataFrame) -> DataFrame:
    """Blocks without halos as pieces."""
    return blocks.select("key", "n", F.col("start").alias("at"), "x")
