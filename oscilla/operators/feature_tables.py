"""The feature tables: five simple features of a window, and the twenty of a window with its labels."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from ..config import BAND_EDGES, EPS, FAULT_MULTIPLIERS, FS, TOLERANCE_HZ
from ..functions import spectral
from ..functions.batches import SAMPLES, row_sizes, stacked
from ..functions.kinematics import fault_multiples, rpm_of
from ..functions.statistics import simple_features, with_fast_statistics
from . import framing

ENERGIES = [f"Energy_{a}_{b}Hz" for a, b in zip(BAND_EDGES, BAND_EDGES[1:], strict=False)]
AMPLITUDES = [f"Amp_{k}" for k in FAULT_MULTIPLIERS]
ENVELOPES = [f"Env_Amp_{k}" for k in FAULT_MULTIPLIERS]
TIMES = ["RMS", "Peak", "Kurtosis", "Skewness", "Crest_Factor", "Shape_Factor"]
FEATURES = [*TIMES, *ENERGIES, *AMPLITUDES, *ENVELOPES]
SIMPLE = ["rms", "kurtosis", "skewness", "peak", "std"]


def simple_table(windows: DataFrame, window: str = "window") -> DataFrame:
    """windows with rms, kurtosis, skewness, peak, std, and without the window."""
    return with_fast_statistics(windows, window).withColumns(simple_features(F.col("stats"))).drop("stats", window)


def _six(c: np.ndarray) -> np.ndarray:
    """The time features of rows whose mean was removed, a row a feature; nan where there is none."""
    c2, size, n = c * c, np.abs(c), c.shape[1]
    m2 = c2.sum(1)
    rms, peak = np.sqrt(m2 / n), size.max(1)
    with np.errstate(divide="ignore", invalid="ignore"):
        out = np.array([rms, peak, n * (c2 * c2).sum(1) / (m2 * m2), np.sqrt(n) * (c2 * c).sum(1) / m2**1.5, peak / (rms + EPS), rms / (size.mean(1) + EPS)])
    return np.where(np.isfinite(out), out, np.nan)


def _twenty(x: np.ndarray, hz: np.ndarray, demod: str, fs: float, tolerance: float) -> np.ndarray:
    """FEATURES of the rows of x, a row a feature; hz: the fault frequencies of each row."""
    c = x - x.mean(1, keepdims=True)
    return np.vstack([_six(c), *(v.T for v in spectral.spectral_amounts(c, hz, fs, BAND_EDGES, tolerance, demod))])


def _five(x: np.ndarray) -> np.ndarray:
    """SIMPLE of the rows of x, a row a feature."""
    six = _six(x - x.mean(1, keepdims=True))
    return np.array([np.sqrt((x * x).mean(1)), six[2] - 3, six[3], np.abs(x).max(1), six[0]])


def _fields(values: np.ndarray, names: list[str]) -> pa.StructArray:
    return pa.StructArray.from_arrays([pa.array(v, mask=np.isnan(v)) for v in values], names=names)


def _struct(names: list[str]) -> StructType:
    return StructType([StructField(k, DoubleType()) for k in names])


def _arrow(f: Callable, arguments: int, kind) -> Callable:
    f.__annotations__ = {**dict.fromkeys(f.__code__.co_varnames[:arguments], pa.Array), "return": pa.Array}
    return F.arrow_udf(f, kind)


def _of_windows(signals: pa.Array, names: list[str], size: int, overlap: float, inclusive: bool, compute: Callable[[np.ndarray, int], np.ndarray]) -> pa.Array:
    """For each signal the list of its windows: start_idx and what compute makes of them (matrix, row of the signal)."""
    step, starts, values = framing.step_of(size, overlap), [], []
    sizes = row_sizes(signals)
    for k, n in enumerate(sizes):
        first = np.arange(0, n - size + (1 if inclusive else 0), step) if n >= size else np.zeros(0, np.int64)
        starts.append(first)
        if len(first):
            x = signals[k].values.cast(pa.float64()).to_numpy(zero_copy_only=False)
            views = np.lib.stride_tricks.sliding_window_view(x, size)
            few = max(1, SAMPLES // size)
            values += [compute(views[first[j : j + few]], k) for j in range(0, len(first), few)]
    at = pa.array(np.cumsum([0, *map(len, starts)]).astype(np.int32))
    made = np.hstack(values) if values else np.zeros((len(names), 0))
    flat = pa.StructArray.from_arrays([pa.array(np.concatenate(starts).astype(np.int32)), *_fields(made, names).flatten()], names=["start_idx", *names])
    return pa.ListArray.from_arrays(at, flat)


def _windowed(recordings: DataFrame, signal: str, names: list[str], f: Callable, arguments: list[Column]) -> DataFrame:
    """recordings' other columns with start_idx and names, a row a window. Windows are never rows themselves: neither
    they nor copies of the signal leave the function that cuts them."""
    kept = [F.col(f"`{c}`") for c in recordings.columns if c != signal]
    kind = ArrayType(StructType([StructField("start_idx", IntegerType()), *_struct(names).fields]))
    made = recordings.select(*kept, F.explode(_arrow(f, len(arguments), kind)(*arguments)).alias("_made"))
    return made.select(*kept, *(F.col("_made").getField(k).alias(k) for k in ("start_idx", *names)))


def full_table(windows: DataFrame, window: str = "window", load: str = "Load", demod: str = "hilbert", fs: float = FS, tolerance: float = TOLERANCE_HZ) -> DataFrame:
    """The twenty features of each window, its mean removed; every other column stays.

    One Arrow function takes a batch of windows to twenty numbers each, so nothing but
    these comes back. Names hold dots: quote them. demod ``none`` gives envelope
    amplitudes of 0; a null or empty window gives nulls; skewness and kurtosis of a
    constant window are null.
    """

    def twenty(x, a, b, c):
        hz = np.stack([v.to_numpy(zero_copy_only=False) for v in (a, b, c)], 1)
        out = np.full((len(FEATURES), len(x)), np.nan)
        for rows, matrix in stacked(x, row_sizes(x)):
            out[:, rows] = _twenty(matrix, hz[rows], demod, fs, tolerance)
        return _fields(out, FEATURES)

    kept = [F.col(f"`{c}`") for c in windows.columns if c != window]
    hz = fault_multiples(rpm_of(F.col(load)))
    made = windows.select(*kept, _arrow(twenty, 4, _struct(FEATURES))(F.col(window), *hz.values()).alias("_made"))
    return made.select(*kept, *(F.col("_made").getField(k).alias(k) for k in FEATURES))


def of_recordings(recordings: DataFrame, signal: str = "signal", size: int = 1024, overlap: float = 0.5, demod: str = "hilbert", fs: float = FS, tolerance: float = TOLERANCE_HZ) -> DataFrame:
    """Recordings (signal, Load, ...) -> the twenty features of their windows (inclusive framing).

    Recordings without a signal have no windows, as files that can't be read.
    """

    def twenty(x, a, b, c):
        hz = np.stack([v.to_numpy(zero_copy_only=False) for v in (a, b, c)], 1)
        return _of_windows(x, FEATURES, size, overlap, True, lambda m, k: _twenty(m, np.repeat(hz[k : k + 1], len(m), 0), demod, fs, tolerance))

    return _windowed(recordings, signal, FEATURES, twenty, [F.col(signal), *fault_multiples(rpm_of(F.col("Load"))).values()])


def simple_of_recordings(recordings: DataFrame, signal: str = "signal", size: int = 2048, overlap: float = 0.75, inclusive: bool = False) -> DataFrame:
    """Recordings -> the five features of their windows (exclusive framing, unless inclusive)."""

    def five(x):
        return _of_windows(x, SIMPLE, size, overlap, inclusive, lambda m, _: _five(m))

    return _windowed(recordings, signal, SIMPLE, five, [F.col(signal)])
