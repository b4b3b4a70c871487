"""Spectra, envelopes and filters of array columns: Arrow functions that work on whole batches.

Null signals stay null; what is too short for a filter becomes null.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import filters
from .batches import on_rows


def _udf(f: Callable[[np.ndarray], np.ndarray | None]) -> Callable[[Column], Column]:
    def call(column: pa.Array) -> pa.Array:
        return on_rows(column, f)

    call.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return F.arrow_udf(call, "array<double>")


def _magnitude(x: np.ndarray, hann: bool, scale: float) -> np.ndarray:
    n = x.shape[1]
    window = np.hanning(n) if hann and n > 1 else np.ones(n)
    return np.abs(np.fft.rfft(x * window, axis=1)) * (scale / n)


def _analytic(x: np.ndarray) -> np.ndarray:
    n = x.shape[1]
    h = np.zeros(n)
    h[0] = 1
    h[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        h[n // 2] = 1
    return np.abs(np.fft.ifft(np.fft.fft(x, axis=1) * h, axis=1))


def _zero_phase(made: filters.Filter, x: np.ndarray) -> np.ndarray | None:
    return filters.zero_phase(made, x) if x.shape[1] > made.pad else None


def hann_spectrum(signal: Column) -> Column:
    """Magnitudes of the windowed signal, times 2 / n."""
    return _udf(lambda x: _magnitude(x, True, 2))(signal)


def raw_spectrum(signal: Column) -> Column:
    """Magnitudes of the signal as it is, over n."""
    return _udf(lambda x: _magnitude(x, False, 1))(signal)


def hilbert_envelope(signal: Column) -> Column:
    return _udf(_analytic)(signal)


def bandpass(signal: Column, fs: float, low: float, high: float, order: int = 4, sections: bool = False) -> Column:
    return _udf(lambda x: _zero_phase(filters.bandpass(low, high, fs, order, sections), x))(signal)


def lowpass(signal: Column, fs: float, cutoff: float, order: int = 2) -> Column:
    return _udf(lambda x: _zero_phase(filters.lowpass(cutoff, fs, order), x))(signal)


def bandpassed_hilbert_envelope(signal: Column, fs: float, low: float = 1000.0, high: float = 4000.0) -> Column:
    """The envelope of the band-passed signal (order 4)."""

    def both(x: np.ndarray) -> np.ndarray | None:
        y = _zero_phase(filters.bandpass(low, high, fs, 4, False), x)
        return None if y is None else _analytic(y)

    return _udf(both)(signal)


def square_law_envelope(signal: Column, fs: float, low: float = 1000.0, high: float = 4000.0, cutoff: float = 500.0, order: int = 4, sections: bool = False) -> Column:
    """The low-passed square of the band-passed signal, in one function."""

    def both(x: np.ndarray) -> np.ndarray | None:
        y = _zero_phase(filters.bandpass(low, high, fs, order, sections), x)
        return None if y is None else _zero_phase(filters.lowpass(cutoff, fs, 2), y * y)

    return _udf(both)(signal)


def demodulated(signal: Column, fs: float, demod: str) -> Column:
    """The envelope by name: hilbert, square_law (order 2, 2 to 5 kHz), or none (null)."""
    if demod == "hilbert":
        return hilbert_envelope(signal)
    if demod == "square_law":
        return square_law_envelope(signal, fs, 2000.0, 5000.0, 500.0, 2, True)
    if demod == "none":
        return F.lit(None).cast("array<double>")
    raise ValueError(f"unknown demodulation {demod}")


def _envelope(x: np.ndarray, fs: float, demod: str) -> np.ndarray | None:
    if demod == "none":
        return None
    if demod == "hilbert":
        return _analytic(x)
    if demod != "square_law":
        raise ValueError(f"unknown demodulation {demod}")
    y = _zero_phase(filters.bandpass(2000.0, 5000.0, fs, 2, True), x)
    return None if y is None else _zero_phase(filters.lowpass(500.0, fs, 2), y * y)


def _envelope_magnitude(x: np.ndarray, fs: float, demod: str) -> np.ndarray | None:
    y = _envelope(x, fs, demod)
    return None if y is None else _magnitude(y - y.mean(1, keepdims=True), True, 2)


def envelope_spectrum(signal: Column, fs: float, demod: str = "hilbert") -> Column:
    """The windowed spectrum of the envelope less its mean, in one function."""
    return F.lit(None).cast("array<double>") if demod == "none" else _udf(lambda x: _envelope_magnitude(x, fs, demod))(signal)


def spectral_amounts(x: np.ndarray, hz: np.ndarray, fs: float, edges: tuple[float, ...], tolerance: float, demod: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows x: energies of the half-open bands, and largest magnitudes within tolerance of each frequency
    (rows x frequencies) in the windowed spectrum and in that of the envelope; 0 without a bin or an envelope."""
    bins = np.arange(x.shape[1] // 2 + 1) * float(fs) / x.shape[1]
    m = _magnitude(x, True, 2)
    inside = (bins[:, None] >= np.array(edges[:-1])) & (bins[:, None] < np.array(edges[1:]))
    near = np.abs(bins[None, None, :] - hz[:, :, None]) <= tolerance
    largest = lambda v: np.where(near, v[:, None, :], 0.0).max(2)
    e = _envelope_magnitude(x, fs, demod)
    return (m * m) @ inside, largest(m), np.zeros_like(hz) if e is None else largest(e)


def fir(signal: Column, taps: np.ndarray) -> Column:
    """Causal convolution with taps."""

    def filtered(x: np.ndarray) -> np.ndarray:
        n = x.shape[1] + len(taps) - 1
        size = 1 << (n - 1).bit_length()
        return np.fft.irfft(np.fft.rfft(x, size, axis=1) * np.fft.rfft(taps, size), size, axis=1)[:, : x.shape[1]]

    return _udf(filtered)(signal)


def tukey(n: int, alpha: float = 0.25) -> np.ndarray:
    """The periodic tapered cosine window."""
    k = np.arange(n, dtype=float)
    edge = alpha * n / 2
    w = np.ones(n)
    rise, fall = k < edge, k > n - edge
    w[rise] = (1 + np.cos(np.pi * (k[rise] / edge - 1))) / 2
    w[fall] = (1 + np.cos(np.pi * ((k[fall] - n) / edge + 1))) / 2
    return w


def power_density(frame: Column, fs: float) -> Column:
    """One-sided power spectral density of frames: mean removed, tapered, scaled by density."""

    def density(x: np.ndarray) -> np.ndarray:
        n = x.shape[1]
        w = tukey(n)
        p = np.abs(np.fft.rfft((x - x.mean(1, keepdims=True)) * w, axis=1)) ** 2 / (fs * (w * w).sum())
        p[:, 1 : -1 if n % 2 == 0 else None] *= 2
        return p

    return _udf(density)(frame)


def decibels(power: Column) -> Column:
    return 10 * F.log10(power + 1e-12)


def frequencies(n: Column, fs: float) -> Column:
    """The axis of a one-sided spectrum of n samples."""
    return F.transform(F.sequence(F.lit(0), F.floor(n / 2).cast("int")), lambda k: k * F.lit(float(fs)) / n)


def band_energy(magnitudes: str | Column, n: Column, fs: float, low: float, high: float) -> Column:
    """Sum of squares over low <= f < high; 0 without a bin."""
    inside = F.filter(magnitudes, lambda _, k: (k * F.lit(float(fs)) / n >= low) & (k * F.lit(float(fs)) / n < high))
    return F.aggregate(inside, F.lit(0.0), lambda a, v: a + v * v)


def amplitude_near(magnitudes: str | Column, n: Column, fs: float, target: Column, tolerance: float) -> Column:
    """Largest magnitude within the closed tolerance about target; 0 without a bin."""
    inside = F.filter(magnitudes, lambda _, k: F.abs(k * F.lit(float(fs)) / n - target) <= tolerance)
    return F.coalesce(F.array_max(inside), F.lit(0.0))


def band_energy_by_bins(spectra: DataFrame, bands: DataFrame, widest: float, key: str = "key", hz: str = "hz", magnitude: str = "mag") -> DataFrame:
    """(key, low, high, energy) of spectra in rows (key, hz, mag) and bands (low, high): the sum of squares over low <= hz < high.

    An interval join without a nested loop: both sides are keyed by cells of the widest
    band's width, of which a band touches two at most and a frequency one; the exact test
    follows. Bands with an end that is null, or no wider than 0, have no rows, and neither
    have bands without a frequency. Bands wider than widest are cut into as many cells as they touch.
    """
    cell = lambda c: F.floor(F.col(c) / widest)
    wide = bands.filter("low < high").select("low", "high", F.explode(F.sequence(cell("low"), cell("high"))).alias("cell"))
    rows = spectra.select(key, F.col(hz).alias("_hz"), F.col(magnitude).alias("_v"), cell(hz).alias("cell"))
    found = rows.join(wide, "cell").filter((F.col("_hz") >= F.col("low")) & (F.col("_hz") < F.col("high")))
    return found.groupBy(key, "low", "high").agg(F.sum(F.col("_v") * F.col("_v")).alias("energy"))
