"""Recordings longer than a row give what they give as one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from oscilla.functions import filters, spectral
from oscilla.operators import feature_tables, framing, long_filters, long_signals, long_spectra

LENGTHS = {"a": 1000, "b": 997, "c": 64, "d": 7, "e": 1, "f": 333}


@pytest.fixture(scope="module")
def signals():
    rng = np.random.default_rng(3)
    return {k: rng.normal(size=n) for k, n in LENGTHS.items()}


@pytest.fixture(scope="module")
def samples(spark, signals):
    """Rows of samples in no order, with repeated times and a row without a key."""
    rows = [(k, i // 2, i, float(v)) for k, x in signals.items() for i, v in enumerate(x)] + [(None, 0, 0, 1.0)]
    df = spark.createDataFrame(rows, "file string, ts bigint, id bigint, value double").orderBy(F.rand(5)).repartition(7)
    return long_signals.numbered(df, "file", ["ts", "id"], "value").cache()


def whole(spark, signals):
    return spark.createDataFrame([(k, x.tolist()) for k, x in signals.items()], "key string, x array<double>")


def by_key(rows, place, value):
    out = {}
    for r in rows.collect():
        out.setdefault(r["key"], {})[r[place]] = r[value]
    return {k: np.array([v[i] for i in sorted(v)]) for k, v in out.items()}


def test_numbered(samples, signals):
    rows = samples.collect()
    assert len(rows) == sum(LENGTHS.values())
    assert all(r.n == LENGTHS[r.key] and r.x == signals[r.key][r.i] for r in rows)


@pytest.mark.parametrize(("size", "before", "after"), [(16, 0, 0), (16, 5, 40), (7, 20, 3), (5000, 9, 9)])
def test_blocks_with_halos(samples, signals, size, before, after):
    made = long_signals.blocks_of(samples, size, before, after)
    plain = long_signals.with_halo(long_signals.blocks_of(samples, size), size, before, after)
    for blocks in (made, plain):
        rows = blocks.collect()
        for key, n in LENGTHS.items():
            own = sorted((r.start, r.end) for r in rows if r.key == key)
            assert [a for a, _ in own] == [0, *(b for _, b in own[:-1])] and own[-1][1] == n
            assert len(own) == 1 or all(size <= b - a < 2 * size for a, b in own)
        for r in rows:
            low, high = max(0, r.start - before), min(LENGTHS[r.key], r.end + after)
            assert r.first == low and np.array_equal(r.x, signals[r.key][low:high])


@pytest.mark.parametrize(("size", "overlap", "block"), [(16, 0.5, 10), (16, 0.9, 100), (64, 0.0, 48), (7, 0.75, 1)])
@pytest.mark.parametrize("inclusive", [False, True])
def test_frames(spark, samples, signals, size, overlap, block, inclusive):
    got = long_signals.frames(long_signals.blocks_of(samples, block, 0, size), size, overlap, inclusive)
    want = framing.frames(whole(spark, signals), "x", size, overlap, inclusive)
    rows = lambda df: sorted((r.key, r.start_idx, tuple(r.window)) for r in df.collect())
    assert rows(got) == rows(want.select("key", "start_idx", "window"))


def test_features(spark, samples, signals):
    blocks = long_signals.blocks_of(samples, 100, 0, 64)
    rows = lambda df, names: sorted((r["key"], r["start_idx"], *(None if r[c] is None else round(r[c], 9) for c in names)) for r in df.collect())
    five = long_signals.features(blocks, 64, 0.75)
    want = feature_tables.simple_of_recordings(whole(spark, signals), "x", 64, 0.75)
    assert rows(five, feature_tables.SIMPLE) == rows(want, feature_tables.SIMPLE)
    twenty = long_signals.features(blocks.withColumn("hp", F.lit(1)), 64, 0.5, load="hp", tolerance=100.0)
    want = feature_tables.of_recordings(whole(spark, signals).withColumn("Load", F.lit(1)), "x", 64, 0.5, tolerance=100.0)
    assert rows(twenty, feature_tables.FEATURES) == rows(want, feature_tables.FEATURES) and twenty.count() > 50


@pytest.mark.parametrize(("made", "size"), [(filters.bandpass(1000.0, 4000.0, 12000.0, 4, False), 20 + 8), (filters.bandpass(2000.0, 5000.0, 12000.0, 2, True), 20), (filters.lowpass(500.0, 12000.0), 400)])
def test_zero_phase(samples, signals, made, size):
    """About fifty blocks a recording, scanned in groups of four."""
    blocks = long_filters.zero_phase(long_signals.blocks_of(samples, size), made, size, 4)
    got = by_key(long_signals.samples_of(blocks), "i", "x")
    want = {k: filters.zero_phase(made, x[None, :])[0] for k, x in signals.items() if len(x) > made.pad}
    assert got.keys() == want.keys()
    for k, x in want.items():
        np.testing.assert_allclose(got[k], x, atol=1e-8)


def test_fifty_blocks_and_a_square_law_envelope(spark):
    x = np.random.default_rng(8).normal(size=2500)
    rows = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(x)], "file int, i int, value double")
    blocks = long_signals.blocks_of(long_signals.numbered(rows, "file", ["i"], "value"), 50)
    assert blocks.count() == 50
    got = by_key(long_signals.samples_of(long_filters.square_law_envelope(blocks, size=50)), "i", "x")[0]
    want = spark.createDataFrame([(x.tolist(),)], "x array<double>").select(spectral.square_law_envelope(F.col("x"), 12000.0, 2000.0, 5000.0, 500.0, 2, True)).first()[0]
    np.testing.assert_allclose(got, want, atol=1e-8)


@pytest.mark.parametrize(("longest", "cells"), [(1 << 21, 1 << 19), (1 << 21, 64), (30, 64), (40, 1)])
def test_spectra_and_envelopes(samples, signals, longest, cells):
    """Whole, in many bundles, by convolution, and a cell a bundle."""
    pieces = long_spectra.pieces_of(long_signals.blocks_of(samples, 100))
    got = by_key(long_spectra.magnitudes(pieces, longest, cells), "k", "mag")
    assert got.keys() == signals.keys()
    for k, x in signals.items():
        np.testing.assert_allclose(got[k], np.abs(np.fft.rfft(x)) / len(x), atol=1e-10)
    blocks = long_signals.reblocked(long_spectra.envelope(pieces, longest, cells), 100)
    got = by_key(long_signals.samples_of(blocks), "i", "x")
    for k, x in signals.items():
        np.testing.assert_allclose(got[k], spectral._analytic(x[None, :])[0], atol=1e-9)


def test_phases_are_exact_for_long_recordings():
    for n in (3, 1_000_003, (1 << 40) + 15):
        k = np.array([0, 1, n - 1, n, 2 * n - 1, n // 3], np.int64)
        want = [np.exp(-1j * np.pi * (int(v) * int(v) % (2 * n)) / n) for v in k]
        np.testing.assert_allclose(long_spectra.phases(k, n), want, atol=1e-12)


def test_bundles_are_bounded():
    """A task's cells do not grow with the recording, and a prime's convolution has fitting factors."""
    for n in (10_000_019, 1 << 34, 172_800_000, 1_000_000_007):
        n1, n2 = long_spectra.factors(long_spectra.length_of(n))
        assert n2 <= long_spectra.LONGEST and max(1, long_spectra.CELLS // n1) * n1 <= max(long_spectra.CELLS, long_spectra.LONGEST)


def test_no_samples(spark):
    rows = spark.createDataFrame([], "file string, i int, value double")
    samples = long_signals.numbered(rows, "file", ["i"], "value")
    blocks = long_signals.blocks_of(samples, 100)
    assert long_signals.frames(blocks, 16, 0.5, True).count() == 0
    assert long_filters.lowpass(blocks, size=100).count() == 0
    assert long_spectra.magnitudes(long_spectra.pieces_of(blocks)).count() == 0
