"""Closed forms: tones, impulses, constants, frames and filters."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from oscilla.functions import filters, kinematics, spectral
from oscilla.functions.statistics import recording_features, simple_features, windowed_features, with_fast_statistics, with_statistics
from oscilla.operators import feature_tables, framing

FS = 12_000


def frame(spark, *signals):
    return spark.createDataFrame([(k, [float(v) for v in x] if x is not None else None) for k, x in enumerate(signals)], "id int, x array<double>")


def gain(made, hz):
    b, a = made.ba
    z = np.exp(-2j * np.pi * hz / FS)
    return abs(np.polyval(b[::-1], z) / np.polyval(a[::-1], z))


@pytest.mark.parametrize(("order", "low", "high"), [(2, 2000, 5000), (4, 1000, 4000), (4, 1500, 3500)])
def test_bandpass_edges(order, low, high):
    for sections in (True, False):
        made = filters.bandpass(low, high, FS, order, sections)
        assert gain(made, low) == pytest.approx(0.5**0.5, abs=1e-9)
        assert gain(made, high) == pytest.approx(0.5**0.5, abs=1e-9)
        assert gain(made, 1e-9) < 1e-12 and made.pad == 3 * (2 * order + 1)


def test_lowpass_closed_form():
    k = np.tan(np.pi * 500 / FS)
    norm = 1 / (1 + 2**0.5 * k + k * k)
    b, a = filters.lowpass(500, FS, 2).ba
    assert np.allclose(b, norm * k * k * np.array([1, 2, 1])) and np.allclose(a, [1, 2 * (k * k - 1) * norm, (1 - 2**0.5 * k + k * k) * norm])


def test_zero_phase_in_blocks_is_the_recursion():
    made = filters.bandpass(1000, 4000, FS, 4, False)
    x = np.random.default_rng(1).standard_normal((2, 700))
    b, a = made.ba

    def once(row):
        z, out = filters.steady_state(b, a) * row[0], []
        for v in row:
            y = b[0] * v + z[0]
            z = np.append(z[1:], 0) + b[1:] * v - a[1:] * y
            out.append(y)
        return np.array(out)

    for row, got in zip(x, filters.zero_phase(made, x), strict=True):
        p = made.pad
        wide = np.concatenate([2 * row[0] - row[p:0:-1], row, 2 * row[-1] - row[-2 : -p - 2 : -1]])
        assert np.allclose(once(once(wide)[::-1])[::-1][p:-p], got, atol=1e-10)


def test_zero_phase_keeps_a_tone_in_place(spark):
    t = np.arange(4096) / FS
    tone = np.sin(2 * np.pi * 2500 * t)
    df = frame(spark, tone, tone[:20], None).select(spectral.bandpass(F.col("x"), FS, 1000.0, 4000.0).alias("y")).collect()
    assert np.allclose(np.array(df[0].y)[500:-500], tone[500:-500], atol=1e-3)
    assert df[1].y is None and df[2].y is None  # too short, and null


def test_statistics_of_special_signals(spark):
    rows = with_statistics(frame(spark, np.ones(64), np.zeros(64), [], None))
    got = rows.select("id", *(c.alias(k) for k, c in recording_features(F.col("stats")).items())).orderBy("id").collect()
    assert (got[0].rms, got[0].std, got[0].skewness, got[0].kurtosis, got[0].crest_factor) == (1, 0, None, None, 1)
    assert got[1].crest_factor is None and got[1].shape_factor is None
    six = rows.select("id", *(c.alias(k) for k, c in windowed_features(F.col("stats")).items())).orderBy("id").collect()
    assert six[1].Crest_Factor == 0 and six[2].RMS is None and six[3].RMS is None
    assert rows.select(*(c.alias(k) for k, c in simple_features(F.col("stats")).items())).count() == 4


def test_fast_statistics_are_the_same(spark):
    rng = np.random.default_rng(2)
    df = frame(spark, np.ones(64), np.zeros(64), [], None, *(rng.standard_normal(n) for n in (1, 5, 64, 64, 1000)))
    for features in (windowed_features, simple_features, recording_features):
        a, b = (make(df).select("id", *(c.alias(k) for k, c in features(F.col("stats")).items())).orderBy("id").collect() for make in (with_statistics, with_fast_statistics))
        for x, y in zip(a, b, strict=True):
            assert [v is None for v in x] == [v is None for v in y], (x, y)
            assert [v for v in x if v is not None] == pytest.approx([v for v in y if v is not None])


def test_tables_of_recordings_are_those_of_their_windows(spark):
    rng = np.random.default_rng(4)
    rows = [(k, k, rng.standard_normal(n).tolist() if n is not None else None) for k, n in enumerate((100, 64, 63, 65, 0, None, 1000))]
    df = spark.createDataFrame(rows, "id int, Load int, signal array<double>")
    for inclusive in (True, False):
        slow = feature_tables.simple_table(framing.frames(df, "signal", 64, 0.5, inclusive).drop("signal"))
        fast = feature_tables.simple_of_recordings(df, "signal", 64, 0.5, inclusive)
        assert fast.columns == slow.columns
        a, b = (sorted(map(tuple, t.collect())) for t in (slow, fast))
        assert len(a) == len(b) and all(x[:3] == y[:3] and x[3:] == pytest.approx(y[3:]) for x, y in zip(a, b, strict=True))
    for demod in ("hilbert", "square_law", "none"):
        slow = feature_tables.full_table(framing.frames(df, "signal", 64, 0.5, True).drop("signal"), demod=demod, tolerance=100.0)
        fast = feature_tables.of_recordings(df, "signal", 64, 0.5, demod, tolerance=100.0)
        a, b = (sorted(map(tuple, t.collect())) for t in (slow, fast))
        assert fast.columns == slow.columns and len(a) == len(b) > 30 and all(x[:3] == y[:3] and x[3:] == pytest.approx(y[3:]) for x, y in zip(a, b, strict=True))


def test_full_table_of_special_windows(spark):
    df = frame(spark, np.ones(64), [], None, np.arange(10)).withColumn("Load", F.lit(None).cast("int"))
    rows = feature_tables.full_table(df, "x", demod="square_law").orderBy("id").collect()
    assert rows[0].RMS == 0 and rows[0].Kurtosis is None and rows[0].Crest_Factor == 0 and rows[0].Env_Amp_BPFI == 0
    assert rows[1].RMS is None and rows[2]["Energy_0.0_50.0Hz"] is None
    assert rows[3].RMS == pytest.approx(np.std(np.arange(10))) and rows[3].Env_Amp_BSF == 0  # too short to filter


def test_spectrum_and_envelope_of_a_tone(spark):
    k, n = 5, 64
    tone = np.cos(2 * np.pi * k * np.arange(n) / n)
    impulse = np.eye(1, n)[0]
    rows = frame(spark, tone, impulse).select(spectral.raw_spectrum(F.col("x")).alias("m"), spectral.hilbert_envelope(F.col("x")).alias("e")).collect()
    assert np.argmax(rows[0].m) == k and rows[0].m[k] == pytest.approx(0.5) and np.allclose(rows[0].e, 1)
    assert np.allclose(rows[1].m, 1 / n)


def test_envelope_spectrum_finds_the_modulation(spark):
    t = np.arange(1024) / FS
    hz = 10 * FS / 1024
    x = (1 + 0.8 * np.cos(2 * np.pi * hz * t)) * np.sin(2 * np.pi * 3000 * t)
    for demod in ("hilbert", "square_law"):
        m = frame(spark, x).select(spectral.envelope_spectrum(F.col("x"), FS, demod).alias("m")).first().m
        assert np.argmax(m) == 10
    assert frame(spark, x).select(spectral.envelope_spectrum(F.col("x"), FS, "none").alias("m")).first().m is None
    with pytest.raises(ValueError):
        spectral.demodulated(F.col("x"), FS, "other")


@pytest.mark.parametrize(("n", "exclusive", "inclusive"), [(7, 0, 0), (8, 0, 1), (9, 1, 1), (12, 1, 2), (13, 2, 2)])
def test_frame_counts(spark, n, exclusive, inclusive):
    df = frame(spark, range(n))
    assert framing.frames(df, "x", 8, 0.5, False).count() == exclusive
    assert framing.frames(df, "x", 8, 0.5, True).count() == inclusive


def test_shared_share():
    assert [framing.shared_share(2048, o) for o in (0.9, 0.75, 0.5, 0.0)] == [1844 / 2048, 0.75, 0.5, 0]


def test_full_table(spark):
    x = np.random.default_rng(3).standard_normal(3000)
    rows = spark.createDataFrame([("a.mat", 1, 0, x.tolist()), ("b.mat", 2, 9, None)], "Filepath string, Label int, Load int, signal array<double>")
    table = feature_tables.of_recordings(rows)
    assert table.columns == ["Filepath", "Label", "Load", "start_idx", *feature_tables.FEATURES] and len(feature_tables.FEATURES) == 20
    got = table.orderBy("start_idx").collect()
    assert [r.start_idx for r in got] == [0, 512, 1024, 1536]
    w = x[512:1536] - x[512:1536].mean()
    m = np.abs(np.fft.rfft(w * np.hanning(1024))) * 2 / 1024
    hz = np.fft.rfftfreq(1024, 1 / FS)
    assert got[1]["RMS"] == pytest.approx(w.std()) and got[1]["Energy_400.0_800.0Hz"] == pytest.approx((m[(hz >= 400) & (hz < 800)] ** 2).sum())
    near = np.abs(hz - 5.4152 * 1797 / 60) <= 2
    assert got[1]["Amp_BPFI"] == pytest.approx(m[near].max() if near.any() else 0)
    bands = [((hz >= a) & (hz < b)).sum() for a, b in zip(feature_tables.BAND_EDGES, feature_tables.BAND_EDGES[1:], strict=False)]
    assert bands == [5, 4, 9, 17, 34, 68, 137, 238]


def test_kinematics(spark):
    row = spark.range(1).select(*(c.alias(k) for k, c in kinematics.fault_frequencies(F.lit(1797)).items())).first()
    assert [round(v, 3) for v in row] == [29.95, 107.364, 162.186, 70.584, 11.929]
    with pytest.raises(Exception, match="no nominal speed"):
        spark.range(1).select(kinematics.strict_rpm_of(F.lit(7))).collect()


def test_an_impulse_is_made_once_a_speed(spark, monkeypatch):
    """fir_impulse makes its samples for every speed that occurs, not for every row."""
    from oscilla.plans import signals, standins

    sf, made = "/root/testdata/sf0.01", spark.sparkContext.accumulator(0)

    def counted(i, fs, rpm, hz):
        return F.udf(lambda k, v: (made.add(1), k + v)[1], "double")(i, rpm)

    monkeypatch.setattr(signals.synthetic, "sample", counted)
    rows = standins.speeds(spark, sf)
    got = {r.k: r.peak for r in signals.QUERIES["fir_impulse"](spark, sf).collect()}
    assert got == {r.k: r.rpm + 127 for r in rows.collect()}
    speeds = rows.select("rpm").distinct().count()
    assert 0 < made.value <= 3 * 128 * speeds < 128 * rows.count()
