"""Queries over signals: features, frames, spectra, envelopes and filters, with their DuckDB statements."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import BAND_EDGES, EPS, FAULT_MULTIPLIERS, FS
from ..functions import filters, spectral
from ..functions.kinematics import fault_frequencies
from ..functions.statistics import centered, long_form_features, mean_of, recording_features, rounded, simple_features, windowed_features, with_statistics
from ..operators import feature_tables, framing
from ..sources import synthetic
from .standins import MANIFEST, RECORDINGS, SEGMENTS, SPEEDS, r6, recordings, samples, segments, speeds

W, OVERLAP = 16, 0.5
STEP = framing.step_of(W, OVERLAP)


def _named(features: dict, names=None) -> list:
    return [(c.cast("long") if k == "n_samples" else rounded(c)).alias(k) for k, c in features.items() if names is None or k in names]


# ---- statistics --------------------------------------------------------------


def _sums(source: str, key: str) -> str:
    """CTEs over source (key, x): s has n, mu and the sums of powers."""
    return f"""
, m_ AS (SELECT {key}, x, len(x)::DOUBLE AS n, list_sum(x) / len(x) AS mu FROM {source})
, d_ AS (SELECT *, list_transform(x, lambda v: v - mu) AS c FROM m_)
, s_ AS (SELECT {key}, n, mu, list_sum(list_transform(c, lambda v: v * v)) AS m2, list_sum(list_transform(c, lambda v: v * v * v)) AS m3,
    list_sum(list_transform(c, lambda v: v * v * v * v)) AS m4, list_sum(list_transform(x, lambda v: abs(v))) AS sa, list_sum(list_transform(x, lambda v: v * v)) AS sq,
    list_max(list_transform(x, lambda v: abs(v))) AS pk, list_sum(list_transform(c, lambda v: abs(v))) AS ca, list_max(list_transform(c, lambda v: abs(v))) AS cp FROM d_)"""


_KURTOSIS = "n * m4 / nullif(m2 * m2, 0)"
_SKEWNESS = "sqrt(n) * m3 / nullif(pow(m2, 1.5), 0)"
_CENTERED = {
    "RMS": "sqrt(m2 / n)", "Peak": "cp", "Kurtosis": _KURTOSIS, "Skewness": _SKEWNESS,
    "Crest_Factor": f"cp / (sqrt(m2 / n) + {EPS})", "Shape_Factor": f"sqrt(m2 / n) / (ca / n + {EPS})",
}
_SIMPLE = {"rms": "sqrt(sq / n)", "kurtosis": f"{_KURTOSIS} - 3", "skewness": _SKEWNESS, "peak": "pk", "std": "sqrt(m2 / n)"}
_WHOLE = {
    "mean": "mu", "std": "sqrt(m2 / n)", "rms": "sqrt(sq / n)", "peak": "pk", "kurtosis": f"{_KURTOSIS} - 3", "skewness": _SKEWNESS,
    "crest_factor": "CASE WHEN sq > 0 THEN pk / sqrt(sq / n) END", "shape_factor": "CASE WHEN sa > 0 THEN sqrt(sq / n) / (sa / n) END",
}


def _columns(features: dict[str, str]) -> str:
    return ", ".join(f'{r6(e)} AS "{k}"' for k, e in features.items())


def class_feature_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of five features by class, to four decimals."""
    rows = with_statistics(segments(spark, sf_dir).filter("label is not null"))
    f = recording_features(F.col("stats"))
    names = ("rms", "kurtosis", "skewness", "crest_factor", "peak")
    return rows.select("label", *(f[k].alias(k) for k in names)).groupBy("label").agg(*(rounded(F.avg(k), 4).alias(k) for k in names))


def time_features_centered(spark, sf_dir):
    return with_statistics(segments(spark, sf_dir)).select("vec_id", *_named(windowed_features(F.col("stats"))))


def time_features_raw(spark, sf_dir):
    return with_statistics(segments(spark, sf_dir)).select("vec_id", *_named(simple_features(F.col("stats"))))


def file_features(spark, sf_dir):
    rows = long_form_features(samples(spark, sf_dir), "user_id", "value")
    return rows.select("user_id", "n_samples", *(rounded(F.col(k)).alias(k) for k in _WHOLE))


# ---- frames ------------------------------------------------------------------


def _frames(spark, sf_dir, inclusive: bool) -> DataFrame:
    return framing.frames(recordings(spark, sf_dir), "x", W, OVERLAP, inclusive)


def _framed(last: str) -> str:
    return f"f AS (SELECT user_id, s::INTEGER AS start_idx, x[s + 1:s + {W}] AS x FROM (SELECT user_id, x, unnest(range(0, greatest({last}, 0), {STEP})) AS s FROM v))"


def _frame_rows(frames: DataFrame) -> DataFrame:
    w = F.col("window")
    total = F.aggregate(w, F.lit(0.0), lambda a, v: a + v)
    return frames.select("user_id", "start_idx", rounded(w[0]).alias("first"), rounded(w[W - 1]).alias("last"), rounded(total).alias("total"))


_FRAME_COLUMNS = f"user_id, start_idx, {r6('x[1]')} AS first, {r6(f'x[{W}]')} AS last, {r6('list_sum(x)')} AS total"


def frames_exclusive(spark, sf_dir):
    return _frame_rows(_frames(spark, sf_dir, False))


def frames_inclusive(spark, sf_dir):
    return _frame_rows(_frames(spark, sf_dir, True))


def frame_features(spark, sf_dir):
    table = feature_tables.simple_table(_frames(spark, sf_dir, False).drop("x"))
    return table.select("user_id", "start_idx", *(rounded(F.col(k)).alias(k) for k in _SIMPLE))


def adjacent_window_diff(spark, sf_dir):
    """Windows 0 and 1 of each recording at an overlap of 0.9: difference of each feature in percent."""
    frames = framing.frames(recordings(spark, sf_dir), "x", W, 0.9, False).drop("x")
    table = feature_tables.simple_table(frames.filter(F.col("start_idx") <= framing.step_of(W, 0.9)))
    rows = table.select("user_id", "start_idx", *(framing.adjacent_difference("user_id", k).alias(k) for k in ("rms", "std", "peak")))
    shared = F.lit(framing.shared_share(W, 0.9))
    return rows.filter("start_idx = 0 and rms is not null").select("user_id", shared.alias("shared"), *(rounded(F.col(k)).alias(k) for k in ("rms", "std", "peak")))


_NEAR = framing.step_of(W, 0.9)


def waveform_prefix(spark, sf_dir):
    """The first ten samples of every recording with their time in milliseconds."""
    rows = recordings(spark, sf_dir).select("user_id", F.explode(framing.time_axis(framing.prefix("x", 10), FS, True)).alias("s"))
    return rows.select("user_id", F.col("s.i").cast("int").alias("i"), rounded(F.col("s.t")).alias("t_ms"), rounded(F.col("s.x")).alias("x"))


# ---- spectra -----------------------------------------------------------------


def _spectrum_rows(rows: DataFrame, column: str) -> DataFrame:
    return rows.select("vec_id", F.posexplode(column).alias("k", "v")).select("vec_id", "k", rounded(F.col("v")).alias("mag"))


def spectrum_hann(spark, sf_dir):
    return _spectrum_rows(segments(spark, sf_dir).select("vec_id", spectral.hann_spectrum(F.col("x")).alias("m")), "m")


def spectrum_raw(spark, sf_dir):
    return _spectrum_rows(segments(spark, sf_dir).select("vec_id", spectral.raw_spectrum(F.col("x")).alias("m")), "m")


def rfft_axis(spark, sf_dir):
    n = segments(spark, sf_dir).select(F.size("x").alias("n")).distinct()
    return n.select("n", F.posexplode(spectral.frequencies(F.col("n"), FS)).alias("k", "hz")).select("n", "k", rounded(F.col("hz")).alias("hz"))


_HANN = "(0.5 - 0.5 * cos(2 * pi() * i / (len(x) - 1)))"


def _dft(name: str, source: str, key: str, weight: str, scale: str) -> str:
    """CTE name (key, n, k, mag): magnitudes of weight * x at bins 0 .. n/2."""
    return f"""
{name}_w AS (SELECT {key}, len(x) AS n, list_transform(range(0, len(x)), lambda i: {weight} * x[i + 1]) AS y FROM {source}),
{name}_s AS (SELECT {key}, n, i, y[i + 1] AS y FROM {name}_w, LATERAL (SELECT unnest(range(0, n)) AS i)),
{name}_k AS (SELECT {key}, n, unnest(range(0, n // 2 + 1)) AS k FROM {name}_w),
{name} AS (SELECT s.{key}, any_value(s.n) AS n, k.k, sqrt(pow(sum(s.y * cos(2 * pi() * k.k * s.i / s.n)), 2) + pow(sum(s.y * sin(2 * pi() * k.k * s.i / s.n)), 2)) * {scale} / any_value(s.n) AS mag
  FROM {name}_s s JOIN {name}_k k ON s.{key} = k.{key} GROUP BY s.{key}, k.k)"""


def band_energy(spark, sf_dir):
    rows = segments(spark, sf_dir).select("vec_id", F.size("x").alias("n"), spectral.hann_spectrum(F.col("x")).alias("m"))
    bands = F.array(*(F.struct(F.lit(a).alias("low"), rounded(spectral.band_energy("m", F.col("n"), FS, a, b), 9).alias("energy")) for a, b in zip(BAND_EDGES, BAND_EDGES[1:], strict=False)))
    return rows.select("vec_id", F.inline(bands))


def band_energy_joined(spark, sf_dir):
    """The bands with a frequency in them, by a join of spectra in rows with a table of bands."""
    rows = segments(spark, sf_dir).select("vec_id", F.size("x").alias("n"), F.posexplode(spectral.hann_spectrum(F.col("x"))).alias("k", "mag"))
    bands = spark.createDataFrame(list(zip(map(float, BAND_EDGES), map(float, BAND_EDGES[1:]), strict=False)), "low double, high double")
    widest = max(b - a for a, b in zip(BAND_EDGES, BAND_EDGES[1:], strict=False))
    found = spectral.band_energy_by_bins(rows.withColumn("hz", F.col("k") * float(FS) / F.col("n")), bands, widest, "vec_id")
    return found.select("vec_id", "low", "high", rounded(F.col("energy"), 9).alias("energy"))


def amp_at_fault(spark, sf_dir):
    """Largest magnitude within 100 Hz of each fault frequency at 1797 rpm (mostly no bin is that near: 0)."""
    rows = segments(spark, sf_dir).select("vec_id", F.size("x").alias("n"), spectral.hann_spectrum(F.col("x")).alias("m"))
    hz = {k: m * 1797 / 60.0 for k, m in FAULT_MULTIPLIERS.items()}
    return rows.select("vec_id", *(rounded(spectral.amplitude_near("m", F.col("n"), FS, F.lit(v), 100.0)).alias(k) for k, v in hz.items()))


def hilbert_envelope(spark, sf_dir):
    rows = segments(spark, sf_dir).select("vec_id", F.posexplode(spectral.hilbert_envelope(F.col("x"))).alias("i", "v"))
    return rows.select("vec_id", "i", rounded(F.col("v")).alias("env"))


def envelope_spectrum(spark, sf_dir):
    return _spectrum_rows(segments(spark, sf_dir).select("vec_id", spectral.envelope_spectrum(F.col("x"), FS).alias("m")), "m")


def _hilbert(source: str, key: str) -> str:
    """CTEs h (key, i, env) and he (key, x): the envelope by the kernel of the discrete Hilbert transform (even lengths)."""
    return f"""
h_s AS (SELECT {key}, len(x) AS n, x, unnest(range(0, len(x))) AS j FROM {source}),
h_i AS (SELECT {key}, unnest(range(0, len(x))) AS i FROM {source}),
h AS (SELECT s.{key}, t.i, sqrt(pow(any_value(s.x[t.i + 1]), 2) + pow(sum(CASE WHEN (t.i - s.j) % 2 <> 0 THEN s.x[s.j + 1] * 2.0 / s.n / tan(pi() * (t.i - s.j) / s.n) ELSE 0 END), 2)) AS env
  FROM h_s s JOIN h_i t ON s.{key} = t.{key} GROUP BY s.{key}, t.i),
he AS (SELECT {key}, list_transform(list(env ORDER BY i), lambda v: v - mu) AS x FROM (SELECT *, avg(env) OVER (PARTITION BY {key}) AS mu FROM h) GROUP BY {key}, mu)"""


def full_feature_table(spark, sf_dir):
    """The twenty features of every segment; load and label follow from its number."""
    rows = segments(spark, sf_dir).select("vec_id", (F.col("vec_id") % 5).cast("int").alias("Load"), F.col("label").alias("Label"), "x")
    table = feature_tables.full_table(rows, "x", "Load", "hilbert", FS, 100.0)
    return table.select("vec_id", "Load", "Label", *(rounded(F.col(f"`{c}`")).alias(c) for c in feature_tables.FEATURES))


def _full_oracle() -> str:
    rpm = "(CASE vec_id % 5 WHEN 0 THEN 1797 WHEN 1 THEN 1772 WHEN 2 THEN 1750 WHEN 3 THEN 1730 ELSE 1797 END / 60.0::DOUBLE)"
    bin_ = f"(k * {float(FS)}::DOUBLE / n)"
    energies = ", ".join(f"coalesce(sum(CASE WHEN {bin_} >= {a} AND {bin_} < {b} THEN mag * mag END), 0) AS e{k}" for k, (a, b) in enumerate(zip(BAND_EDGES, BAND_EDGES[1:], strict=False)))
    amps = lambda p: ", ".join(f"coalesce(max(CASE WHEN abs({bin_} - {m}::DOUBLE * {rpm}) <= 100 THEN mag END), 0) AS {p}{k}" for k, m in enumerate(FAULT_MULTIPLIERS.values()))
    out = [f'{r6(e)} AS "{k}"' for k, e in _CENTERED.items()]
    out += [f'{r6(f"e{k}")} AS "{name}"' for k, name in enumerate(feature_tables.ENERGIES)]
    out += [f'{r6(f"a{k}")} AS "{name}"' for k, name in enumerate(feature_tables.AMPLITUDES)]
    out += [f'{r6(f"b{k}")} AS "{name}"' for k, name in enumerate(feature_tables.ENVELOPES)]
    return f"""WITH {SEGMENTS}{_sums("e", "vec_id")},
c AS (SELECT vec_id, c AS x FROM d_), {_dft("f1", "c", "vec_id", _HANN, "2")}, {_hilbert("c", "vec_id")}, {_dft("f2", "he", "vec_id", _HANN, "2")},
g1 AS (SELECT vec_id, {energies}, {amps("a")} FROM f1 GROUP BY vec_id), g2 AS (SELECT vec_id, {amps("b")} FROM f2 GROUP BY vec_id)
SELECT vec_id, (vec_id % 5)::INTEGER AS "Load", label AS "Label", {", ".join(out)} FROM s_ JOIN g1 USING (vec_id) JOIN g2 USING (vec_id) JOIN e USING (vec_id)"""


def spectrogram_db(spark, sf_dir):
    """Power density in dB of frames of 16 with an overlap of half."""
    frames = framing.frames(segments(spark, sf_dir).select("vec_id", "x"), "x", 16, 0.5, True).drop("x")
    rows = frames.select("vec_id", "start_idx", F.posexplode(spectral.power_density(F.col("window"), FS)).alias("k", "p"))
    return rows.select("vec_id", "start_idx", "k", rounded(spectral.decibels(F.col("p"))).alias("psd_db"))


def _spectrogram_oracle() -> str:
    w = spectral.tukey(16)
    weights = "[" + ", ".join(f"{v!r}::DOUBLE" for v in w.tolist()) + "]"
    scale = f"{float(FS)}::DOUBLE * {float((w * w).sum())!r}::DOUBLE"
    return f"""WITH {SEGMENTS},
f AS (SELECT vec_id, s AS start_idx, x[s + 1:s + 16] AS x FROM (SELECT vec_id, x, unnest(range(0, len(x) - 15, 8)) AS s FROM e)),
g AS (SELECT vec_id, start_idx, list_transform(range(0, 16), lambda i: (x[i + 1] - list_sum(x) / 16) * ({weights})[i + 1]) AS y FROM f),
h AS (SELECT vec_id, start_idx, y, unnest(range(0, 9)) AS k FROM g),
p AS (SELECT vec_id, start_idx, k, (pow(list_sum(list_transform(range(0, 16), lambda i: y[i + 1] * cos(2 * pi() * k * i / 16))), 2) + pow(list_sum(list_transform(range(0, 16), lambda i: y[i + 1] * sin(2 * pi() * k * i / 16))), 2)) / ({scale}) * CASE WHEN k IN (0, 8) THEN 1 ELSE 2 END AS p FROM h)
SELECT vec_id, start_idx::INTEGER AS start_idx, k::INTEGER AS k, {r6("10 * log10(p + 1e-12)")} AS psd_db FROM p"""


# ---- filters -----------------------------------------------------------------


def _filter(name: str, source: str, b, a, pad: int) -> str:
    """CTEs; name (vec_id, x): source's x filtered forward and backward by the recursion, oddly extended by pad."""
    b, a = np.asarray(b) / a[0], np.asarray(a) / a[0]
    n = len(a) - 1
    steady = filters.steady_state(b, a)
    lit = lambda v: f"({float(v)!r})::DOUBLE"

    def states(x: str, y: str, state) -> str:
        return ", ".join(f"{lit(b[k + 1])} * {x} - {lit(a[k + 1])} * ({y})" + (f" + {state(k + 1)}" if k + 1 < n else "") + f" AS z{k}" for k in range(n))

    def once(to: str, of: str) -> str:
        y0 = f"{lit(b[0])} * x[1] + {lit(steady[0])} * x[1]"
        y1 = f"{lit(b[0])} * x[i + 1] + z0"
        return f"""
{to}_r AS (SELECT vec_id, x, 1::BIGINT AS i, {y0} AS y, {states("x[1]", y0, lambda k: f"{lit(steady[k])} * x[1]")} FROM {of}
  UNION ALL SELECT vec_id, x, i + 1, {y1}, {states("x[i + 1]", y1, lambda k: f"z{k}")} FROM {to}_r WHERE i < len(x)),
{to} AS (SELECT vec_id, list(y ORDER BY i DESC) AS x FROM {to}_r GROUP BY vec_id)"""

    return f"""
{name}_e AS (SELECT vec_id, list_concat(list_concat(list_transform(range(0, {pad}), lambda i: 2 * x[1] - x[{pad} + 1 - i]), x), list_transform(range(0, {pad}), lambda i: 2 * x[len(x)] - x[len(x) - 1 - i])) AS x FROM {source}),
{once(f"{name}_f", f"{name}_e")}, {once(f"{name}_b", f"{name}_f")},
{name} AS (SELECT vec_id, x[{pad} + 1:len(x) - {pad}] AS x FROM {name}_b)"""


def _sample_rows(rows: DataFrame, column: str) -> DataFrame:
    return rows.select("vec_id", F.posexplode(column).alias("i", "v")).select("vec_id", "i", rounded(F.col("v")).alias("y"))


_SAMPLES = f"SELECT vec_id, i::INTEGER AS i, {r6('x[i + 1]')} AS y FROM (SELECT vec_id, x, unnest(range(0, len(x))) AS i FROM {{}})"


def iir_lowpass(spark, sf_dir):
    return _sample_rows(segments(spark, sf_dir).select("vec_id", spectral.lowpass(F.col("x"), FS, 500.0).alias("y")), "y")


def zero_phase_bandpass(spark, sf_dir):
    return _sample_rows(segments(spark, sf_dir).select("vec_id", spectral.bandpass(F.col("x"), FS, 1000.0, 4000.0).alias("y")), "y")


def square_law_envelope(spark, sf_dir):
    return _sample_rows(segments(spark, sf_dir).select("vec_id", spectral.demodulated(F.col("x"), FS, "square_law").alias("y")), "y")


def _filter_oracles() -> dict[str, str]:
    low, four, two = filters.lowpass(500.0, FS), filters.bandpass(1000.0, 4000.0, FS, 4, False), filters.bandpass(2000.0, 5000.0, FS, 2, True)
    return {
        "iir_lowpass": f"WITH RECURSIVE {SEGMENTS}, {_filter('l', 'e', *low.ba, low.pad)} " + _SAMPLES.format("l"),
        "zero_phase_bandpass": f"WITH RECURSIVE {SEGMENTS}, {_filter('b', 'e', *four.ba, four.pad)} " + _SAMPLES.format("b"),
        "square_law_envelope": f"WITH RECURSIVE {SEGMENTS}, {_filter('b', 'e', *two.ba, two.pad)}, q AS (SELECT vec_id, list_transform(x, lambda v: v * v) AS x FROM b), {_filter('l', 'q', *low.ba, low.pad)} " + _SAMPLES.format("l"),
    }


def bandpassed_envelope(spark, sf_dir):
    """Envelope of the band-passed signal by the Hilbert transform."""
    return _sample_rows(segments(spark, sf_dir).select("vec_id", spectral.bandpassed_hilbert_envelope(F.col("x"), FS).alias("y")), "y")


def _bandpassed_oracle() -> str:
    four = filters.bandpass(1000.0, 4000.0, FS, 4, False)
    return f"WITH RECURSIVE {SEGMENTS}, {_filter('b', 'e', *four.ba, four.pad)}, {_hilbert('b', 'vec_id')} SELECT vec_id, i::INTEGER AS i, {r6('env')} AS y FROM h"


def fir_impulse(spark, sf_dir):
    """Energy and peak of the 128 samples, without noise, of an outer-race fault at the speed of every row of the manifest."""
    rpm, i = F.col("rpm"), F.col("i").cast("double")
    rows = speeds(spark, sf_dir).select("k", "rpm")
    # the samples follow from the speed alone; dealt by speed once, they are added up where they are made
    made = rows.select("rpm").distinct().select("rpm", F.explode(F.sequence(F.lit(0), F.lit(127))).alias("i"))
    x = synthetic.sample(i, FS, rpm, fault_frequencies(rpm)["BPFO"])
    of_speed = made.select("rpm", x.alias("x")).groupBy("rpm").agg(F.sum(F.col("x") * F.col("x")).alias("e"), F.max(F.abs("x")).alias("p")).withColumnRenamed("rpm", "_rpm")
    return rows.join(of_speed, rpm.eqNullSafe(F.col("_rpm"))).groupBy("k").agg(rounded(F.sum("e")).alias("energy"), rounded(F.max("p")).alias("peak"))


_BPFO = f"rpm / 60.0::DOUBLE * (4.5 * (1 - {0.3126 / 1.537!r}::DOUBLE))"
_FIR = f"""WITH {MANIFEST}, {SPEEDS}, f AS (SELECT k, rpm, {_BPFO} AS hz FROM w), s AS (SELECT k, rpm, unnest(range(0, 128)) AS i FROM f),
hit AS (SELECT DISTINCT k, floor(j / hz * {FS})::BIGINT AS p FROM f, (SELECT unnest(range(0, 12)) AS j) WHERE floor(j / hz * {FS}) < 128),
x AS (SELECT s.k, s.i, 0.5::DOUBLE * sin(2 * pi() * (any_value(s.rpm) / 60.0::DOUBLE) * s.i / {FS}) + 1.5::DOUBLE * coalesce(sum(exp(-(s.i - p) / 15.0::DOUBLE) * sin(2 * pi() * 2500 * (s.i - p) / {FS})), 0) AS x
  FROM s LEFT JOIN hit ON s.k = hit.k AND s.i >= p AND s.i - p < 200 GROUP BY s.k, s.i)
SELECT k, {r6("sum(x * x)")} AS energy, {r6("max(abs(x))")} AS peak FROM x GROUP BY k"""


def fir_filter(spark, sf_dir):
    """Segments through the decaying carrier as a causal filter."""
    return _sample_rows(segments(spark, sf_dir).select("vec_id", spectral.fir(F.col("x"), synthetic.taps()).alias("y")), "y")


_FIR_FILTER = f"""WITH {SEGMENTS}, s AS (SELECT vec_id, x, unnest(range(0, len(x))) AS i FROM e)
SELECT vec_id, i::INTEGER AS i, {r6(f"list_sum(list_transform(range(0, i + 1), lambda j: x[j + 1] * exp(-(i - j) / 15.0::DOUBLE) * sin(2 * pi() * 2500 * (i - j) / {FS})))")} AS y FROM s"""


def order_spectrum(spark, sf_dir):
    """Raw spectra on the order axis up to order 12, at the speed of each segment's load."""
    rows = segments(spark, sf_dir).select("vec_id", F.size("x").alias("n"), F.posexplode(spectral.raw_spectrum(F.col("x"))).alias("k", "mag"))
    from ..functions.kinematics import order_of, rpm_of

    order = order_of(F.col("k") * float(FS) / F.col("n"), rpm_of((F.col("vec_id") % 5).cast("int")))
    return rows.select("vec_id", "k", rounded(order).alias("order"), rounded(F.col("mag")).alias("mag")).filter("order <= 12")


_RPM5 = "(CASE vec_id % 5 WHEN 0 THEN 1797 WHEN 1 THEN 1772 WHEN 2 THEN 1750 WHEN 3 THEN 1730 ELSE 1797 END / 60.0::DOUBLE)"


def union_features(spark, sf_dir):
    """Features of segments and of recordings in one table."""
    a = with_statistics(segments(spark, sf_dir)).select(F.lit("segment").alias("kind"), F.col("vec_id").alias("id"), *_named(simple_features(F.col("stats"))))
    b = with_statistics(recordings(spark, sf_dir)).select(F.lit("recording").alias("kind"), F.col("user_id").alias("id"), *_named(simple_features(F.col("stats")), {"rms", "peak"}))
    return a.unionByName(b, allowMissingColumns=True)


def mean_removed(spark, sf_dir):
    rows = segments(spark, sf_dir).withColumn("m", mean_of("x")).select("vec_id", centered("x", "m").alias("y"))
    return _sample_rows(rows, "y")


QUERIES = {
    f.__name__: f
    for f in (
        class_feature_summary, time_features_centered, time_features_raw, file_features, frames_exclusive, frames_inclusive, frame_features,
        adjacent_window_diff, waveform_prefix, spectrum_hann, spectrum_raw, rfft_axis, band_energy, band_energy_joined, amp_at_fault, hilbert_envelope, envelope_spectrum,
        full_feature_table, spectrogram_db, iir_lowpass, zero_phase_bandpass, square_law_envelope, bandpassed_envelope, fir_impulse, fir_filter,
        order_spectrum, union_features, mean_removed,
    )
}

_DFT_ROWS = f"SELECT vec_id, k::INTEGER AS k, {r6('mag')} AS mag FROM f1"
_BIN = f"(k * {float(FS)}::DOUBLE / n)"
ORACLES = {
    "class_feature_summary": f"WITH {SEGMENTS}{_sums('(SELECT * FROM e WHERE label IS NOT NULL)', 'label')} SELECT label, " + ", ".join(f"{r6(f'avg({_WHOLE[k]})', 4)} AS {k}" for k in ("rms", "kurtosis", "skewness", "crest_factor", "peak")) + " FROM s_ GROUP BY label",
    "time_features_centered": f"WITH {SEGMENTS}{_sums('e', 'vec_id')} SELECT vec_id, {_columns(_CENTERED)} FROM s_",
    "time_features_raw": f"WITH {SEGMENTS}{_sums('e', 'vec_id')} SELECT vec_id, {_columns(_SIMPLE)} FROM s_",
    "file_features": f"WITH {RECORDINGS}{_sums('v', 'user_id')} SELECT user_id, n::BIGINT AS n_samples, {_columns(_WHOLE)} FROM s_",
    "frames_exclusive": f"WITH {RECORDINGS}, {_framed(f'len(x) - {W}')} SELECT {_FRAME_COLUMNS} FROM f",
    "frames_inclusive": f"WITH {RECORDINGS}, {_framed(f'len(x) - {W} + 1')} SELECT {_FRAME_COLUMNS} FROM f",
    "frame_features": f"WITH {RECORDINGS}, {_framed(f'len(x) - {W}')}{_sums('f', 'user_id, start_idx')} SELECT user_id, start_idx, {_columns(_SIMPLE)} FROM s_",
    "adjacent_window_diff": f"WITH {RECORDINGS}, f AS (SELECT user_id, s AS start_idx, x[s + 1:s + {W}] AS x FROM (SELECT user_id, x, unnest(range(0, greatest(len(x) - {W}, 0), {_NEAR})) AS s FROM v)){_sums('f', 'user_id, start_idx')}, "
    f"t AS (SELECT user_id, start_idx, sqrt(sq / n) AS rms, sqrt(m2 / n) AS std, pk AS peak FROM s_), l AS (SELECT *, lead(rms) OVER w AS r2, lead(std) OVER w AS s2, lead(peak) OVER w AS p2 FROM t WINDOW w AS (PARTITION BY user_id ORDER BY start_idx)) "
    f"SELECT user_id, {framing.shared_share(W, 0.9)}::DOUBLE AS shared, {r6('abs(rms - r2) / (abs(rms) + 1e-8) * 100')} AS rms, {r6('abs(std - s2) / (abs(std) + 1e-8) * 100')} AS std, {r6('abs(peak - p2) / (abs(peak) + 1e-8) * 100')} AS peak FROM l WHERE start_idx = 0 AND r2 IS NOT NULL",
    "waveform_prefix": f"WITH {RECORDINGS} SELECT user_id, i::INTEGER AS i, {r6(f'i * 1000.0::DOUBLE / {FS}')} AS t_ms, {r6('x[i + 1]')} AS x FROM (SELECT user_id, x, unnest(range(0, least(len(x), 10))) AS i FROM v)",
    "spectrum_hann": f"WITH {SEGMENTS}, {_dft('f1', 'e', 'vec_id', _HANN, '2')} {_DFT_ROWS}",
    "spectrum_raw": f"WITH {SEGMENTS}, {_dft('f1', 'e', 'vec_id', '1', '1')} {_DFT_ROWS}",
    "rfft_axis": f"WITH {SEGMENTS}, n AS (SELECT DISTINCT len(x)::INTEGER AS n FROM e) SELECT n, k::INTEGER AS k, {r6(f'k * {float(FS)}::DOUBLE / n')} AS hz FROM (SELECT n, unnest(range(0, n // 2 + 1)) AS k FROM n)",
    "band_energy": f"WITH {SEGMENTS}, {_dft('f1', 'e', 'vec_id', _HANN, '2')}, b AS (SELECT unnest([{', '.join(map(str, BAND_EDGES[:-1]))}])::DOUBLE AS low, unnest([{', '.join(map(str, BAND_EDGES[1:]))}])::DOUBLE AS high) "
    f"SELECT vec_id, low, {r6(f'coalesce(sum(CASE WHEN {_BIN} >= low AND {_BIN} < high THEN mag * mag END), 0)', 9)} AS energy FROM f1, b GROUP BY vec_id, low",
    "band_energy_joined": f"WITH {SEGMENTS}, {_dft('f1', 'e', 'vec_id', _HANN, '2')}, b AS (SELECT unnest([{', '.join(map(str, BAND_EDGES[:-1]))}])::DOUBLE AS low, unnest([{', '.join(map(str, BAND_EDGES[1:]))}])::DOUBLE AS high) "
    f"SELECT vec_id, low, high, {r6('sum(mag * mag)', 9)} AS energy FROM f1 JOIN b ON {_BIN} >= low AND {_BIN} < high GROUP BY vec_id, low, high",
    "amp_at_fault": f"WITH {SEGMENTS}, {_dft('f1', 'e', 'vec_id', _HANN, '2')} SELECT vec_id, " + ", ".join(f"{r6(f'coalesce(max(CASE WHEN abs({_BIN} - {m * 1797 / 60.0!r}::DOUBLE) <= 100 THEN mag END), 0)')} AS {k}" for k, m in FAULT_MULTIPLIERS.items()) + " FROM f1 GROUP BY vec_id",
    "hilbert_envelope": f"WITH {SEGMENTS}, {_hilbert('e', 'vec_id')} SELECT vec_id, i::INTEGER AS i, {r6('env')} AS env FROM h",
    "envelope_spectrum": f"WITH {SEGMENTS}, {_hilbert('e', 'vec_id')}, {_dft('f1', 'he', 'vec_id', _HANN, '2')} {_DFT_ROWS}",
    "full_feature_table": _full_oracle(),
    "spectrogram_db": _spectrogram_oracle(),
    **_filter_oracles(),
    "bandpassed_envelope": _bandpassed_oracle(),
    "fir_impulse": _FIR,
    "fir_filter": _FIR_FILTER,
    "order_spectrum": f"WITH {SEGMENTS}, {_dft('f1', 'e', 'vec_id', '1', '1')}, o AS (SELECT vec_id, k::INTEGER AS k, {r6(f'{_BIN} / {_RPM5}')} AS \"order\", {r6('mag')} AS mag FROM f1) SELECT * FROM o WHERE \"order\" <= 12",
    "union_features": f"WITH {SEGMENTS}, {RECORDINGS}, u AS (SELECT 'segment' AS kind, vec_id AS id, x FROM e UNION ALL SELECT 'recording', user_id, x FROM v){_sums('u', 'kind, id')} SELECT kind, id, {r6(_SIMPLE['rms'])} AS rms, {r6('pk')} AS peak, "
    + ", ".join(f"CASE WHEN kind = 'segment' THEN {r6(_SIMPLE[k])} END AS {k}" for k in ("kurtosis", "skewness", "std")) + " FROM s_",
    "mean_removed": f"WITH {SEGMENTS}, c AS (SELECT vec_id, list_transform(x, lambda v: v - list_sum(x) / len(x)) AS x FROM e) " + _SAMPLES.format("c"),
}
