"""Queries over recordings longer than a row: the events of a type in order of time, sample by sample.

No task holds a recording. Blocks and bundles are small here, so that even small tables
have several of them a recording.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import FS
from ..functions import filters
from ..functions.statistics import rounded
from ..operators import feature_tables, long_filters, long_signals, long_spectra
from ..staging import staged
from .signals import _SIMPLE, OVERLAP, STEP, W, _columns, _filter, _sums
from .standins import r6, samples

BLOCK = 1024
CELLS = 4096


def _blocks(spark: SparkSession, sf_dir: str, after: int = 0) -> DataFrame:
    rows = long_signals.numbered(samples(spark, sf_dir), "event_type", ["ts", "event_id"], "value")
    return long_signals.blocks_of(rows, BLOCK, 0, after)


def long_frames(spark, sf_dir):
    """First, last and sum of every window (exclusive framing)."""
    rows = long_signals.frames(_blocks(spark, sf_dir, W), W, OVERLAP, False)
    w = F.col("window")
    total = F.aggregate(w, F.lit(0.0), lambda a, v: a + v)
    return rows.select(F.col("key").alias("event_type"), "start_idx", rounded(w[0]).alias("first"), rounded(w[W - 1]).alias("last"), rounded(total).alias("total"))


def long_frame_features(spark, sf_dir):
    """The five features of every window (inclusive framing)."""
    rows = long_signals.features(_blocks(spark, sf_dir, W), W, OVERLAP, inclusive=True)
    return rows.select(F.col("key").alias("event_type"), "start_idx", *(rounded(F.col(k)).alias(k) for k in feature_tables.SIMPLE))


def long_bandpass(spark, sf_dir):
    blocks = long_filters.bandpass(_blocks(spark, sf_dir), FS, 1000.0, 4000.0, size=BLOCK)
    return long_signals.samples_of(blocks).select(F.col("key").alias("event_type"), "i", rounded(F.col("x")).alias("y"))


def long_spectrum(spark, sf_dir):
    rows = long_spectra.magnitudes(long_spectra.pieces_of(_blocks(spark, sf_dir)), cells=CELLS)
    return rows.select(F.col("key").alias("event_type"), "k", rounded(F.col("mag")).alias("mag"))


def long_envelope(spark, sf_dir):
    """The Hilbert envelope of the recordings less their mean."""
    blocks = staged(_blocks(spark, sf_dir), "long-blocks")
    means = blocks.groupBy("key").agg((F.sum(F.aggregate("x", F.lit(0.0), lambda a, v: a + v)) / F.first("n")).alias("mean"))
    level = blocks.join(long_signals.few(staged(means, "long-means")), "key").withColumn("x", F.transform("x", lambda v: v - F.col("mean")))
    runs = long_spectra.envelope(long_spectra.pieces_of(level), cells=CELLS)
    return runs.select(F.col("key").alias("event_type"), "at", F.posexplode("x").alias("p", "v")).select("event_type", (F.col("at") + F.col("p")).alias("i"), rounded(F.col("v")).alias("env"))


QUERIES = {f.__name__: f for f in (long_frames, long_frame_features, long_bandpass, long_spectrum, long_envelope)}

_TYPES = "v AS (SELECT event_type, list(value ORDER BY ts, event_id) AS x FROM events GROUP BY event_type)"
_LEVEL = f"{_TYPES}, u AS (SELECT event_type AS vec_id, list_transform(x, lambda t: t - list_avg(x)) AS x FROM v)"


def _framed(last: str) -> str:
    return f"f AS (SELECT event_type, s AS start_idx, x[s + 1:s + {W}] AS x FROM (SELECT event_type, x, unnest(range(0, greatest({last}, 0), {STEP})) AS s FROM v))"


def _spectrum() -> str:
    return f"""WITH {_TYPES}, s AS (SELECT event_type, len(x) AS n, unnest(x) AS y, generate_subscripts(x, 1) - 1 AS i FROM v),
k AS (SELECT event_type, unnest(range(0, len(x) // 2 + 1)) AS k FROM v),
m AS (SELECT event_type, k, sqrt(pow(sum(y * cos(2 * pi() * (k * i % n) / n)), 2) + pow(sum(y * sin(2 * pi() * (k * i % n) / n)), 2)) / any_value(n) AS mag FROM s JOIN k USING (event_type) GROUP BY event_type, k)
SELECT event_type, k, {r6('mag')} AS mag FROM m"""


def _envelope() -> str:
    """The kernel of the discrete Hilbert transform, for even and for odd lengths."""
    return f"""WITH {_LEVEL}, s AS (SELECT vec_id, len(x) AS n, unnest(x) AS y, generate_subscripts(x, 1) - 1 AS j FROM u), t AS (SELECT vec_id, j AS i, y AS own FROM s),
h AS (SELECT vec_id, i, any_value(own) AS own, sum(CASE WHEN i = j THEN 0 WHEN n % 2 = 0 THEN CASE WHEN (i - j) % 2 <> 0 THEN y * 2.0::DOUBLE / n / tan(pi() * (i - j) / n) ELSE 0 END
    ELSE y / n * (cos(pi() * (i - j) / n) - CASE WHEN (i - j) % 2 = 0 THEN 1 ELSE -1 END) / sin(pi() * (i - j) / n) END) AS other FROM s JOIN t USING (vec_id) GROUP BY vec_id, i)
SELECT vec_id AS event_type, i, {r6('sqrt(own * own + other * other)')} AS env FROM h"""


_FOUR = filters.bandpass(1000.0, 4000.0, FS, 4, False)
ORACLES = {
    "long_frames": f"WITH {_TYPES}, {_framed(f'len(x) - {W}')} SELECT event_type, start_idx, {r6('x[1]')} AS first, {r6(f'x[{W}]')} AS last, {r6('list_sum(x)')} AS total FROM f",
    "long_frame_features": f"WITH {_TYPES}, {_framed(f'len(x) - {W} + 1')}{_sums('f', 'event_type, start_idx')} SELECT event_type, start_idx, {_columns(_SIMPLE)} FROM s_",
    "long_bandpass": f"WITH RECURSIVE {_TYPES}, e AS (SELECT event_type AS vec_id, x FROM v), {_filter('b', 'e', *_FOUR.ba, _FOUR.pad)} SELECT vec_id AS event_type, i, {r6('x[i + 1]')} AS y FROM (SELECT vec_id, x, unnest(range(0, len(x))) AS i FROM b)",
    "long_spectrum": _spectrum(),
    "long_envelope": _envelope(),
}
