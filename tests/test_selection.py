import math

import numpy as np
import pytest
from oscilla.functions import spectral
from oscilla.operators import selection, summary

SHARES = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]


def groups():
    rng = np.random.default_rng(2)
    return {
        "even": rng.normal(size=1000),
        "odd": rng.normal(size=333),
        "ties": rng.integers(0, 3, 500).astype(float),
        "constant": np.full(40, 7.5),
        "one": np.array([-2.0]),
        "two": np.array([1.0, 4.0]),
        "wide": np.array([-1.7e308, 1.7e308, 0.0, 1e-300, 5e-324, 1.0, 2.0]),
        "powers": 2.0 ** np.arange(-1000, 1000, 7),
        "dense": 1.0 + np.arange(300) * 2.0**-52,
    }


@pytest.mark.parametrize("bins", [256, selection.BINS])
def test_quantiles_are_exact(spark, bins):
    data = groups()
    rows = [(k, float(v)) for k, x in data.items() for v in x] + [("even", None), ("odd", math.nan), (None, 1.0)]
    got = {r.name: (r.n, r.q) for r in selection.quantiles(spark.createDataFrame(rows, "name string, value double"), "name", "value", SHARES, bins).collect()}
    assert got.keys() == data.keys()
    for k, x in data.items():
        assert got[k][0] == len(x)
        with np.errstate(over="ignore"):
            s = np.sort(x)
            for p, q in zip(SHARES, got[k][1], strict=True):
                low, high = s[math.floor(p * (len(s) - 1))], s[math.ceil(p * (len(s) - 1))]
                assert low <= q <= high
                if k not in ("wide", "powers"):
                    assert q == pytest.approx(np.quantile(x, p), rel=1e-12, abs=1e-15)


def test_infinities(spark):
    rows = [(1, v) for v in (-math.inf, -math.inf, 1.0, 2.0, 3.0, math.inf)] + [(2, math.inf)]
    got = {r.name: r.q for r in selection.quantiles(spark.createDataFrame(rows, "name int, value double"), "name", "value", [0.0, 0.2, 0.4, 0.6, 1.0]).collect()}
    assert got == {1: [-math.inf, -math.inf, 1.0, 2.0, math.inf], 2: [math.inf] * 5}


def test_no_rows(spark):
    assert selection.quantiles(spark.createDataFrame([], "name int, value double"), "name", "value", [0.5]).count() == 0


def test_boxplot_ways_agree(spark):
    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([(int(k % 3), float(v)) for k, v in enumerate(rng.normal(size=900))], "name int, value double")
    exact, near = ({r.name: r.asDict() for r in summary.boxplot(rows, "name", "value", a).collect()} for a in (None, 100_000))
    for k, row in exact.items():
        assert row["n"] == near[k]["n"] == 300 and row["mean"] == pytest.approx(near[k]["mean"])
        assert row["low"] <= row["q1"] <= row["median"] <= row["q3"] <= row["high"] and row["median"] == pytest.approx(near[k]["median"], abs=0.05)


def test_bands_by_bins(spark):
    """Against all pairs; frequencies on edges, bands that overlap, touch, are empty or wider than a cell."""
    rng = np.random.default_rng(4)
    spectra = [(k, float(h), float(rng.random())) for k in range(3) for h in range(0, 100, 5)]
    bands = [(0.0, 10.0), (10.0, 35.0), (30.0, 31.0), (31.0, 34.0), (7.0, 93.0), (50.0, 50.0), (200.0, 210.0), (95.0, 96.0), (None, 3.0)]
    df = spark.createDataFrame(spectra, "key int, hz double, mag double")
    found = spectral.band_energy_by_bins(df, spark.createDataFrame(bands, "low double, high double"), 25.0)
    want = {}
    for k, h, v in spectra:
        for low, high in bands:
            if low is not None and low <= h < high:
                want[k, low, high] = want.get((k, low, high), 0) + v * v
    assert {(r.key, r.low, r.high): pytest.approx(r.energy) for r in found.collect()} == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
