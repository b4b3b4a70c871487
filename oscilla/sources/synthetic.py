"""Synthetic recordings: rotation, noise and a decaying carrier at each fault impulse."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from pathlib import PurePosixPath

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import FS, RPM_BY_LOAD
from ..functions.kinematics import fault_frequencies
from . import matfile

TAPS, DECAY, CARRIER, GAIN, UNBALANCE = 200, 15.0, 2500.0, 1.5, 0.5
FAULT_OF_LABEL = {"IR": "BPFI", "OR": "BPFO", "B": "BSF"}


def taps(fs: float = FS, carrier: float = CARRIER) -> np.ndarray:
    k = np.arange(TAPS)
    return np.exp(-k / DECAY) * np.sin(2 * np.pi * carrier * k / fs)


def sample(i: Column, fs: int, rpm: Column, fault_hz: Column | None = None, carrier: float = CARRIER) -> Column:
    """Sample i of a recording without noise, of built-in expressions: it adds up the impulses of the last TAPS samples."""
    x = UNBALANCE * F.sin(2 * np.pi * rpm / 60.0 * i / fs)
    if fault_hz is None:
        return x
    first = F.greatest(F.lit(0), F.ceil((i - TAPS + 1) / fs * fault_hz) - 1).cast("long")
    last = F.floor((i + 1) / fs * fault_hz).cast("long") + 1
    lags = F.transform(F.sequence(first, last), lambda j: i - F.floor(j / fault_hz * fs))
    live = F.filter(F.array_distinct(lags), lambda lag: (lag >= 0) & (lag < TAPS))
    return x + GAIN * F.aggregate(live, F.lit(0.0), lambda a, lag: a + F.exp(-lag / F.lit(DECAY)) * F.sin(2 * np.pi * carrier * lag / fs))


def signal_rows(spark: SparkSession, fs: int, seconds: float, rpm: float, fault_hz: float | None = None, carrier: float = CARRIER, noise: float = 0.3, seed: int = 0) -> DataFrame:
    """(i, t, x), a sample a row."""
    i = F.col("id")
    x = sample(i, fs, F.lit(float(rpm)), F.lit(float(fault_hz)) if fault_hz else None, carrier)
    if noise:
        x = x + noise * F.randn(seed)
    return spark.range(int(round(fs * seconds))).select(i.alias("i"), (i / fs).alias("t"), x.alias("x"))


def signal(fs: int, seconds: float, rpm: float, fault_hz: float | None, noise: float, seed: int) -> np.ndarray:
    """The same for one recording, in numpy, for the writers of files."""
    n = int(round(fs * seconds))
    x = UNBALANCE * np.sin(2 * np.pi * rpm / 60.0 * np.arange(n) / fs) + noise * np.random.default_rng(seed).standard_normal(n)
    if fault_hz:
        hits = np.zeros(n)
        at = np.floor(np.arange(int(seconds * fault_hz) + 1) / fault_hz * fs).astype(int)
        hits[at[at < n]] = 1
        x += GAIN * np.convolve(hits, taps(fs))[:n]
    return x


def plan(spark: SparkSession, loads=(0, 1, 2, 3), diameters=(7, 14, 21)) -> DataFrame:
    """path, load, label, rpm, fault_hz of every file: a normal one and each fault and diameter, at each load."""
    of_load = spark.createDataFrame([(k, RPM_BY_LOAD[k]) for k in loads], "load int, rpm int")
    faults = spark.createDataFrame([(label, name) for label, name in FAULT_OF_LABEL.items()], "label string, fault string")
    sizes = spark.createDataFrame([(d,) for d in diameters], "mils int")
    hz = F.create_map(*(x for name, c in fault_frequencies(F.col("rpm")).items() for x in (F.lit(name), c)))
    suffix = F.when(F.col("label") == "OR", "_Centered").otherwise("")
    path = F.format_string("%dhp/%s_%03d%s.mat", "load", "label", "mils", suffix)
    faulty = of_load.crossJoin(faults).crossJoin(sizes).select(path.alias("path"), "load", "label", "rpm", F.element_at(hz, F.col("fault")).alias("fault_hz"))
    normal = of_load.select(F.format_string("%dhp/Normal.mat", "load").alias("path"), "load", F.lit("Normal").alias("label"), "rpm", F.lit(None).cast("double").alias("fault_hz"))
    return normal.unionByName(faulty)


def recordings(files: DataFrame, fs: int = FS, seconds: float = 10.0, noise: float = 0.3, seed: int = 0) -> DataFrame:
    """plan's rows with their signal (array); the noise of a file depends on its path and seed alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [
                signal(fs, seconds, rpm, hz, noise, int.from_bytes(hashlib.md5(f"{seed}|{path}".encode()).digest()[:4]))
                for path, rpm, hz in zip(*(batch.column(c).to_pylist() for c in ("path", "rpm", "fault_hz")), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.list_(pa.float64()))], names=[*batch.schema.names, "signal"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in files.schema)
    return files.mapInArrow(run, schema + ", signal array<double>")


def write_files(recordings_: DataFrame, root: str) -> int:
    """Writes the recordings below root, in any store that ``matfile`` writes to; returns their number. Nothing is deleted."""
    named = lambda name, data: F.struct(F.lit(name).alias("var"), data.alias("data"))
    variables = F.array(named("X999_DE_time", F.col("signal")), named("X999RPM", F.array(F.col("rpm").cast("double"))))
    return matfile.write(recordings_.select("path", variables.alias("variables")), root)


#: Path, sampling rate, rpm and the code that each planted defect must give.
EDGE_CASES = (
    ("0hp/Normal.mat", 48_000, 1797, "NGHI_NGO_SAMPLING_RATE"),
    ("0hp/OR_007_Orthogonal.mat", FS, 1797, "OR_NGOAI_PHAM_VI"),
    ("0hp/B_028.mat", FS, 1797, "VONG_BI_NTN"),
    ("1hp/IR_014.mat", FS, 1650, "RPM_LECH"),
)


def write_edge_cases(root: str, seconds: float = 10.0) -> tuple[str, ...]:
    """Writes the four planted defects below root and returns the codes to expect; nothing is deleted."""
    import os

    for path, fs, rpm, _ in EDGE_CASES:
        target = PurePosixPath(root) / path
        os.makedirs(target.parent, exist_ok=True)
        seed = int.from_bytes(hashlib.md5(path.encode()).digest()[:4])
        with open(target, "wb") as file:
            file.write(matfile.encoded({"X999_DE_time": signal(fs, seconds, rpm, None, 0.3, seed), "X999RPM": np.array([[rpm]])}))
    return tuple(code for *_, code in EDGE_CASES)
