"""A small feed-forward classifier: rectified layers with dropout, Adam, early stopping with the best weights.

Many fits go together, each of any number of rows. A fit's rows are dealt by the hash of
their keys to lanes of about LANE_VALUES numbers, a lane to a row of a written table. A
round is one job for all fits: every lane goes once over its rows in batches, from the
fit's weights and moments, and the lanes' results are averaged by their numbers of rows
(local steps with averaging). What a lane computes depends on the fit, the lane and the
round only, so the number of tasks doesn't matter. A fit of one lane has nothing to
average: it is the plain sequential one, and goes through all its rounds in one job with
the others of its kind. A round begins with the loss of the weights it starts from on the rows
held back, so a fit is stopped by all its lanes together. Only weights go through the
driver. A lost executor costs the lanes it was at.

Rows with a null or non-finite feature or a null label take no part. Without validation
rows nothing stops the fit early, and the last weights stay. Without training rows the
first weights stay.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import Staged

#: Numbers that a lane's rows have in all.
LANE_VALUES = 2_000_000

Layers = list[tuple[np.ndarray, np.ndarray]]


def first_layers(sizes: list[int], rng: np.random.Generator) -> Layers:
    """Uniform weights within sqrt(6 / (inputs + outputs)), no offsets."""
    out = []
    for n, m in zip(sizes, sizes[1:], strict=False):
        reach = np.sqrt(6 / (n + m))
        out.append((rng.uniform(-reach, reach, (n, m)), np.zeros(m)))
    return out


def probabilities(layers: Layers, x: np.ndarray) -> np.ndarray:
    for k, (w, b) in enumerate(layers):
        x = x @ w + b
        if k < len(layers) - 1:
            x = np.maximum(x, 0)
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def loss(layers: Layers, x: np.ndarray, y: np.ndarray) -> float:
    """Mean cross entropy."""
    return float(-np.log(np.maximum(probabilities(layers, x)[np.arange(len(y)), y], 1e-12)).mean())


def gradients(layers: Layers, x: np.ndarray, y: np.ndarray, masks: list[np.ndarray]) -> list[np.ndarray]:
    """Of the mean cross entropy by each layer's weights and offsets; masks scale the hidden values."""
    values = [x]
    for (w, b), mask in zip(layers[:-1], masks, strict=True):
        values.append(np.maximum(values[-1] @ w + b, 0) * mask)
    slope = probabilities(layers[-1:], values[-1])
    slope[np.arange(len(y)), y] -= 1
    slope /= len(y)
    out: list[np.ndarray] = []
    for k in range(len(layers) - 1, -1, -1):
        out = [values[k].T @ slope, slope.sum(0), *out]
        if k:
            slope = (slope @ layers[k][0].T) * (values[k] > 0) * masks[k - 1]
    return out


@dataclass
class Fit:
    """Weights (and offsets, layer by layer), Adam's moments and steps, and what early stopping remembers."""

    flat: list[np.ndarray]
    mean: list[np.ndarray] = field(default_factory=list)
    square: list[np.ndarray] = field(default_factory=list)
    steps: float = 0.0
    best: float = np.inf
    kept: list[np.ndarray] | None = None
    waited: int = 0

    def __post_init__(self) -> None:
        self.mean = self.mean or [np.zeros_like(p) for p in self.flat]
        self.square = self.square or [np.zeros_like(p) for p in self.flat]

    @property
    def layers(self) -> Layers:
        return list(zip(self.flat[::2], self.flat[1::2], strict=True))

    @property
    def final(self) -> Layers:
        flat = self.flat if self.kept is None else self.kept
        return list(zip(flat[::2], flat[1::2], strict=True))

    def packed(self) -> np.ndarray:
        return np.concatenate([np.array([self.steps]), *(p.ravel() for p in (*self.flat, *self.mean, *self.square))])

    def unpacked(self, numbers: np.ndarray) -> None:
        self.steps, at = float(numbers[0]), 1
        for part in (self.flat, self.mean, self.square):
            for k, p in enumerate(part):
                part[k] = numbers[at : at + p.size].reshape(p.shape).copy()
                at += p.size

    def judged(self, held_loss: float, patience: int) -> bool:
        """Takes note of the loss on the rows held back; whether the fit is over."""
        if held_loss < self.best:
            self.best, self.kept, self.waited = held_loss, [p.copy() for p in self.flat], 0
            return False
        self.waited += 1
        return self.waited >= patience


def once(fit: Fit, x: np.ndarray, y: np.ndarray, rng: np.random.Generator, dropout: float = 0.2, batch: int = 32, rate: float = 1e-3) -> None:
    """One pass over (x, y) in batches."""
    order = rng.permutation(len(x))
    for k in range(0, len(x), batch):
        rows = order[k : k + batch]
        masks = [(rng.random((len(rows), len(p))) >= dropout) / (1 - dropout) for p in fit.flat[1:-2:2]]
        fit.steps += 1
        for p, g, m, s in zip(fit.flat, gradients(fit.layers, x[rows], y[rows], masks), fit.mean, fit.square, strict=True):
            m += 0.1 * (g - m)
            s += 0.001 * (g * g - s)
            p -= rate * (m / (1 - 0.9**fit.steps)) / (np.sqrt(s / (1 - 0.999**fit.steps)) + 1e-7)


def fresh(width: int, classes: int, hidden: tuple[int, ...], seed: int) -> Fit:
    return Fit([p for layer in first_layers([width, *hidden, classes], np.random.default_rng(seed)) for p in layer])


def generator(seed: int, run: str, lane: int, turn: int) -> np.random.Generator:
    return np.random.default_rng([seed, zlib.crc32(run.encode()), lane, turn])


def trained(x, y, vx, vy, classes: int, hidden=(64, 32), rounds=100, patience=15, seed=42, run: str = "") -> Layers:
    """The fit of one lane, without Spark: passes over (x, y) until rounds are done or the loss on (vx, vy) hasn't improved for patience passes."""
    fit = fresh(x.shape[1], classes, hidden, seed)
    for turn in range(rounds if len(x) else 0):
        once(fit, x, y, generator(seed, run, 0, turn))
        if len(vx) and fit.judged(loss(fit.layers, vx, vy), patience):
            break
    return fit.final


def _usable(columns: list[Column]) -> Column:
    found = F.lit(True)
    for c in columns:
        found = found & F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))
    return found


def _numbers(df: DataFrame, columns: list[str]) -> list[Column]:
    return [F.col(f"`{c}`").cast("double") for c in columns]


def lanes_of(rows: DataFrame, lane_values: int = LANE_VALUES) -> tuple[Staged, dict[str, tuple[int, int]]]:
    """(run, lane, train_x, train_y, test_x, test_y) of rows (run, key, held, y, x), a row a lane; and each run's width of x and number of lanes. Runs are few."""
    sizes = rows.groupBy("run").agg(F.sum(F.size("x")).alias("values"), F.max(F.size("x")).alias("width")).collect()
    lanes = [(r.run, max(1, -(-r["values"] // lane_values))) for r in sizes]
    counts = F.broadcast(rows.sparkSession.createDataFrame(lanes, "run string, lanes bigint"))
    dealt = rows.join(counts, "run").withColumn("lane", F.pmod(F.xxhash64("key"), "lanes"))
    order = F.array_sort(F.collect_list(F.struct(F.xxhash64(F.lit(1), "key").alias("h"), "x", "y")))
    packed = dealt.groupBy("run", "lane", "held").agg(order.alias("s"))
    packed = packed.groupBy("run", "lane").agg(*(F.first(F.when(F.col("held") == side, F.col("s")), True).alias(name) for name, side in (("train", False), ("test", True))))
    columns = [F.flatten(F.transform(s, lambda v: v["x"])).alias(f"{s}_x") for s in ("train", "test")] + [F.transform(s, lambda v: v["y"]).alias(f"{s}_y") for s in ("train", "test")]
    spread = packed.select("run", "lane", *columns).repartition(max(1, sum(n for _, n in lanes)), "run", "lane")
    return Staged(spread, "network-lanes"), {r.run: (r.width, n) for r, (_, n) in zip(sizes, lanes, strict=True)}


def _rows_of(batch: pa.RecordBatch, k: int, side: str, width: int) -> tuple[np.ndarray, np.ndarray]:
    x, y = (batch.column(f"{side}_{c}")[k] for c in "xy")
    if not y.is_valid:
        return np.zeros((0, width)), np.zeros(0, int)
    return x.values.to_numpy(zero_copy_only=False).reshape(-1, width), y.values.to_numpy(zero_copy_only=False).astype(int)


_SUMS = "run string, rows bigint, held bigint, held_loss double, numbers array<double>"


def _summed(parts: Iterator[tuple[str, int, int, float, np.ndarray | None]]) -> pa.Table:
    """Sums by run of (run, rows, held rows, their loss, numbers times rows)."""
    sums: dict[str, list] = {}
    for run, rows, held, held_loss, numbers in parts:
        one = sums.setdefault(run, [0, 0, 0.0, None])
        one[0], one[1], one[2] = one[0] + rows, one[1] + held, one[2] + held_loss
        if numbers is not None:
            one[3] = numbers if one[3] is None else one[3] + numbers
    columns = list(zip(*sums.values(), strict=True)) or [[], [], [], []]
    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.float64()))
    return pa.table([pa.array(sums.keys(), pa.string()), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["run", "rows", "held", "held_loss", "numbers"])


def a_round(lanes: DataFrame, fits: dict[str, Fit], seed: int, turn: int, learn: bool) -> list:
    """One job: by run the rows, the loss of its weights on the rows held back (a sum), and the average of what its lanes make of them (times rows)."""
    sent = lanes.sparkSession.sparkContext.broadcast(fits)

    def each(batch: pa.RecordBatch) -> Iterator[tuple]:
        for k in range(batch.num_rows):
            run, lane = batch.column("run")[k].as_py(), batch.column("lane")[k].as_py()
            given = sent.value[run]
            fit = Fit([p.copy() for p in given.flat], [p.copy() for p in given.mean], [p.copy() for p in given.square], given.steps)
            vx, vy = _rows_of(batch, k, "test", len(fit.flat[0]))
            held_loss = loss(fit.layers, vx, vy) * len(vx) if len(vx) else 0.0
            x, y = _rows_of(batch, k, "train", len(fit.flat[0]))
            if learn and len(x):
                once(fit, x, y, generator(seed, run, lane, turn))
            yield run, len(x), len(vx), held_loss, fit.packed() * len(x) if len(x) else None

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _summed(one for batch in batches for one in each(batch)).to_batches()

    def together(_: tuple, part: pa.Table) -> pa.Table:
        numbers = (None if v is None else np.array(v) for v in (x.as_py() for x in part["numbers"]))
        return _summed(zip(*(part[c].to_pylist() for c in ("run", "rows", "held", "held_loss")), numbers, strict=True))

    some = lanes.filter(F.col("run").isin(list(fits)))
    found = some.mapInArrow(task, _SUMS).groupBy("run").applyInArrow(together, _SUMS).collect()
    sent.unpersist()
    return found


def whole_fits(lanes: DataFrame, widths: dict[str, int], classes: int, hidden: tuple[int, ...], rounds: int, patience: int, seed: int) -> dict[str, Fit]:
    """The fits that have one lane, in one job."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, name in enumerate(batch.column("run").to_pylist()):
                sides = [v for side in ("train", "test") for v in _rows_of(batch, k, side, widths[name])]
                made = trained(*sides, classes, hidden, rounds, patience, seed, name)
                numbers = np.concatenate([p.ravel() for layer in made for p in layer])
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([numbers], pa.list_(pa.float64()))], names=["run", "numbers"])

    found = {name: fresh(width, classes, hidden, seed) for name, width in widths.items()}
    for r in lanes.filter(F.col("run").isin(list(widths))).mapInArrow(run, "run string, numbers array<double>").collect() if widths else []:
        fit, at = found[r.run], 0
        for k, p in enumerate(fit.flat):
            fit.flat[k] = np.array(r.numbers[at : at + p.size]).reshape(p.shape)
            at += p.size
    return found


def fit_all(rows: DataFrame, classes: int, hidden: tuple[int, ...] = (64, 32), rounds: int = 100, patience: int = 15, seed: int = 42, lane_values: int = LANE_VALUES) -> dict[str, Layers]:
    """The networks of all runs in rows (run, key, held, y, x: array of finite numbers, as many in every row of a run)."""
    lanes, runs = lanes_of(rows, lane_values)
    fits = whole_fits(lanes.df, {run: width for run, (width, n) in runs.items() if n == 1}, classes, hidden, rounds, patience, seed)
    open_ = {run: fresh(width, classes, hidden, seed) for run, (width, n) in runs.items() if n > 1}
    fits |= open_
    for turn in range(rounds + 1):
        if not open_:
            break
        for r in a_round(lanes.df, open_, seed, turn, turn < rounds):
            fit = fits[r.run]
            if not r.rows or turn and r.held and fit.judged(r.held_loss / r.held, patience):
                del open_[r.run]
            elif turn < rounds:
                fit.unpacked(np.array(r.numbers) / r.rows)
    lanes.drop()
    return {run: fit.final for run, fit in fits.items()}


def fit(df: DataFrame, columns: list[str], label: str, held: Column, key: str, classes: int, rounds: int = 100, seed: int = 42, lane_values: int = LANE_VALUES) -> Layers:
    """The network fit on df's usable rows; those with held are for validation."""
    x = _numbers(df, columns)
    rows = df.filter(_usable(x) & F.col(label).isNotNull())
    rows = rows.select(F.lit("").alias("run"), F.col(key).alias("key"), F.coalesce(held, F.lit(False)).alias("held"), F.col(label).cast("int").alias("y"), F.array(*x).alias("x"))
    return fit_all(rows, classes, rounds=rounds, seed=seed, lane_values=lane_values).get("") or fresh(len(columns), classes, (64, 32), seed).final


def predicted_by_run(rows: DataFrame, fitted: dict[str, Layers]) -> DataFrame:
    """(run, y, prediction) of rows (run, y, x) whose run was fit."""
    sent = rows.sparkSession.sparkContext.broadcast(fitted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs, out = np.array(batch.column("run").to_pylist(), object), np.zeros(batch.num_rows)
            for name in set(runs):
                of = np.flatnonzero(runs == name)
                x = batch.column("x").take(pa.array(of)).flatten().to_numpy(zero_copy_only=False).reshape(len(of), -1)
                out[of] = probabilities(sent.value[name], x).argmax(1)
            yield pa.RecordBatch.from_arrays([batch.column("run"), batch.column("y"), pa.array(out)], names=["run", "y", "prediction"])

    known = rows.filter(F.col("run").isin(list(fitted)))
    return known.select("run", F.col("y").cast("double").alias("y"), "x").mapInArrow(run, "run string, y double, prediction double")


def predicted(df: DataFrame, layers: Layers, columns: list[str], label: str) -> DataFrame:
    """(y, prediction) of df's usable rows."""
    x = _numbers(df, columns)
    rows = df.filter(_usable(x)).select(F.lit("").alias("run"), F.col(label).alias("y"), F.array(*x).alias("x"))
    return predicted_by_run(rows, {"": layers}).select("y", "prediction")
