"""Quality classifier: Bradley-Terry ranking learned from preference pairs.

A document's features are shares and rates of its whole text (symbols, letters,
repeats, line shapes ...), each spread over quantile bins so that the score can
bend. Every pair of a document labelled 1 and one labelled 0 is a preference; the
weights minimise the mean logistic loss of the differences of all these pairs' features. The raw
score of the training documents' quantile at the share of label 0 is the threshold:
scores are scaled to (0, 1) with the threshold at THRESHOLD.

All labelled rows that aren't held out teach, none is drawn. The sum over all pairs is never
written out: what a document adds to the slope depends on its raw score and on the other
label's raw scores only, so a Newton step is two passes, one that counts the raw scores in
cells of CELL, one that adds up the features with the weights found from these counts. The
mean of a cell stands for its scores, which leaves an error of CELL squared. Quantiles are
exact (``selection``). The driver gets sums whose size follows the features, not the rows.

Nulls: a null text counts as empty and gets the score of its (empty) features;
labels with null quality or doc_id teach nothing; a null doc_id isn't held out.
Without labels of both kinds nothing can be learned and every score is 1.
Repeated rows get equal scores. Extra columns are kept by ``accepted``.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..operators import selection
from .common import arrow_map, staged, table, texts, tune

PAIRS = 60_000
BINS = 8
#: Widths of the cells of raw scores: for the slope, and for a term of the curvature, which only sets the pace.
CELL, WIDE = 1 / 64, 1 / 8
RIDGE = 1e-3
THRESHOLD = 0.7
SEED = 20

_UPPER = bytes(range(65, 91))
_LETTERS = bytes([*range(65, 91), *range(97, 123), *range(128, 256)])
_SYMBOLS = b"*#$%&@^~_=<>{}[]\\"
FEATURES = ("words", "length", "distinct", "word_length", "longest", "upper", "symbols", "pipes", "shouts", "digits", "stops", "other", "lines", "repeated", "most", "lines_repeated", "line_words", "bare_words", "title", "short_lines")


def features(text: str) -> list[float]:
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n, size = len(words), len(raw)
    if not n:
        return [0.0] * len(FEATURES)
    lost = lambda chars: (size - len(raw.translate(None, chars))) / size
    lines = raw.split(b"\n")
    counts = Counter(words)
    joined = sum(map(len, words))
    return [
        np.log1p(n),
        np.log1p(size),
        len(counts) / n,
        joined / n,
        float(max(map(len, words))),
        lost(_UPPER),
        lost(_SYMBOLS),
        raw.count(b"|") / n,
        raw.count(b"!") / n,
        lost(b"0123456789"),
        (raw.count(b".") + raw.count(b",")) / n,
        1 - lost(_LETTERS),
        len(lines) / n,
        sum(map(eq, words, islice(words, 1, None))) / n,
        max(counts.values()) / n,
        1 - len(set(lines)) / len(lines),
        n / len(lines),
        sum(map(bytes.isalpha, counts)) / len(counts),
        sum(map(bytes.istitle, counts)) / len(counts),
        sum(len(x) < 30 for x in lines) / len(lines),
    ]


@dataclass
class Model:
    low: np.ndarray  # features beyond what was seen in training count as the furthest seen
    high: np.ndarray
    edges: np.ndarray  # bin edges by feature
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    spread: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return expanded(np.clip(x, self.low, self.high), self.edges, self.mean, self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        z = (self.raw(x) - self.threshold) / self.spread + np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def expanded(x: np.ndarray, edges: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    steps = [(x[:, k : k + 1] > edges[k]).astype(float) for k in range(x.shape[1])]
    return np.hstack([(x - mean) / scale, *steps])


def fit(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, seed: int = SEED, ridge: float = 1e-3) -> Model | None:
    """Weights for rows in memory, of drawn pairs; None without both labels. The queries learn of all pairs, by ``fit_all``."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return None
    edges = np.quantile(x, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T
    mean, scale = x.mean(0), x.std(0)
    scale[scale == 0] = 1
    z = expanded(x, edges, mean, scale)
    rng = np.random.default_rng(seed)
    n = min(pairs, len(good) * len(bad))
    d = z[rng.choice(good, n)] - z[rng.choice(bad, n)]
    w = np.zeros(z.shape[1])
    for _ in range(12):
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))  # chance that the loser of the pair wins
        slope = d.T @ p / n - ridge * w
        bend = (d * (p * (1 - p))[:, None]).T @ d / n + ridge * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    raw = z @ w
    share = len(bad) / len(y)
    spread = max(float(np.std(raw)) / 4, 1e-9)
    return Model(x.min(0), x.max(0), edges, mean, scale, w, float(np.quantile(raw, share)), spread)


def remainder(doc_id: Column, by: int) -> Column:
    """crc32 of doc_id as text, modulo by; null ids count as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % by


def featured(docs: DataFrame) -> DataFrame:
    """doc_id and features (x) of every document."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = [features(t) for t in texts(batch)]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "x"])

        return each

    return arrow_map(docs.select("doc_id", "text"), make, "doc_id bigint, x array<double>")


def labelled_features(known: DataFrame, labels: DataFrame) -> DataFrame:
    """y and x of all labelled documents that aren't held out, a row for each label and document; known: ``featured``. In a fixed order, so that sums are the same again."""
    chosen = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id"), 4) != 2))
    rows = known.join(chosen.select("doc_id", F.col("quality").cast("int").alias("y")), "doc_id")
    return rows.repartition("doc_id").sortWithinPartitions("doc_id", "y", F.xxhash64("x")).select("y", "x")


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))


def _folded(rows: DataFrame, each: Callable[[np.ndarray, np.ndarray], list], joined: Callable[[list, list], list]) -> list | None:
    """each(x, y) of all batches, joined in the order of the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if batch.num_rows:
                now = each(_matrix(batch), batch.column("y").to_numpy())
                held = now if held is None else joined(held, now)
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([pickle.dumps(held)], pa.binary())], names=["task", "held"])

    out = None
    for r in sorted(rows.mapInArrow(run, "task bigint, held binary").collect()):
        now = pickle.loads(r.held)
        out = now if out is None else joined(out, now)
    return out


def _added(a: list, b: list) -> list:
    return [x + y for x, y in zip(a, b, strict=True)]


def _celled(s: np.ndarray, *values: np.ndarray, width: float) -> tuple[np.ndarray, ...]:
    """The cells of s that hold any, with the sums of values in them."""
    cells, at = np.unique(np.floor(s / width).astype(np.int64), return_inverse=True)
    sums = []
    for v in values:
        out = np.zeros((len(cells), *v.shape[1:]))
        np.add.at(out, at, v)
        sums.append(out)
    return cells, *sums


def _cells_joined(a: tuple, b: tuple) -> tuple:
    """Cells of both with added sums."""
    cells, at = np.unique(np.concatenate([a[0], b[0]]), return_inverse=True)
    sums = []
    for x, y in zip(a[1:], b[1:], strict=True):
        out = np.zeros((len(cells), *x.shape[1:]))
        np.add.at(out, at, np.concatenate([x, y]))
        sums.append(out)
    return cells, *sums


def _chance(z: np.ndarray) -> np.ndarray:
    """That the loser of a pair wins, at the difference z of the raw scores."""
    return 1 / (1 + np.exp(np.clip(z, -30, 30)))


def _over(at: np.ndarray, s: np.ndarray, n: np.ndarray, f: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of n f(at - s) over s, for each of at; some rows of the matrix at a time."""
    few = max(1, 2_000_000 // max(1, len(s)))
    return np.concatenate([f(at[k : k + few, None] - s) @ n for k in range(0, len(at), few)]) if len(at) else np.zeros(0)


def fit_all(rows: DataFrame, ridge: float = RIDGE) -> Model | None:
    """The weights with the least mean logistic loss over all pairs of rows (y, x) of label 1 and 0; None without both labels.

    rows are read about thirty times: pass a written table.
    """
    begun = _folded(
        rows, lambda x, y: [np.array([(y == 0).sum(), (y == 1).sum()]), x.sum(0), x.min(0), x.max(0)],
        lambda a, b: [a[0] + b[0], a[1] + b[1], np.minimum(a[2], b[2]), np.maximum(a[3], b[3])],
    )
    if begun is None or not begun[0].all():
        return None
    (bad, good), total, low, high = begun
    n = bad + good
    mean = total / n
    scale = np.sqrt(_folded(rows, lambda x, y: [((x - mean) ** 2).sum(0)], _added)[0] / n)
    scale[scale == 0] = 1
    shares = [k / BINS for k in range(1, BINS)]
    found = selection.quantiles(rows.select(F.posexplode("x").alias("k", "v")), "k", "v", shares).collect()
    edges = np.array([r.q for r in sorted(found, key=lambda r: r.k)])
    made = lambda x: expanded(x, edges, mean, scale)
    centre = _folded(rows, lambda x, y: [made(x).sum(0)], _added)[0] / n  # differences don't change with it

    def counted(w: np.ndarray) -> list:
        """Cells, rows and sums of the raw scores of each label."""
        each = lambda x, y: [_celled(s, np.ones(len(s)), s, width=CELL) for s in ((made(x) - centre) @ w,) for s in (s[y == 0], s[y == 1])]
        return _folded(rows, each, lambda a, b: [_cells_joined(*both) for both in zip(a, b, strict=True)])

    def loss(w: np.ndarray, cells: list) -> float:
        (_, n0, s0), (_, n1, s1) = cells
        return _over(s1 / n1, s0 / n0, n0, lambda z: np.logaddexp(0, -z)) @ n1 / (good * bad) + ridge / 2 * w @ w

    def sums(w: np.ndarray, cells: list) -> tuple[np.ndarray, np.ndarray]:
        """Slope and curvature."""
        (_, n0, s0), (_, n1, s1) = cells
        s0, s1 = s0 / n0, s1 / n1
        ends = min(s0.min(), s1.min()) - CELL, max(s0.max(), s1.max()) + CELL
        grid = np.linspace(*ends, int(min((ends[1] - ends[0]) / CELL + 2, 20_000)))
        bend = lambda z: _chance(z) * _chance(-z)
        wins = _over(grid, s0, n0, _chance), _over(-grid, -s1, n1, _chance)  # of a row labelled 1 and 0 at each score
        bends = _over(grid, s0, n0, bend), _over(grid, s1, n1, bend)

        def each(x: np.ndarray, y: np.ndarray) -> list:
            z = made(x) - centre
            s = z @ w
            p = np.where(y == 1, np.interp(s, grid, wins[0]), -np.interp(s, grid, wins[1]))
            d = np.where(y == 1, np.interp(s, grid, bends[0]), np.interp(s, grid, bends[1]))
            return [p @ z, (z * d[:, None]).T @ z, *(_celled(s[y == k], z[y == k], width=WIDE) for k in (0, 1))]

        p, d, (c0, z0), (c1, z1) = _folded(rows, each, lambda a, b: [a[0] + b[0], a[1] + b[1], _cells_joined(a[2], b[2]), _cells_joined(a[3], b[3])])
        across = z1.T @ bend((c1[:, None] - c0) * WIDE) @ z0
        return p / (good * bad) - ridge * w, (d - across - across.T) / (good * bad) + ridge * np.eye(len(w))

    w = np.zeros(len(centre))
    cells = counted(w)
    for _ in range(20):
        slope, bend = sums(w, cells)
        values, axes = np.linalg.eigh(bend)
        step = axes @ (axes.T @ slope / np.maximum(values, ridge))  # the term in wide cells may bring a value below the ridge
        now, rate = loss(w, cells), 1.0
        after = counted(w + step)
        while loss(w + rate * step, after) > now + 1e-9 and rate > 1e-3:
            rate /= 2
            after = counted(w + rate * step)
        w, cells = w + rate * step, after
        if np.abs(rate * step).max() < 1e-5:
            break
    model = Model(low, high, edges, mean, scale, w, 0.0, 1.0)
    raw = staged(arrow_map(rows, lambda: lambda batch: pa.RecordBatch.from_arrays([pa.array(np.zeros(batch.num_rows, np.int32)), pa.array(made(_matrix(batch)) @ w)], names=["k", "v"]), "k int, v double"), "raw-scores")
    model.threshold = float(selection.quantiles(raw, "k", "v", [float(bad / n)]).first().q[0])
    middle = sum(s.sum() for _, _, s in cells) / n
    model.spread = max(float(np.sqrt(_folded(rows, lambda x, y: [np.array([(((made(x) - centre) @ w - middle) ** 2).sum()])], _added)[0][0] / n)) / 4, 1e-9)
    return model


def learn(docs: DataFrame, labels: DataFrame) -> Model | None:
    return learn_from(featured(docs), labels)


def learn_from(known: DataFrame, labels: DataFrame) -> Model | None:
    tune(known.sparkSession)
    return fit_all(staged(labelled_features(known, labels), "labelled-features"))


def scored(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with a column score; docs has a column x of features, or a column text, or a struct row with it, and none named score."""
    schema = StructType([*docs.schema.fields, StructField("score", DoubleType())])

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = _matrix(batch) if "x" in batch.schema.names else np.array([features(t) for t in texts(batch)], float).reshape(-1, len(FEATURES))
            score = model.score(x) if model is not None else np.ones(len(x))
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64())], names=[*batch.schema.names, "score"])

        return each

    return arrow_map(docs, make, schema)


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents scored THRESHOLD or more, with their own columns."""
    rows = docs.select(F.struct("*").alias("row"))
    return scored(rows, learn(docs, labels)).filter(F.col("score") >= THRESHOLD).select("row.*")


def op10(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    tune(docs.sparkSession)
    known = staged(featured(docs), "features")  # read by the fit and to score
    out = scored(known, learn_from(known, labels))
    return out.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def query(spark, sf_dir: str) -> DataFrame:
    return op10(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
