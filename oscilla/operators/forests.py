"""Random forests whose nodes never pass the driver: quantile bins, Poisson bags, Gini gain, a share of the features a node.

A tree's nodes of more than GROUP_ROWS rows are split from histograms that all tasks add up,
a pass over the rows a level; the driver holds these few nodes only. Below them the rows
of a node go to one group, which grows the rest of that tree level by level. So a group
holds GROUP_ROWS rows at most, and the grown parts are rows of a written table (tree, node).
To score, rows go through the upper nodes and then to the group of the part they reach.

What a row weighs in a tree and what features a node looks at depend on the seed, the
tree, the row's number and the node alone. Rows with a null or NaN feature or a null label
teach nothing; those with such a feature get no prediction. Labels are 0, 1, ...
"""

from __future__ import annotations

from collections.abc import Collection, Iterator
from dataclasses import dataclass, field
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import staged

BINS = 32
#: Rows of a node that a group takes.
GROUP_ROWS = 20_000
#: Bins of a level's nodes, for each row in them, up to which a group adds up all of them instead of sorting its rows.
CELLS_A_ROW = 8
LEAF, BELOW = -1, -2  # in the place of a feature

#: Share of bags with up to k copies of a row: Poisson's distribution of mean 1.
_COPIES = np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 16)]))


@dataclass
class Upper:
    """A tree's upper nodes; a child on the right follows the one on the left."""

    feature: list[int] = field(default_factory=list)
    edge: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    weights: list[list[float]] = field(default_factory=list)

    def add(self, depth: int, weights: list[float]) -> int:
        for column, value in ((self.feature, BELOW), (self.edge, 0), (self.left, 0), (self.depth, depth), (self.weights, weights)):
            column.append(value)
        return len(self.feature) - 1

    def arrays(self) -> tuple[np.ndarray, ...]:
        return tuple(np.array(x, np.int64) for x in (self.feature, self.edge, self.left))


@dataclass
class Forest:
    """parts: tree, node, feature, edge, left, share (classes numbers a node), gain (by feature)."""

    edges: list[list[float]]
    classes: int
    uppers: list[Upper]
    parts: DataFrame
    importances: list[float]

    def save(self, path: str) -> None:
        self.parts.write.mode("overwrite").parquet(f"{path}/parts")
        spark = self.parts.sparkSession
        rows = [(tree, u.feature, u.edge, u.left, u.depth, u.weights) for tree, u in enumerate(self.uppers)]
        kind = "tree int, feature array<int>, edge array<int>, left array<int>, depth array<int>, weights array<array<double>>"
        spark.createDataFrame(rows, kind).write.mode("overwrite").parquet(f"{path}/uppers")
        spark.createDataFrame([(self.edges, self.classes, self.importances)], "edges array<array<double>>, classes int, importances array<double>").write.mode("overwrite").parquet(f"{path}/forest")


def load(spark: SparkSession, path: str) -> Forest:
    row = spark.read.parquet(f"{path}/forest").first()
    uppers = [Upper(*r[1:]) for r in spark.read.parquet(f"{path}/uppers").orderBy("tree").collect()]
    return Forest(row.edges, row.classes, uppers, spark.read.parquet(f"{path}/parts"), row.importances)


def copies(ids: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often each row is in the tree's bag; of the numbers alone."""
    z = ids.astype(np.uint64) + np.uint64((tree + 1) * 0x9E3779B97F4A7C15 + seed * 0xD1B54A32D192ED03 & 2**64 - 1)
    for _ in range(2):  # the finisher of splitmix64
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    return np.searchsorted(_COPIES, (z >> np.uint64(11)) / 2.0**53, side="right")


def reached(b: np.ndarray, feature: np.ndarray, edge: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The node without children that each row of b ends in."""
    at = np.zeros(len(b), np.int64)
    if not len(feature) or feature[0] < 0:
        return at
    flat, first, open_ = b.ravel(), np.arange(len(b)) * b.shape[1], np.arange(len(b))
    here = at
    while len(open_):
        here = left[here] + (flat[first + feature[here]] > edge[here])
        further = feature[here] >= 0
        if not further.all():
            at[open_[~further]] = here[~further]
            open_, first, here = open_[further], first[further], here[further]
    return at


def towards(upper: Upper, nodes: Collection[int]) -> tuple[np.ndarray, ...]:
    """The upper nodes' arrays with all ways cut that don't lead to nodes: rows on them end where they leave the others."""
    feature, edge, left = upper.arrays()
    leads = np.zeros(len(feature), bool)
    leads[list(nodes)] = True
    for k in range(len(feature) - 1, -1, -1):  # children come after their node
        if feature[k] >= 0:
            leads[k] = leads[left[k]] or leads[left[k] + 1]
    return np.where(leads, feature, LEAF), edge, left


def grown(b: np.ndarray, y: np.ndarray, w: np.ndarray, classes: int, looked: int, depth: int, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
    """feature, edge, left, share by class of the nodes of a tree over rows b (bins), level by level; the gain of each feature."""
    features, gain = b.shape[1], np.zeros(b.shape[1])
    out = []
    node, made, rows = np.zeros(len(b), np.int64), 1, np.arange(len(b))
    nodes = 1
    while nodes:
        weights = np.bincount(node * classes + y[rows], w[rows], nodes * classes).reshape(nodes, classes)
        total = weights.sum(1)
        feature, edge, left = np.full(nodes, LEAF), np.zeros(nodes, np.int64), np.zeros(nodes, np.int64)
        out.append((feature, edge, left, weights / total[:, None]))
        mixed = np.flatnonzero(weights.max(1) < total)
        if not depth or not len(mixed):
            break
        depth -= 1
        place = np.full(nodes, -1)
        place[mixed] = np.arange(len(mixed))
        node = place[node]
        rows, node = rows[node >= 0], node[node >= 0]
        chosen = rng.random((len(mixed), features)).argpartition(looked - 1, axis=1)[:, :looked] if looked < features else np.tile(np.arange(features), (len(mixed), 1))
        whole = weights[mixed]
        none = (whole * whole).sum(1) / whole.sum(1)
        best, which, where = none + 1e-9 * whole.sum(1), np.full(len(mixed), LEAF), np.zeros(len(mixed), np.int64)
        labels, weight = y[rows], w[rows].astype(float)
        cells = len(mixed) * BINS
        dense = cells <= CELLS_A_ROW * len(rows)
        if not dense:
            each = np.zeros((len(rows), classes))
            each[np.arange(len(rows)), labels] = weight
        for f in chosen.T:
            key = node * BINS + b[rows, f[node]]
            if dense:
                held = np.bincount(key * classes + labels, weight, cells * classes).reshape(cells, classes)
                key = np.flatnonzero(np.bincount(key, minlength=cells))
                sums = np.cumsum(held[key], axis=0)
            else:
                order = np.argsort(key)
                key = key[order]
                last = np.flatnonzero(np.append(key[1:] != key[:-1], True))  # of a node's rows in a bin
                sums, key = np.cumsum(each[order], axis=0)[last], key[last]
            of, bin_ = np.divmod(key, BINS)
            first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            before = np.vstack([np.zeros(classes), sums[first[1:] - 1]])
            low = sums - before[of]
            high = whole[of] - low
            n, m = low.sum(1), high.sum(1)
            score = (low * low).sum(1) / n + (high * high).sum(1) / np.maximum(m, 1)
            top = np.maximum.reduceat(score, first)
            at = np.flatnonzero(score == top[of])
            at = at[np.append(True, of[at[1:]] != of[at[:-1]])]  # the first of equal ones
            better = top > best
            best[better], which[better], where[better] = top[better], f[better], bin_[at][better]
        split = which >= 0
        np.add.at(gain, which[split], (best - none)[split])
        kids = np.full(len(mixed), -1)
        kids[split] = np.arange(split.sum()) * 2
        feature[mixed], edge[mixed], left[mixed] = which, where, np.where(split, made + kids, 0)
        stay = split[node]
        rows, node = rows[stay], node[stay]
        node = kids[node] + (b[rows, which[node]] > where[node])
        nodes = int(split.sum()) * 2
        made += nodes
    return *(np.concatenate([x[k] for x in out]) for k in range(4)), gain


def _bins(batch: pa.RecordBatch, features: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("b").to_pylist()), np.uint8).reshape(-1, features)


def _edges(df: DataFrame, columns: list[str]) -> list[list[float]]:
    """At most BINS - 1 values a column, at equal shares of all rows."""
    shares = [k / BINS for k in range(1, BINS)]
    row = df.agg(*(F.percentile_approx(f"`{c}`", shares, 10_000).alias(f"e{k}") for k, c in enumerate(columns))).first()
    return [sorted(set(x or [])) for x in row]


def _usable(df: DataFrame, columns: list[str]) -> DataFrame:
    numbers = [F.col(f"`{c}`").cast("double") for c in columns]
    return df.filter(F.forall(F.array(*numbers), lambda v: v.isNotNull() & ~F.isnan(v))) if columns else df


def _binned(df: DataFrame, columns: list[str], edges: list[list[float]], kept: str) -> DataFrame:
    """kept (a schema) of df with b, a byte a column: the number of its edges below the value."""
    borders = [np.array(e) for e in edges]
    names = [x.split()[0] for x in kept.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [batch.column(f"_f{k}").to_numpy(zero_copy_only=False) for k in range(len(borders))]
            b = np.stack([np.searchsorted(e, v) for e, v in zip(borders, x, strict=True)], 1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array([r.tobytes() for r in b], pa.binary())], names=[*names, "b"])

    return df.select(*names, *(F.col(f"`{c}`").cast("double").alias(f"_f{k}") for k, c in enumerate(columns))).mapInArrow(run, f"{kept}, b binary")


def _spread(df: DataFrame) -> DataFrame:
    """df, written and small a row, dealt evenly to the tasks."""
    return df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism)


def _to_groups(chunks: DataFrame, trees: int) -> DataFrame:
    """Chunks by tree and node; a number of its own keeps adaptive plans from putting small but slow groups together."""
    spark = chunks.sparkSession
    return chunks.repartition(max(trees, int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), "tree", "node")


def _ints(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.int32))


def _split_level(rows: DataFrame, uppers: list[Upper], wanted: dict[int, dict[int, int]], features: int, classes: int, looked: int, seed: int) -> list:
    """tree, node, feature, edge, gain, the weights by class and the number of rows on the left of the best split of each wanted node (tree: {node: place})."""
    known = {tree: towards(uppers[tree], nodes) for tree, nodes in wanted.items()}
    shape = (looked, BINS, classes + 1)

    def looked_at(tree: int, node: int) -> np.ndarray:
        return np.random.default_rng([seed, tree, node]).permutation(features)[:looked] if looked < features else np.arange(features)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {tree: np.zeros((len(nodes), *shape)) for tree, nodes in wanted.items()}
        looks = {tree: np.array([looked_at(tree, node) for node in nodes]) for tree, nodes in wanted.items()}
        places = {}
        for tree, nodes in wanted.items():
            places[tree] = np.full(len(known[tree][0]), -1)
            places[tree][list(nodes)] = np.arange(len(nodes))
        for batch in batches:
            b, y, ids = _bins(batch, features), batch.column("y").to_numpy(), batch.column("_row").to_numpy()
            for tree, held in sums.items():
                w = copies(ids, tree, seed)
                bag = np.flatnonzero(w)
                place = places[tree][reached(b[bag], *known[tree])]
                bag, place = bag[place >= 0], place[place >= 0]
                cells = len(held) * BINS
                for s, f in enumerate(looks[tree].T):
                    v = place * BINS + b[bag, f[place]]
                    held[:, s, :, :classes] += np.bincount(v * classes + y[bag], w[bag], cells * classes).reshape(-1, BINS, classes)
                    held[:, s, :, classes] += np.bincount(v, minlength=cells).reshape(-1, BINS)
        for tree, held in sums.items():
            met = held[:, 0, :, classes].any(1)
            found = [x.tobytes() for x in held[met]]
            yield pa.RecordBatch.from_arrays([_ints(np.full(len(found), tree)), _ints(np.array(list(wanted[tree]))[met]), pa.array(found, pa.binary())], names=["tree", "node", "sums"])

    def best(key: tuple, found: pa.Table) -> pa.Table:
        sums = sum(np.frombuffer(x, float).reshape(shape) for x in found["sums"].to_pylist())
        low = np.cumsum(sums, axis=1)
        whole = low[:, -1:, :classes]
        left, right = low[..., :classes], whole - low[..., :classes]
        size = lambda x: (x * x).sum(-1) / np.maximum(x.sum(-1), 1)
        gain = size(left) + size(right) - size(whole)
        s, edge = np.unravel_index(gain.argmax(), gain.shape)
        tree, node = (k.as_py() for k in key)
        won = float(gain[s, edge]) if gain[s, edge] > 1e-9 * whole[s].sum() else 0.0
        return pa.table(
            {"tree": _ints(np.array([tree])), "node": _ints(np.array([node])), "feature": _ints(looked_at(tree, node)[s : s + 1]), "edge": _ints(np.array([edge])), "gain": [won],
             "weights": [whole[s, 0].tolist()], "low": [left[s, edge].tolist()], "n": [int(low[s, -1, classes])], "n_low": [int(low[s, edge, classes])]}
        )

    counted = rows.mapInArrow(count, "tree int, node int, sums binary")
    kind = "tree int, node int, feature int, edge int, gain double, weights array<double>, low array<double>, n bigint, n_low bigint"
    return counted.groupBy("tree", "node").applyInArrow(best, kind).collect()


def fit(df: DataFrame, columns: list[str], label: str, seed: int = 42, trees: int = 100, depth: int = 20, group_rows: int = GROUP_ROWS) -> Forest:
    rows = _usable(df, columns).select(F.col(label).cast("int").alias("y"), *(F.col(f"`{c}`") for c in columns)).filter("y is not null")
    edges = _edges(rows, columns)
    rows = _spread(staged(_binned(rows.withColumn("_row", F.monotonically_increasing_id()), columns, edges, "_row bigint, y int"), "forest-rows"))
    n, most, least = rows.agg(F.count(F.lit(1)), F.max("y"), F.min("y")).first()
    if (least or 0) < 0:
        raise ValueError(f"labels are 0, 1, ...; {least} is none")
    classes, features = (most or 0) + 1, len(columns)
    looked = ceil(sqrt(features)) if trees > 1 else features
    uppers, gains = [Upper() for _ in range(trees)], np.zeros((trees, features))
    wanted = {tree: {u.add(0, []): 0} for tree, u in enumerate(uppers)}
    while n > group_rows and wanted:
        further: dict[int, dict[int, int]] = {}
        for r in _split_level(rows, uppers, wanted, features, classes, looked, seed):
            u = uppers[r.tree]
            u.weights[r.node] = r.weights
            if not r.gain:
                u.feature[r.node] = LEAF
                continue
            gains[r.tree, r.feature] += r.gain
            high = [a - b for a, b in zip(r.weights, r.low, strict=True)]
            kids = [u.add(u.depth[r.node] + 1, x) for x in (r.low, high)]
            u.feature[r.node], u.edge[r.node], u.left[r.node] = r.feature, r.edge, kids[0]
            for kid, count in zip(kids, (r.n_low, r.n - r.n_low), strict=True):
                if u.depth[kid] == depth:
                    u.feature[kid] = LEAF
                elif count > group_rows:
                    further.setdefault(r.tree, {})[kid] = 0
        wanted = further
    parts = staged(_parts(rows, uppers, features, classes, looked, depth, seed), "forest-parts")
    for tree, f, g in parts.select("tree", F.posexplode("gain").alias("f", "g")).groupBy("tree", "f").agg(F.sum("g")).collect():
        gains[tree, f] += g
    whole = gains.sum(1, keepdims=True)
    mean = np.divide(gains, whole, out=np.zeros_like(gains), where=whole > 0).sum(0)
    return Forest(edges, classes, uppers, parts, (mean / max(mean.sum(), 1e-300)).tolist())


def _parts(rows: DataFrame, uppers: list[Upper], features: int, classes: int, looked: int, depth: int, seed: int) -> DataFrame:
    """What grows below the upper nodes, a row for each of their open ends."""
    known, depths = [u.arrays() for u in uppers], [u.depth for u in uppers]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b, y, ids = _bins(batch, features), batch.column("y").to_numpy(), batch.column("_row").to_numpy()
            for tree, upper in enumerate(known):
                w = copies(ids, tree, seed)
                bag = np.flatnonzero(w)
                yield from _chunks(tree, reached(b[bag], *upper), upper[0], {"b": b[bag], "y": y[bag].astype(np.int32), "w": w[bag].astype(np.uint8)})

    def grow(key: tuple, found: pa.Table) -> pa.Table:
        tree, node = (k.as_py() for k in key)
        b, y, w = (np.frombuffer(b"".join(found[c].to_pylist()), kind) for c, kind in (("b", np.uint8), ("y", np.int32), ("w", np.uint8)))
        made = grown(b.reshape(-1, features), y, w, classes, looked, depth - depths[tree][node], np.random.default_rng([seed, tree, node]))
        feature, edge, left, share, gain = made
        return pa.table(
            {"tree": _ints(np.array([tree])), "node": _ints(np.array([node])), "feature": _lists(_ints(feature)), "edge": _lists(_ints(edge)), "left": _lists(_ints(left)),
             "share": _lists(pa.array(share.ravel())), "gain": _lists(pa.array(gain))}
        )

    dealt = rows.mapInArrow(deal, "tree int, node int, b binary, y binary, w binary")
    kind = "tree int, node int, feature array<int>, edge array<int>, left array<int>, share array<double>, gain array<double>"
    return _to_groups(dealt, len(uppers)).groupBy("tree", "node").applyInArrow(grow, kind)


def _lists(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _chunks(tree: int, at: np.ndarray, feature: np.ndarray, columns: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The rows at open ends, a row of bytes for each such node."""
    keep = np.flatnonzero(feature[at] == BELOW)
    if not len(keep):
        return
    keep = keep[np.argsort(at[keep], kind="stable")]
    pieces = np.split(keep, np.flatnonzero(np.diff(at[keep])) + 1)
    data = [pa.array([np.ascontiguousarray(x[p]).tobytes() for p in pieces], pa.binary()) for x in columns.values()]
    yield pa.RecordBatch.from_arrays([_ints(np.full(len(pieces), tree)), _ints(at[[p[0] for p in pieces]]), *data], names=["tree", "node", *columns])


def predicted(model: Forest, df: DataFrame, columns: list[str]) -> DataFrame:
    """The usable rows of df with probability (array, by class) and prediction, the first class of the largest."""
    features, classes, trees = len(columns), model.classes, len(model.uppers)
    rows = staged(_usable(df, columns).withColumn("_row", F.monotonically_increasing_id()), "forest-scored")
    known = [u.arrays() for u in model.uppers]
    shares = []
    for u in model.uppers:
        w = np.array([x if x else [0.0] * classes for x in u.weights])
        shares.append(w / np.maximum(w.sum(1, keepdims=True), 1e-300) * (np.array(u.feature) == LEAF)[:, None])
    votes = [f"p{k}" for k in range(classes)]
    kind = ", ".join(["_row bigint", *(f"{p} double" for p in votes)])

    def voted(ids: np.ndarray, p: np.ndarray) -> dict[str, pa.Array]:
        return {"_row": pa.array(ids, pa.int64()), **{c: pa.array(np.ascontiguousarray(p[:, k])) for k, c in enumerate(votes)}}

    def above(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The votes of upper nodes without children; a row of no votes for every other row."""
        for batch in batches:
            b = _bins(batch, features)
            p = np.zeros((len(b), classes))
            for upper, share in zip(known, shares, strict=True):
                if len(upper[0]) > 1 or upper[0][0] == LEAF:
                    p += share[reached(b, *upper)]
            yield pa.RecordBatch.from_pydict(voted(batch.column("_row").to_numpy(), p))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b, ids = _bins(batch, features), batch.column("_row").to_numpy()
            for tree, upper in enumerate(known):
                yield from _chunks(tree, reached(b, *upper), upper[0], {"b": b, "ids": ids})

    def below(chunks: pa.Table, parts: pa.Table) -> pa.Table:
        """The votes of a grown part; a node's rows to be scored are about as many as those it was grown from."""
        if not parts.num_rows or not chunks.num_rows:
            return pa.table(voted(np.zeros(0, np.int64), np.zeros((0, classes))))
        feature, edge, left, share = (parts[c].combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("feature", "edge", "left", "share"))
        b, ids = (np.frombuffer(b"".join(chunks[c].to_pylist()), kind) for c, kind in (("b", np.uint8), ("ids", np.int64)))
        return pa.table(voted(ids, share.reshape(-1, classes)[reached(b.reshape(-1, features), feature, edge, left)]))

    binned = _spread(staged(_binned(rows, columns, model.edges, "_row bigint"), "forest-scored-bins"))
    dealt = binned.mapInArrow(deal, "tree int, node int, b binary, ids binary")
    found = _to_groups(dealt, trees).groupBy("tree", "node").cogroup(_to_groups(model.parts.drop("gain"), trees).groupBy("tree", "node")).applyInArrow(below, kind)
    summed = binned.mapInArrow(above, kind).unionByName(found).groupBy("_row").agg(*(F.sum(p).alias(p) for p in votes))
    p = F.array(*votes)
    whole = F.aggregate(p, F.lit(0.0), lambda a, v: a + v)
    scores = summed.select("_row", F.transform(p, lambda v: v / F.greatest(whole, F.lit(1e-300))).alias("probability"))
    most = (F.array_position("probability", F.array_max("probability")) - 1).cast("double")
    return rows.join(scores.withColumn("prediction", most), "_row").drop("_row")
