"""Centroid clustering of integer vectors: exact Lloyd rounds with Yinyang bounds.

Vectors are turned into integers, floor(1024 x) a component, so that distances and new
centroids are exact: a centroid becomes the componentwise floor of its vectors' mean, an
empty one stays. Ties go to the smaller number.

Centroids are put into groups of about GROUP once, by their first places. Every vector
keeps an upper bound of the distance to its own centroid, and a lower bound a group of
that to the group's other centroids. When centroids have moved, the upper bound grows by
what its own centroid moved, and a group's lower bound sinks by what the group's furthest
mover did. A vector whose upper bound is below all its lower bounds stays where it is
(global filter); of the others only groups whose lower bound is reached are looked at
(group filter), and of these only centroids which the bound before, less what the
centroid itself moved, doesn't exclude. Distances to these are computed exactly, in
integers; bounds are doubles, with more slack than their rounding errors can add up to.

A round is a pass over the vectors that writes them with their bounds to the shared
folder, read by the next one (the one before is removed then). Only the centroids, their
sums and counts, whose size the number of clusters sets, go through the driver; sums are
brought up to date by the vectors that changed cluster alone.

Vectors that are null, have another number of components, or hold null or non-finite
ones are not kept. Neither are those with a component beyond LIMIT in magnitude: their
squared distances wouldn't fit a long. A null id is hashed as empty text; rows that
repeat an id are rows each, those with equal hashes in the order of their components.
With fewer vectors than clusters there are as many clusters as vectors, in an empty
table none. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Staged, arrow_map, table, tune

SCALE = 1024
#: Largest component of a vector in magnitude: 64 squares of twice 2**27 fit a long.
LIMIT = (1 << 27) // SCALE
GROUP = 4
#: Pairs of a vector and a centroid that are compared at once.
TILE = 1 << 15

_STATE = "vec_id bigint, q array<int>, cluster int, previous int, distance bigint, upper double, lower array<double>, scanned int"


def slack(upper: np.ndarray) -> np.ndarray:
    """More than the bounds' rounding errors: they are below 2**31, and each round adds some 2**-21 at most."""
    return 1e-3 + 1e-9 * upper


def kept(vectors: DataFrame, width: int) -> DataFrame:
    """vec_id, q (integers) of the vectors that take part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"))
    usable = (F.size("x") == width) & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) <= LIMIT))
    return rows.filter(F.coalesce(usable, F.lit(False))).select("vec_id", F.transform("x", lambda v: F.floor(v * SCALE).cast("int")).alias("q"))


def first_centers(rows: DataFrame, k: int, salt: str) -> np.ndarray:
    """The k vectors whose ids have the least hashes, in their order."""
    digest = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    chosen = rows.select(digest.alias("h"), "q").orderBy("h", "q").limit(k).collect()
    return np.array([r.q for r in sorted(chosen, key=lambda r: (r.h, list(r.q)))], np.int64)


def grouped(centers: np.ndarray, size: int = GROUP) -> np.ndarray:
    """The group of each centroid, by a few rounds over the centroids themselves; groups are numbered without gaps."""
    seeds = centers[:: max(1, size)].astype(float)
    for _ in range(5):
        own = ((centers[:, None, :] - seeds[None]) ** 2).sum(2).argmin(1) if len(centers) else np.zeros(0, int)
        seeds = np.array([centers[own == g].mean(0) if (own == g).any() else seeds[g] for g in range(len(seeds))])
    return np.unique(own, return_inverse=True)[1] if len(centers) else np.zeros(0, int)


def squared(q: np.ndarray, centers: np.ndarray, rows: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Exact squared distances of pairs of a row of q and a centroid."""
    out = np.empty(len(rows), np.int64)
    for k in range(0, len(rows), TILE):
        gap = q[rows[k : k + TILE]] - centers[numbers[k : k + TILE]]
        out[k : k + TILE] = np.einsum("ij,ij->i", gap, gap)
    return out


@dataclass
class Bounds:
    """What is known of some vectors: own centroid, squared distance to it, upper bound, lower bound a group, centroids looked at."""

    cluster: np.ndarray
    distance: np.ndarray
    upper: np.ndarray
    lower: np.ndarray
    scanned: np.ndarray


def begin(q: np.ndarray, centers: np.ndarray, groups: np.ndarray) -> Bounds:
    """All centroids looked at."""
    n, k = len(q), len(centers)
    d = squared(q, centers, np.repeat(np.arange(n), k), np.tile(np.arange(k), n)).reshape(n, k)
    cluster = d.argmin(1)
    own = d[np.arange(n), cluster]
    others = np.sqrt(d.astype(float))
    others[np.arange(n), cluster] = np.inf
    lower = np.stack([others[:, groups == g].min(1) for g in range(groups.max() + 1)], 1)
    return Bounds(cluster, own, np.sqrt(own.astype(float)), lower, np.full(n, k))


def advance(q: np.ndarray, centers: np.ndarray, groups: np.ndarray, moved: np.ndarray, before: Bounds) -> Bounds:
    """The bounds after centroids have moved by these distances."""
    n, count = len(q), groups.max() + 1
    cluster, old = before.cluster.copy(), before.lower
    furthest = np.array([moved[groups == g].max() for g in range(count)])
    upper, lower = before.upper + moved[cluster], np.maximum(old - furthest, 0)
    distance, scanned = before.distance.copy(), np.zeros(n, int)
    # own distances are needed exactly in the end, and are the tightest upper bounds
    stale = np.flatnonzero(moved[cluster] > 0)
    distance[stale] = squared(q, centers, stale, cluster[stale])
    upper[stale] = np.sqrt(distance[stale].astype(float))
    open_ = np.flatnonzero(lower.min(1) <= upper + slack(upper))  # global filter
    reached = lower[open_] <= (upper + slack(upper))[open_, None]  # group filter
    least = old[open_][:, groups] - moved[None, :]  # centroids by themselves
    look = reached[:, groups] & (least <= (upper + slack(upper))[open_, None])
    look[np.arange(len(open_)), cluster[open_]] = False
    rows, numbers = np.nonzero(look)
    found = squared(q, centers, open_[rows], numbers)
    scanned[open_] = look.sum(1)
    # the best of the own centroid and those looked at; ties to the smaller number
    best = np.full((len(open_), len(centers)), np.iinfo(np.int64).max)
    best[rows, numbers] = found
    best[np.arange(len(open_)), cluster[open_]] = distance[open_]
    after = best.argmin(1)
    distances = np.sqrt(best.astype(float))
    unseen = best == np.iinfo(np.int64).max
    distances[unseen] = np.maximum(least, 0)[unseen]  # those that weren't looked at keep their bound
    distances[np.arange(len(open_)), after] = np.inf
    for g in range(count):
        fresh = distances[:, groups == g].min(1)
        # a group that wasn't reached keeps its bound, unless the centroid left behind is nearer
        own_before = np.where(groups[cluster[open_]] == g, distances[np.arange(len(open_)), cluster[open_]], np.inf)
        lower[open_, g] = np.where(reached[:, g], fresh, np.minimum(lower[open_, g], own_before))
    cluster[open_] = after
    distance[open_] = best[np.arange(len(open_)), after]
    upper[open_] = np.sqrt(distance[open_].astype(float))
    return Bounds(cluster, distance, upper, lower, scanned)


def _matrix(column: pa.Array, kind) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1)


def _pass(rows: DataFrame, centers: np.ndarray, groups: np.ndarray, moved: np.ndarray | None) -> DataFrame:
    """rows (vec_id, q, and from the second pass on their bounds) with the bounds for these centroids."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            q = _matrix(batch.column("q"), np.int64)
            if moved is None:
                now, previous = begin(q, centers, groups), np.full(len(q), -1)
            else:
                previous = batch.column("cluster").to_numpy()
                names = ("distance", "upper")
                distance, upper = (batch.column(c).to_numpy() for c in names)
                now = advance(q, centers, groups, moved, Bounds(previous, distance, upper, _matrix(batch.column("lower"), float), np.zeros(0)))
            lower = pa.ListArray.from_arrays(pa.array(np.arange(0, now.lower.size + 1, now.lower.shape[1], dtype=np.int32)), pa.array(now.lower.ravel()))
            made = [now.cluster.astype(np.int32), previous.astype(np.int32), now.distance, now.upper]
            columns = [batch.column("vec_id"), batch.column("q"), *map(pa.array, made), lower, pa.array(now.scanned.astype(np.int32))]
            return pa.RecordBatch.from_arrays(columns, names=["vec_id", "q", "cluster", "previous", "distance", "upper", "lower", "scanned"])

        return lambda batch: each(batch) if batch.num_rows else []

    return arrow_map(rows, make, _STATE)


def _changes(state: DataFrame, k: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """What the clusters' counts and sums gain by the vectors that changed cluster."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            q, new, old = _matrix(batch.column("q"), np.int64), batch.column("cluster").to_numpy(), batch.column("previous").to_numpy()
            gained = np.zeros((k, width + 1), np.int64)
            with_one = np.hstack([np.ones((len(q), 1), np.int64), q])
            np.add.at(gained, new, with_one)
            np.subtract.at(gained, old[old >= 0], with_one[old >= 0])
            some = np.flatnonzero(gained.any(1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (width + 1) * len(some) + 1, width + 1, dtype=np.int32)), pa.array(gained[some].ravel()))
            return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), lists], names=["cluster", "gained"])

        return lambda batch: each(batch) if batch.num_rows else []

    changed = state.filter("cluster <> previous").select("q", "cluster", "previous")
    parts = arrow_map(changed, make, "cluster int, gained array<bigint>")
    sums = parts.groupBy("cluster").agg(F.array(*(F.sum(F.get("gained", F.lit(x))) for x in range(width + 1))).alias("gained"))
    total = np.zeros((k, width + 1), object)
    for r in sums.collect():
        total[r.cluster] = r.gained
    return total[:, 0], total[:, 1:]


@dataclass
class Clustering:
    rows: Staged | None  # _STATE; None without vectors
    centers: np.ndarray
    groups: np.ndarray


def clustered(vectors: DataFrame, k: int = 8, rounds: int = 10, width: int = 64, salt: str = "3:", group: int = GROUP) -> Clustering:
    """The vectors (vec_id, embedding) that take part, assigned after this number of rounds. The caller drops rows."""
    tune(vectors.sparkSession)
    prepared = Staged(kept(vectors, width), "centroids-vectors")
    centers = first_centers(prepared.df, k, salt)
    groups = grouped(centers, group)
    if not len(centers):
        prepared.drop()
        return Clustering(None, centers, groups)
    counts, sums = np.zeros(len(centers), object), np.zeros((len(centers), width), object)
    held, moved = prepared, None
    for turn in range(rounds + 1):
        state = Staged(_pass(held.df, centers, groups, moved), "centroids-state")
        held.drop()
        held = state
        if turn < rounds:
            more, plus = _changes(state.df, len(centers), width)
            counts, sums = counts + more, sums + plus
            after = np.array([[s // n for s in row] if n else list(old) for n, row, old in zip(counts, sums, centers, strict=True)], np.int64)
            gap = (after - centers).astype(float)
            centers, moved = after, np.sqrt((gap * gap).sum(1))
    return Clustering(held, centers, groups)


def op13(vectors: DataFrame, k: int = 8, rounds: int = 10) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector that takes part."""
    spark = vectors.sparkSession
    schema = "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    made = clustered(vectors, k, rounds)
    if made.rows is None:
        return spark.createDataFrame([], schema)
    rows = made.rows.df.select("vec_id", "cluster", "distance")
    by_cluster = {r.cluster: r.inertia for r in rows.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}
    total = sum(by_cluster.values())
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in made.centers.tolist()]
    each = spark.createDataFrame([(c, x, total, digests[c]) for c, x in by_cluster.items()], "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return rows.join(F.broadcast(each), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13(table(spark, sf_dir, "embeddings"))


def oracle(k: int = 8, rounds: int = 10, width: int = 64) -> str:
    """The plain rounds, all distances each: a chain of common table expressions."""
    parts = [
        f"""v AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x) AND abs(x) <= {LIMIT})) = {width}
)""",
        f"c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY h, q) - 1)::INTEGER AS c, q FROM (SELECT sha256('3:' || coalesce(vec_id::VARCHAR, '')) AS h, q FROM v ORDER BY h, q LIMIT {k}))",
    ]
    for r in range(rounds + 1):
        parts.append(f"""a{r} AS MATERIALIZED (
  SELECT rid, any_value(vec_id) AS vec_id, any_value(q) AS q, min({{'d': d, 'c': c}}) AS best FROM (
    SELECT v.rid, v.vec_id, v.q, c.c, list_sum(list_transform(list_zip(v.q, c.q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM v CROSS JOIN c{r} c
  ) GROUP BY rid
)""")
        if r < rounds:
            parts.append(f"""c{r + 1} AS MATERIALIZED (
  SELECT c.c, coalesce(n.q, c.q) AS q FROM c{r} c LEFT JOIN (
    SELECT c, list(m ORDER BY k) AS q FROM (
      SELECT c, k, ((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS m
      FROM (SELECT best.c AS c, unnest(q) AS x, generate_subscripts(q, 1) AS k FROM a{r}) GROUP BY c, k
    ) GROUP BY c
  ) n USING (c)
)""")
    last = f"a{rounds}"
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, best.c AS cluster, best.d AS distance, sum(best.d) OVER (PARTITION BY best.c)::BIGINT AS cluster_inertia, sum(best.d) OVER ()::BIGINT AS inertia,
       sha256(array_to_string(f.q, ',')) AS centroid_sha256
FROM {last} JOIN c{rounds} f ON f.c = best.c
"""


ORACLE = oracle()
