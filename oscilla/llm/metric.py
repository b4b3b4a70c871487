"""Near duplicates of vectors: an exact metric range join by pivots.

Cosine similarity c of unit vectors is their distance sqrt(2 - 2c), a metric, so
a similarity of ``least`` or more is a distance of at most r. Vectors are only
compared within a label (and a dimension). Each vector's home is the cell of
its nearest pivot. If u, at home in cell j, is within r of v, whose nearest
pivot is i, then d(v, pj) <= d(v, pi) + 2r by the triangle inequality, and v is
at most r beyond the plane half way between pi and pj; v is replicated to the
cells for which both hold. So a cell holds every partner of the vectors at home
in it, and cells are joined independently.

Equal vectors are one class, counted and compared once. A label is one cell at first,
and is divided by at least two and up to PIVOTS pivots if it has more than FIRST_ROWS
rows. Parts of more than CELL_ROWS rows are divided by pivots of their own, and so on, so the number of pivots grows with the rows while a task only
holds those of one cell: a cell's rows are dealt to tasks by a hash, the pivots with
each, so that what a task makes is bounded. Pivots come from a sample of the cell's rows
(chosen by a hash of the id), far from each other. How many of them are used is reckoned
on the sample: the pairs that the parts save are weighed against the copies of rows that
they cost. In high dimensions without clusters little is gained, and labels have few
pivots and parts none.

A cell is joined in blocks of BLOCK rows, home rows against all rows of the cell, one
task's group a pair of blocks, so that neither a hot label nor a dense cluster has to
fit in a task. A block pair doesn't give out its links: it counts them for each home
class, and reduces them to a spanning forest (an edge a class at most), which is all
that components need.

Nulls: rows whose label, vec_id or embedding is null, and vectors that are
empty, zero or hold null or non-finite components link with nothing; their
component is their own vec_id. Rows that repeat a vec_id are rows each, joined
by their id. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Staged, classes_of_names, connected_components, named_components, small, staged, table, tune

LEAST = 0.98
FIRST_ROWS = 32
CELL_ROWS = 2048
PIVOTS = 64
SAMPLE = 1024
#: What weighs a division: seconds of a core for a pair and for a pair's component, bytes a core shuffles and writes in a second.
PAIR, PRODUCT = 1e-8, 1e-10
SHUFFLED = 5e7
#: Bytes that a task's group may make.
GROUP_BYTES = 64_000_000
LEVELS = 8
BLOCK = 4096
TILE = 1024
SLACK = 1e-9

_ROW = "kind string, cell bigint, home boolean, id bigint, n bigint, embedding array<double>"


def matrix(column: pa.Array) -> np.ndarray:
    """An Arrow column of equally long lists as rows of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1)


def units(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, by their largest component first so that squares can't overflow."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def usable(vector, label, vec_id):
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(label.isNotNull() & vec_id.isNotNull() & vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def prepared(vectors: DataFrame) -> DataFrame:
    """vec_id, kind (label and dimension), h1, h2 (of the vector), ok, embedding."""
    vector = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), vector.alias("embedding"))
    rows = rows.withColumn("ok", usable(F.col("embedding"), F.col("label"), F.col("vec_id")))
    kind = F.concat_ws(":", F.size("embedding").cast("string"), "label")
    plain = F.transform("embedding", lambda x: x + 0.0)  # -0.0 as 0.0
    return rows.select("vec_id", F.when(F.col("ok"), kind).alias("kind"), F.xxhash64(plain).alias("h1"), F.xxhash64(F.lit(7), plain).alias("h2"), "ok", "embedding")


def chosen_pivots(u: np.ndarray, most: int, radius: float) -> np.ndarray:
    """Rows of u far from each other: the first, then each time the one furthest from those chosen, while it is beyond 2 radius."""
    chosen, nearest = [0], np.full(len(u), np.inf)
    while len(chosen) < most:
        nearest = np.minimum(nearest, np.sqrt(np.maximum(2 - 2 * u @ u[chosen[-1]], 0)))
        far = int(nearest.argmax())
        if nearest[far] <= 2 * radius:
            break
        chosen.append(far)
    return u[chosen]


def gain(u: np.ndarray, home: np.ndarray, pivots: np.ndarray, radius: float, rows: int, shuffled: float = SHUFFLED) -> tuple[float, float]:
    """Seconds that these pivots save in a cell of rows rows, by its sample u, and the copies they make of a row."""
    own, present = cells_of(u, pivots, radius)
    pairs = (np.bincount(own[home], minlength=len(pivots)) * present.sum(0)).sum() / len(u) ** 2
    copies = present.sum() / len(u)
    before = home.mean()
    return float((before - pairs) * rows**2 * (PAIR + PRODUCT * u.shape[1]) - rows * copies * u.shape[1] * 8 / shuffled), float(copies)


def cells_of(u: np.ndarray, pivots: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Each row's home cell, and (rows x cells) where it must be present."""
    squared = np.maximum(2 - 2 * u @ pivots.T, 0)
    d = np.sqrt(squared)
    home = d.argmin(1)
    near = d <= d.min(1, keepdims=True) + 2 * radius + SLACK
    between = np.sqrt(np.maximum(2 - 2 * pivots @ pivots.T, 0))
    between[between == 0] = np.inf  # of equal pivots the planes say nothing
    own = squared[np.arange(len(u)), home]
    beyond = (squared - own[:, None]) / (2 * between[home])
    near &= beyond <= radius + SLACK
    near[np.arange(len(u)), home] = True
    return home, near


def divided(placed: Staged, radius: float, cell_rows: int, pivots: int, always: bool) -> tuple[Staged, int]:
    """One level: the rows with those cells divided that are too large and (unless always) worth it, and the number of their pivots."""
    rows = placed.df
    spark = rows.sparkSession
    sizes = rows.filter("open").groupBy("kind", "cell").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > cell_rows)
    sizes = Staged(sizes, "metric-large")
    if sizes.df.isEmpty():
        return placed, 0
    shuffled = SHUFFLED
    chance = F.pmod(F.xxhash64("id", F.lit("pivot")), F.lit(1 << 40)) / float(1 << 40)
    sample = rows.filter("open").join(small(sizes.df), ["kind", "cell"]).filter(chance < F.lit(float(SAMPLE)) / F.col("rows"))

    def choose(part: pa.Table) -> pa.Table:
        part = part.sort_by("id")
        u, home = units(matrix(part["embedding"].combine_chunks())), part["home"].to_numpy().astype(bool)
        rows = part["rows"][0].as_py()
        far = chosen_pivots(u, pivots, radius)
        tried = [(*gain(u, home, far[:k], radius, rows, shuffled), k) for k in (2, 4, 8, 16, 32, 64, 128, 256) if k <= min(len(far), pivots)]
        saved, copies, n = max(tried, default=(0.0, 0.0, 0))
        if saved <= 0 and not always:
            n = 0
        found = far[:n]
        return pa.table({"kind": pa.array([part["kind"][0].as_py()] * n, pa.string()), "cell": pa.array([part["cell"][0].as_py()] * n, pa.int64()), "pivot": pa.array(found.tolist(), pa.list_(pa.float64())), "bytes": pa.array([copies * u.shape[1] * 8] * n, pa.float64())})

    drawn = sample.groupBy("kind", "cell").applyInArrow(choose, "kind string, cell bigint, pivot array<double>, bytes double")
    drawn = Staged(drawn, "metric-pivots")
    count = drawn.df.count()
    split = sizes.df.join(drawn.df.groupBy("kind", "cell").agg(F.max("bytes").alias("bytes")), ["kind", "cell"])
    split = staged(split.select("kind", "cell", F.ceil(F.col("rows") * F.col("bytes") / GROUP_BYTES).cast("int").alias("salts")), "metric-split")
    if not count:
        return placed, 0
    dealt = rows.filter("open").join(small(split), ["kind", "cell"]).withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int")).drop("open", "salts")
    spread = drawn.df.join(small(split), ["kind", "cell"]).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts", "bytes")

    def assign(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return left.drop_columns(["salt"]).append_column("open", pa.array([], pa.bool_()))
        p = matrix(right["pivot"].combine_chunks())
        p = p[np.lexsort(p.T)]  # the same order in every task
        own, present = cells_of(units(matrix(left["embedding"].combine_chunks())), p, radius)
        was_home = left["home"].to_numpy().astype(bool)
        which, part = np.nonzero(present)
        out = left.take(pa.array(which))
        cell = left["cell"].to_numpy()[which] * (pivots + 1) + part + 1
        return pa.table({"kind": out["kind"], "cell": pa.array(cell), "home": pa.array((own[which] == part) & was_home[which]), "id": out["id"], "n": out["n"], "embedding": out["embedding"], "open": pa.array(np.ones(len(which), bool))})

    parts = dealt.groupBy("kind", "cell", "salt").cogroup(spread.groupBy("kind", "cell", "salt")).applyInArrow(assign, f"{_ROW}, open boolean")
    done = F.broadcast(split) if split.count() <= 100_000 else split
    rest = rows.join(done.select("kind", "cell", F.lit(True).alias("split")), ["kind", "cell"], "left").filter("split is null").drop("split")
    closed = rest.withColumn("open", F.lit(False))  # small enough, or not worth dividing
    out = Staged(closed.select(*parts.columns).unionByName(parts), "metric-placed")
    placed.drop()
    return out, count


def assigned(classes: DataFrame, radius: float, cell_rows: int, pivots: int) -> DataFrame:
    """Every class in its home cell and replicated to those it may have partners in."""
    rows = classes.select("kind", F.lit(0).cast("long").alias("cell"), F.lit(True).alias("home"), "id", "n", "embedding", F.lit(True).alias("open"))
    placed = Staged(rows, "metric-placed")
    for level in range(LEVELS):
        placed, count = divided(placed, radius, cell_rows if level else min(FIRST_ROWS, cell_rows), pivots, level == 0)
        if not count:
            break
    return placed.df.drop("open")


def linked(a: np.ndarray, b: np.ndarray, ua: np.ndarray, ub: np.ndarray, least: float) -> np.ndarray:
    """Where rows of a and b have cosine least or more; close calls are decided by the plain formula."""
    c = ua @ ub.T
    out = c >= least
    for i, j in zip(*np.nonzero(np.abs(c - least) < SLACK), strict=True):
        out[i, j] = a[i] @ b[j] / (np.sqrt(a[i] @ a[i]) * np.sqrt(b[j] @ b[j])) >= least
    return out


def joined_blocks(home: tuple, every: tuple, least: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Links of each home class and a forest of edges. home, every: ids, counts, vectors."""
    (hid, hn, hx), (eid, en, ex) = home, every
    hu, eu = units(hx), units(ex)
    links = np.zeros(len(hid), np.int64)
    ids, inverse = np.unique(np.concatenate([hid, eid]), return_inverse=True)
    at_home, at_every = inverse[: len(hid)], inverse[len(hid) :]
    root = np.arange(len(ids))
    for i in range(0, len(hid), TILE):
        for j in range(0, len(eid), TILE):
            near = linked(hx[i : i + TILE], ex[j : j + TILE], hu[i : i + TILE], eu[j : j + TILE], least)
            same = at_home[i : i + TILE, None] == at_every[None, j : j + TILE]
            near |= same
            links[i : i + TILE] += near @ en[j : j + TILE]
            x, y = np.nonzero(near & (root[at_home[i : i + TILE]][:, None] != root[at_every[j : j + TILE]][None, :]))
            x, y = at_home[i : i + TILE][x], at_every[j : j + TILE][y]
            while len(x):
                low = np.minimum(root[x], root[y])
                np.minimum.at(root, root[x], low)
                np.minimum.at(root, root[y], low)
                while (root[root] != root).any():
                    root = root[root]
                open_ = root[x] != root[y]
                x, y = x[open_], y[open_]
    moved = np.flatnonzero(root != np.arange(len(ids)))
    return links, list(zip(ids[moved].tolist(), ids[root[moved]].tolist(), strict=True))


def block_pairs(rows: DataFrame, block: int) -> DataFrame:
    """rows dealt to (kind, cell, hb, eb): home block hb against block eb of all rows of the cell."""
    sizes = staged(rows.groupBy("kind", "cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks")), "metric-cells")
    dealt = rows.join(small(sizes), ["kind", "cell"]).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    places = F.sequence(F.lit(0), F.col("blocks") - 1)
    one = F.transform(places, lambda k: F.struct(k.alias("hb"), F.col("own").alias("eb"), F.lit(False).alias("as_home"), F.lit(True).alias("as_other")))
    two = F.transform(places, lambda k: F.struct(F.col("own").alias("hb"), k.alias("eb"), F.lit(True).alias("as_home"), F.lit(False).alias("as_other")))
    single = F.array(F.struct(F.lit(0).alias("hb"), F.lit(0).alias("eb"), F.col("home").alias("as_home"), F.lit(True).alias("as_other")))
    spots = F.when(F.col("blocks") == 1, single).otherwise(F.concat(one, F.when(F.col("home"), two).otherwise(F.filter(two, lambda _: F.lit(False)))))
    return dealt.select("kind", "cell", "id", "n", "embedding", F.explode(spots).alias("spot")).select("kind", "cell", "spot.*", "id", "n", "embedding")


def near_vectors(vectors: DataFrame, least: float = LEAST, cell_rows: int = CELL_ROWS, pivots: int = PIVOTS, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id of every row of vectors (vec_id, embedding, label)."""
    tune(vectors.sparkSession)
    rows = prepared(vectors)
    same = rows.filter("ok").groupBy("kind", "h1", "h2")
    classes = same.agg(F.min("vec_id").alias("name"), F.count(F.lit(1)).alias("n"), F.min_by("embedding", "vec_id").alias("embedding"))
    classes = staged(classes.withColumn("id", F.monotonically_increasing_id()), "metric-classes")  # fixed by being written
    radius = float(np.sqrt(2 - 2 * least))
    placed = assigned(classes, radius, cell_rows, pivots)

    def each(part: pa.Table) -> pa.Table:
        ids, n, x = part["id"].to_numpy(), part["n"].to_numpy(), matrix(part["embedding"].combine_chunks())
        home, other = part["as_home"].to_numpy().astype(bool), part["as_other"].to_numpy().astype(bool)
        own = ids[home]
        links, edges = joined_blocks((own, n[home], x[home]), (ids[other], n[other], x[other]), least) if home.any() and other.any() else (np.zeros(len(own), np.int64), [])
        nothing = [None] * len(edges)
        return pa.table({
            "id": pa.array([*own.tolist(), *(a for a, _ in edges)], pa.int64()),
            "links": pa.array([*links.tolist(), *nothing], pa.int64()),
            "to": pa.array([*[None] * len(own), *(b for _, b in edges)], pa.int64()),
        })

    pairs = block_pairs(placed, block)
    found = staged(pairs.groupBy("kind", "cell", "hb", "eb").applyInArrow(each, "id bigint, links bigint, to bigint"), "metric-found")
    # what a class counts has itself in it, n of it: each of its rows has n - 1 of these as partners
    links = found.filter("links is not null").groupBy("id").agg((F.sum("links") - 1).alias("n_links"))
    by = ["kind", "h1", "h2"]
    edges = found.filter("to is not null").select(F.col("id").alias("a"), F.col("to").alias("b"))
    components = connected_components(edges.union(classes_of_names(rows.filter("ok"), classes, "vec_id", by)))
    linked = named_components(classes.select("id", "name"), components).select("id", "component")
    by_class = classes.select(*by, "id", "name").join(links, "id", "left").join(linked, "id", "left")
    by_class = staged(by_class.select(*by, F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", "name").alias("component")), "metric-classes-out")
    out = rows.select("vec_id", "kind", "h1", "h2").join(by_class, ["kind", "h1", "h2"], "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))


def op6(vectors: DataFrame) -> DataFrame:
    found = near_vectors(vectors)
    return found.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6(table(spark, sf_dir, "embeddings"))


ORACLE = r"""
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS rid, vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
), u AS (
  SELECT *, sqrt(list_dot_product(x, x)) AS size FROM v
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND x IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda e: e IS NULL OR NOT isfinite(e))) = 0
), e AS (
  SELECT a.rid, a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND len(a.x) = len(b.x) AND a.rid <> b.rid
  WHERE a.size > 0 AND b.size > 0 AND list_dot_product(a.x, b.x) / (a.size * b.size) >= 0.98
), n AS (
  SELECT rid, count(*)::BIGINT AS n_links FROM e GROUP BY rid
), reach AS (
  SELECT DISTINCT vec_id AS id, vec_id AS other FROM v WHERE vec_id IS NOT NULL
  UNION SELECT e.a, reach.other FROM reach JOIN e ON e.b = reach.id
), k AS (
  SELECT id, min(other) AS component_id FROM reach GROUP BY id
)
SELECT v.vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, coalesce(v.vec_id = component_id, true) AS kept
FROM v LEFT JOIN n USING (rid) LEFT JOIN k ON v.vec_id = k.id
"""
