"""What the corpus operators share: tables, staging, Arrow maps and components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..staging import Staged, delete, scratch, shared_dir, staged

#: Words as the contracts define them: runs of anything but space and \x09-\x0D.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

#: Largest Arrow batches.
BATCH_ROWS = 2000
BATCH_BYTES = 8 << 20

#: Rows of a broadcast side; larger sides are joined by shuffle.
BROADCAST_ROWS = 100_000

__all__ = ["Staged", "arrow_map", "classes_of_names", "connected_components", "delete", "named_components", "scratch", "shared_dir", "small", "staged", "table", "text_column", "texts", "tune"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tune(spark: SparkSession) -> None:
    """Arrow batches of no more than BATCH_ROWS and BATCH_BYTES: texts may be long, and workers share an executor.

    Tables are planned when they are read, which may be long after an operator has
    returned, so the settings stay; smaller ones of the session's own are left alone.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key).removesuffix("b")
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(key, str(most))


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df (cheap to count, as a staged table is) with a broadcast hint if it is small enough; otherwise the join shuffles."""
    return F.broadcast(df) if df.count() <= limit else df


def arrow_map(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """Map record batches; make() runs once a task and returns the function for its batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            out = each(batch)
            if isinstance(out, pa.RecordBatch):
                yield out
            else:
                yield from out

    return df.mapInArrow(run, schema)


def text_column(batch: pa.RecordBatch) -> pa.Array:
    """The texts of a batch: its column text, or that field of its column row."""
    return batch.column("text") if "text" in batch.schema.names else batch.column("row").field("text")


def texts(batch: pa.RecordBatch) -> list[str]:
    """The texts of a batch, null as empty."""
    return [x or "" for x in text_column(batch).to_pylist()]


#: Edges that one task may hold; larger graphs are reduced by distributed rounds.
LOCAL_EDGES = 1_000_000


def least_of_components(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges and the smallest node each can reach, by hooking and pointer jumping."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(ids))
    while len(x):
        low = np.minimum(root[x], root[y])
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        while (root[root] != root).any():
            root = root[root]
        open_ = root[x] != root[y]
        x, y = x[open_], y[open_]
    return ids, ids[root]


def _one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = list(batches)
    if held:
        edges = pa.Table.from_batches(held)
        ids, least = least_of_components(edges["a"].to_numpy(), edges["b"].to_numpy())
        yield from pa.table({"id": ids, "component": least}).to_batches(max_chunksize=10_000)


def repeated_names(rows: DataFrame, name: str, by: list[str]) -> DataFrame:
    """The names that stand in rows of several classes (by)."""
    found = rows.groupBy(name).agg(F.min(F.struct(*by)).alias("_x"), F.max(F.struct(*by)).alias("_y"))
    return found.filter("_x <> _y").select(name)


def classes_of_names(rows: DataFrame, classes: DataFrame, name: str, by: list[str]) -> DataFrame:
    """Edges (a, b) that hold the classes (by, id) of a repeated name together."""
    again = staged(repeated_names(rows, name, by), "repeated")
    if again.isEmpty():
        return rows.sparkSession.createDataFrame([], "a bigint, b bigint")
    ids = staged(rows.join(again, name).join(classes.select(*by, "id"), by).select(name, "id").distinct(), "repeated-ids")
    return ids.join(ids.groupBy(name).agg(F.min("id").alias("_first")), name).select(F.col("_first").alias("a"), F.col("id").alias("b"))


def named_components(classes: DataFrame, components: DataFrame) -> DataFrame:
    """classes (id, name, ...) that are in components, with component: the smallest name of their component."""
    linked = staged(classes.join(components, "id"), "linked").withColumnRenamed("component", "_of")
    least = linked.groupBy("_of").agg(F.min("name").alias("component"))
    return linked.join(least, "_of").drop("_of")


def connected_components(edges: DataFrame, local_edges: int = LOCAL_EDGES, rounds: int = 60) -> DataFrame:
    """(id, component) for every id that occurs in edges (a, b: long); component is the smallest id reachable.

    A graph of up to local_edges edges, which are counted first, is solved in one
    task. Otherwise large-star and small-star alternate on staged edge tables until
    nothing changes. Both steps only look at a node and the smallest of its
    neighbours, found by a map-side combined minimum and joined back, so a hub with
    very many neighbours is never gathered in one task. Rows grow with the edges.
    """
    both = lambda e: e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    current = Staged(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b").distinct(), "edges")
    if current.df.count() <= local_edges:
        return staged(current.df.coalesce(1).mapInArrow(_one_task, "id bigint, component bigint"), "components")
    previous = None
    for _ in range(rounds):
        two_way = both(current.df)
        # written, so that the join has an exchange on either side and a hub's rows can be split
        least = staged(two_way.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = two_way.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = staged(large, "large")
        least = staged(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        linked = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        after = Staged(linked.union(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        now = tuple(after.df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        current.drop()
        current = after
        if now == previous:
            stars = current.df
            return stars.select(F.col("a").alias("id"), F.col("b").alias("component")).union(stars.select("b", F.col("b").alias("c")).distinct())
        previous = now
    raise RuntimeError(f"components were not complete after {rounds} rounds")
