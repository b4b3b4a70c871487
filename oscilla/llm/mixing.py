"""Mixing sources to target weights by capped water-filling (DataFrame functions only).

Sources in code-point order, null last, take the weights in turn. The mix holds
``ratio`` times all words. A source's target is a common level times its weight
but at most ``max_epochs`` times its words; the level is where the targets sum
to the whole. Sorting the sources by cap/weight, the ones that fill first are
clamped first, and a source is clamped exactly if the level before it would put
it above its cap, which is the fixpoint of clamping and resharing by turns.

A document is taken floor(target / source words) times, and once more if it
stands in the seeded random order of its source before the rest of the target
is used up. The order is by MD5 of seed and doc_id: first by a bucket of its
leading hex digits (summed up for all rows, with map-side combine), then, only
in the one bucket a source where the target ends, row by row. So no source is
ever sorted as a whole, whatever its share of the rows.

Nulls: a null text has no words; a null source is a source of its own, the last;
a null doc_id hashes as the empty string. Repeated rows count as rows each. An
empty table gives an empty mix. Extra columns are carried along in a struct and
can have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, small, staged

WEIGHTS = (5, 2, 1)
RATIO = 1.5
MAX_EPOCHS = 2
SEED = "mix-1"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, ratio=RATIO, max_epochs=MAX_EPOCHS) -> DataFrame:
    """sizes: (source, size), one row a source -> (source, source_size, weight, target)."""
    kinds = F.array(*[F.lit(int(w)) for w in weights])
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    by_fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    up_to = by_fill.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        sizes.select("source", F.col("size").alias("source_size"), (F.row_number().over(by_name) - 1).alias("rank"))
        .withColumn("weight", F.get(kinds, F.col("rank") % len(weights)).cast("double"))
        .withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
        .withColumn("whole", F.sum("source_size").over(everything) * F.lit(float(ratio)))
        .withColumn("filled", F.sum("cap").over(up_to) - F.col("cap"))
        .withColumn("share", F.sum("weight").over(everything) - F.sum("weight").over(up_to) + F.col("weight"))
        .withColumn("clamped", (F.col("whole") - F.col("filled")) * F.col("weight") > F.col("cap") * F.col("share"))
        .withColumn("kept", F.sum(F.when(F.col("clamped"), F.col("cap")).otherwise(0.0)).over(everything))
        .withColumn("open", F.sum(F.when(F.col("clamped"), 0.0).otherwise(F.col("weight"))).over(everything))
        .withColumn("level", F.when(F.col("open") > 0, (F.col("whole") - F.col("kept")) / F.nullif("open", F.lit(0.0))))
        .select("source", "source_size", "weight", F.when(F.col("clamped"), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("weight"))).alias("target"))
    )


def mix_plan(docs: DataFrame, weights=WEIGHTS, ratio=RATIO, max_epochs=MAX_EPOCHS, seed=SEED, digits: int = 3) -> DataFrame:
    """docs (doc_id, text, source, ...) -> row (struct of docs' columns), size, source_size, target, copies, taken."""
    name = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = docs.select(F.struct("*").alias("row"), F.col("source").alias("src"), word_count(F.col("text")).alias("size"), name.alias("order")).withColumn("bucket", F.substring("order", 1, digits))
    buckets = staged(rows.groupBy(F.col("src").alias("source"), "bucket").agg(F.sum("size").alias("size")), "mix-buckets")
    targets = source_targets(buckets.groupBy("source").agg(F.sum("size").alias("size")), weights, ratio, max_epochs)
    targets = targets.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.nullif("source_size", F.lit(0)))).otherwise(F.lit(0)).cast("long"))
    targets = staged(targets.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")), "mix-targets")
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    edges = (
        buckets.withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0)))
        .withColumnRenamed("source", "of")
        .join(small(targets.select("source", "rest")), F.col("of").eqNullSafe(F.col("source")))
        .filter((F.col("before") < F.col("rest")) & (F.col("before") + F.col("size") >= F.col("rest")))
        .groupBy("source")
        .agg(F.min(F.struct("bucket", "before")).alias("edge"))
    )
    plan = staged(
        targets.withColumnRenamed("source", "of").join(edges, F.col("of").eqNullSafe(F.col("source")), "left").select("of", "source_size", "target", "whole", "rest", "edge.bucket", "edge.before"),
        "mix-plan",
    ).withColumnRenamed("bucket", "edge_bucket")
    joined = rows.join(small(plan), F.col("src").eqNullSafe(F.col("of")))
    at_edge = F.coalesce(F.col("bucket") == F.col("edge_bucket"), F.lit(False))
    sure = joined.filter(~at_edge).withColumn("extra", F.coalesce(F.col("bucket") < F.col("edge_bucket"), F.lit(False)).cast("long"))
    run = Window.partitionBy("src", "bucket").orderBy("order", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    middle = F.col("before") + F.sum("size").over(run) - F.col("size") / F.lit(2.0)
    close = joined.filter(at_edge).withColumn("extra", (middle < F.col("rest")).cast("long"))
    copies = F.col("whole") + F.col("extra")
    return sure.unionByName(close).select("row", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))


def mix_sources(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself: every column of docs, each document as often as it is taken, with ``copy`` (from 1).

    Where docs has a column copy, the number's name gets underscores until it is new.
    """
    number = "copy"
    while number in docs.columns:
        number += "_"
    plan = mix_plan(docs, **settings).filter("copies > 0")
    return plan.select("row.*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias(number))


def op1(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    return mix_plan(docs.select("doc_id", "text", "source")).select("row.doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix-1|' || coalesce(doc_id::VARCHAR, '')) AS o
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS rank
  FROM d GROUP BY source
), w AS (
  SELECT source, source_size, (CASE rank % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END)::DOUBLE AS weight,
         source_size * 2.0::DOUBLE AS cap, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS whole
  FROM s
), f AS (
  SELECT *, sum(cap) OVER (ORDER BY cap / weight, source IS NULL, source ROWS UNBOUNDED PRECEDING) - cap AS filled,
         sum(weight) OVER () - sum(weight) OVER (ORDER BY cap / weight, source IS NULL, source ROWS UNBOUNDED PRECEDING) + weight AS share
  FROM w
), g AS (
  SELECT *, (whole - filled) * weight > cap * share AS clamped FROM f
), h AS (
  SELECT *, sum(CASE WHEN clamped THEN cap ELSE 0 END) OVER () AS kept, sum(CASE WHEN clamped THEN 0 ELSE weight END) OVER () AS free
  FROM g
), t AS (
  SELECT source, source_size, CASE WHEN clamped THEN cap ELSE least(cap, (whole - kept) / nullif(free, 0) * weight) END AS target FROM h
), e AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS times FROM t
), x AS (
  SELECT d.doc_id, d.size, e.source_size, e.target, e.times, e.target - e.times * e.source_size AS rest,
         (sum(d.size) OVER (PARTITION BY d.source ORDER BY o, d.size ROWS UNBOUNDED PRECEDING))::BIGINT - d.size / 2.0::DOUBLE AS middle
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source
)
SELECT doc_id, size, source_size, target::DOUBLE AS target, (size * (times + CASE WHEN middle < rest THEN 1 ELSE 0 END))::BIGINT AS taken FROM x
"""
