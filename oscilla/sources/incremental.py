"""Tables computed from files, kept up to date by reading new and changed files only.

Beside the rows stands a table of the files they came from: path, length and time of
modification. An update lists the files, joins the two lists, and reads the contents of
those files alone that are new or differ. Both tables are partitioned by a bucket of the
path's hash, and only the buckets of files that came, changed or went are written again
(dynamic partition overwrite), with the rows of their unchanged files taken over.

Rows carry the fingerprint of their file, and readers take those rows only whose
fingerprint is in the table of files, which is written last. So an update that ends
half way leaves the former state readable, bucket by bucket, and the next one does its
work again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import staged
from .stage import exists

#: Files that are named one by one when read; of more, all that were modified since the earliest of them are looked at.
LISTED = 10_000
BUCKETS = 64
_PRINT = ["_file", "_length", "_modified"]
FILES = "_file string, _length bigint, _modified timestamp, _bucket int"


def listed(spark: SparkSession, root: str, glob: str = "*.mat", buckets: int = BUCKETS) -> DataFrame:
    """The files below root with their fingerprints; contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    return found.select(F.col("path").alias("_file"), F.col("length").alias("_length"), F.col("modificationTime").alias("_modified"), F.pmod(F.hash("path"), F.lit(buckets)).alias("_bucket"))


def contents(spark: SparkSession, root: str, files: DataFrame, glob: str = "*.mat", limit: int = LISTED) -> DataFrame:
    """binaryFile rows of the files (staged, as ``listed``) only."""
    reader = spark.read.format("binaryFile")
    if files.count() <= limit:
        return reader.load([r[0] for r in files.select("_file").collect()])
    found = reader.option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    since = files.agg(F.min("_modified")).first()[0]
    return found.filter(F.col("modificationTime") >= F.lit(since)).join(files.select(F.col("_file").alias("path")), "path", "left_semi")


def _overwritten(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(path)


def current(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the table at path, without the columns of its own."""
    rows = spark.read.parquet(f"{path}/rows")
    files = spark.read.schema(FILES).parquet(f"{path}/files").filter("_length is not null")
    return rows.join(files, [*_PRINT, "_bucket"], "left_semi").drop(*_PRINT, "_bucket")


def updated(spark: SparkSession, root: str, path: str, compute: Callable[[DataFrame], DataFrame], key: str = "path", glob: str = "*.mat", buckets: int = BUCKETS, limit: int = LISTED) -> DataFrame:
    """The table at path for the files below root, brought up to date. compute takes binaryFile rows to rows with a column key, their file's path.

    Files for which compute gives no rows are known, and not read again before they change.
    Without any file, now or before, there is no table: FileNotFoundError.
    """
    now = staged(listed(spark, root, glob, buckets), "files-now")
    begun = exists(spark, f"{path}/files")
    before = spark.read.schema(FILES).parquet(f"{path}/files").filter("_length is not null") if begun else spark.createDataFrame([], FILES)
    changed = staged(now.join(before, [*_PRINT, "_bucket"], "left_anti"), "files-changed")
    gone = staged(before.join(now, [*_PRINT, "_bucket"], "left_anti"), "files-gone")
    if not begun and changed.isEmpty():
        raise FileNotFoundError(f"no {glob} below {root}")
    touched = staged(changed.select("_bucket").union(gone.select("_bucket")).distinct(), "files-buckets")
    if touched.isEmpty():
        return current(spark, path)
    small = F.broadcast(touched)  # BUCKETS rows at most
    fresh = None
    if not changed.isEmpty():
        made = compute(contents(spark, root, changed, glob, limit))
        fresh = made.join(changed, made[key] == changed["_file"])
    if begun and exists(spark, f"{path}/rows"):
        old = spark.read.parquet(f"{path}/rows").join(small, "_bucket", "left_semi").join(now, [*_PRINT, "_bucket"], "left_semi")
        old = old.join(changed.select("_file"), "_file", "left_anti")
        # written apart first: a table isn't overwritten while it is read
        fresh = staged(old, "rows-kept").unionByName(fresh, allowMissingColumns=True) if fresh is not None else staged(old, "rows-kept")
    if fresh is not None:
        _overwritten(fresh, f"{path}/rows")
    # a bucket without files keeps one row that stands for none, so that its former rows go
    none = touched.select(F.lit(None).cast("string").alias("_file"), F.lit(None).cast("bigint").alias("_length"), F.lit(None).cast("timestamp").alias("_modified"), "_bucket")
    _overwritten(now.join(small, "_bucket", "left_semi").unionByName(none), f"{path}/files")
    return current(spark, path)
