"""Stage tables, text files with and without a byte-order mark, and the manifest."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators import layouts, quality
from . import matfile, synthetic

MANIFEST = (
    "file_path string, load_hp int, label string, fault_diameter_mils int, or_position string, n_samples_DE bigint, n_samples_FE bigint, "
    "n_samples_BA bigint, rpm_from_file double, read_error string, warnings string, has_warning boolean"
)
BOM = "﻿"


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def stage_table(spark: SparkSession, path: str, build: Callable[[], DataFrame], force_rebuild: bool = False, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """The Parquet table at path; built and written first if it isn't complete there, or if forced."""
    if force_rebuild or not exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return spark.read.parquet(path)


def write_csv(df: DataFrame, path: str, drop: tuple[str, ...] = (), bom: bool = False) -> None:
    """One CSV with a header line, for small tables; bom: it starts with a byte-order mark."""
    out = df.drop(*drop)
    if bom:
        out = out.withColumnRenamed(out.columns[0], BOM + out.columns[0])
    out.coalesce(1).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with a header line, its names those of the schema whether or not a byte-order mark stands before them."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", True).csv(path)


def build_manifest(spark: SparkSession, root: str) -> DataFrame:
    """MANIFEST of the recordings below root: parsed paths, inspected files, rules."""
    return manifest_of(matfile.scan(spark, root))


def manifest_of(files: DataFrame) -> DataFrame:
    """MANIFEST of files (path, content)."""
    found = matfile.inspected(matfile.decoded(files))
    parsed = found.select(F.col("path").alias("file_path"), *(c.alias(k) for k, c in layouts.by_load_folder("path").items()), "n_samples_DE", "n_samples_FE", "n_samples_BA", "rpm_from_file", "read_error")
    return quality.flagged(parsed).select(*(x.split()[0] for x in MANIFEST.split(", ")))


def write_checked(manifest: DataFrame, path: str) -> DataFrame:
    """Writes a manifest, its unreadable files apart, and gives (code, n): how many rows each rule found, counted while writing.

    One pass: the counts are observed on the way, and rows go to the part ``unreadable=true``
    or ``false`` of the table by their own column.
    """
    seen = Observation("rules")
    codes = F.when(F.col("warnings") == "", F.array().cast("array<string>")).otherwise(F.split("warnings", "; "))
    checked = quality.observed(manifest.withColumn("codes", codes), seen).drop("codes")
    checked.withColumn("unreadable", F.col("read_error").isNotNull()).write.mode("overwrite").partitionBy("unreadable").parquet(path)
    return quality.observed_counts(manifest.sparkSession, seen)


def quarantined(spark: SparkSession, path: str) -> DataFrame:
    """file_path and read_error of the files that ``write_checked`` has put apart."""
    return spark.read.parquet(path).filter("unreadable = 'true'").select("file_path", "read_error")


def updated_manifest(spark: SparkSession, root: str, output: str) -> DataFrame:
    """MANIFEST of root, kept at output; of new and changed files only the contents are read."""
    from . import incremental

    return incremental.updated(spark, root, f"{output}/manifest-of-files", manifest_of, "file_path").select(*(x.split()[0] for x in MANIFEST.split(", ")))


def updated_features(spark: SparkSession, root: str, output: str, demod: str = "hilbert") -> DataFrame:
    """The features of the resolved files below root, kept at output; only new and changed files are read."""
    from ..operators.feature_tables import of_recordings
    from . import incremental

    def compute(files: DataFrame) -> DataFrame:
        signals = matfile.channel_of(matfile.decoded(files, "_DE_time"), "_DE_time", "contains")
        return of_recordings(layouts.resolved(files.select("path"), "path").join(signals, F.col("Filepath") == F.col("path")).drop("path"), demod=demod)

    return incremental.updated(spark, root, f"{output}/features-of-files-{demod}", compute, "Filepath")


def get_manifest(spark: SparkSession, output: str, root: str | None = None, force_rebuild: bool = False, **settings) -> DataFrame:
    """The manifest of root, or of synthetic files if there is no root; kept by its source."""
    if root is not None and not exists(spark, root):
        raise FileNotFoundError(root)
    name = "synthetic" if root is None else hashlib.sha256(root.encode()).hexdigest()[:16]

    def build() -> DataFrame:
        if root is not None:
            return build_manifest(spark, root)
        where = f"{output}/synthetic-files"
        synthetic.write_files(synthetic.recordings(synthetic.plan(spark), **settings), where)
        return build_manifest(spark, where)

    return stage_table(spark, f"{output}/manifest-{name}", build, force_rebuild)


def write_features(df: DataFrame, path: str) -> bool:
    """The feature table, a folder a demodulation; nothing is written for an empty one."""
    if df.isEmpty():
        return False
    df.write.mode("overwrite").partitionBy("demod").parquet(path)
    return True


def _mat_paths(spark: SparkSession, root: str) -> DataFrame:
    """path and relative path of every .mat file below root; contents aren't read."""
    return matfile.scan(spark, root).select("path", layouts.relative_to(F.regexp_replace("path", "^file:", ""), root.removeprefix("file:")).alias("relative"))


def resolved_files(spark: SparkSession, root: str) -> DataFrame:
    """Filepath, Label, Load of the files below root for which both are known."""
    return layouts.resolved(_mat_paths(spark, root), "path")


def typed_manifest(spark: SparkSession, root: str) -> DataFrame:
    """filepath, filename, type, size, position, load and class label by the folders below root."""
    parts = layouts.by_type_folders("relative")
    rows = _mat_paths(spark, root).select(F.col("path").alias("filepath"), F.element_at(F.split("path", "/"), -1).alias("filename"), *(c.alias(k) for k, c in parts.items()))
    return rows.withColumn("class_label", layouts.class_label(F.col("fault_type"), F.col("fault_size"), F.col("position")))


def feature_stage(spark: SparkSession, files: DataFrame, root: str, output: str, demod: str = "hilbert", force_rebuild: bool = False) -> DataFrame:
    """The feature table of resolved files, kept by demodulation; files without the channel or unreadable ones have no rows."""
    from ..operators.feature_tables import of_recordings

    def build() -> DataFrame:
        signals = matfile.channel_of(matfile.recordings(spark, root, "_DE_time"), "_DE_time", "contains")
        return of_recordings(files.join(signals, F.col("Filepath") == F.col("path")).drop("path"), demod=demod)

    return stage_table(spark, f"{output}/features-{demod}", build, force_rebuild)
