"""Tables of the driver in the place of recordings: segments, recordings of events, and a manifest of parts.

Each has a Spark form and a DuckDB form (common table expressions) of the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.kinematics import rpm_of


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label, x: a segment of 64 samples a row."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value")


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, x: the values of a user in order of time, as one signal."""
    rows = samples(spark, sf_dir).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))).alias("s"))
    return rows.select("user_id", F.transform("s", lambda s: s["value"]).alias("x"))


def _pick(values: list, index) -> F.Column:
    return F.get(F.array(*(F.lit(v) for v in values)), index)


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, load_hp, label, fault_diameter_mils, or_position, n_samples_DE, rpm_from_file and a path in each of three layouts."""
    k, z = F.col("p_partkey"), F.col("p_size")
    rows = table(spark, sf_dir, "part").select(
        k.alias("k"),
        F.when(k % 11 != 10, (k % 5).cast("int")).alias("load_hp"),
        F.when(k % 9 == 0, "Normal").when(k % 9 != 8, _pick(["IR", "OR", "B"], (k % 3).cast("int"))).alias("label"),
        F.when((k % 9 != 0) & (k % 13 != 12), _pick([7, 14, 21, 28, 40, 99], z % 6)).alias("fault_diameter_mils"),
        F.when(k % 7 != 6, _pick(["Centered", "centered_6h", "@3", "Orthogonal", "@12", "CENTERED"], z % 6)).alias("or_position"),
        F.when(k % 17 != 16, _pick([120000, 121265, 480000, 243938, 84000, 156001], (k % 6).cast("int")).cast("long")).alias("n_samples_DE"),
        F.when(k % 10 != 9, (_pick([1797, 1772, 1750, 1730, 1797], (k % 5).cast("int")) + z - 25).cast("double")).alias("rpm_from_file"),
    )
    load, label, mils = F.col("load_hp"), F.col("label"), F.col("fault_diameter_mils")
    size = F.coalesce(F.lpad(mils.cast("string"), 3, "0"), F.lit("x"))
    by_load = F.concat(
        F.coalesce(F.concat(load.cast("string"), F.lit("hp")), F.lit("misc")), F.lit("/"),
        F.when(label == "Normal", "Normal").when(label.isNull(), F.concat(F.col("k").cast("string"), F.lit("_0"))).otherwise(
            F.concat(label, F.lit("_"), size, F.when(label == "OR", F.coalesce(F.concat(F.lit("_"), F.col("or_position")), F.lit(""))).otherwise(""))
        ),
        F.lit(".mat"),
    )
    ending = F.coalesce(F.concat(F.lit("_"), load.cast("string")), F.lit(""))
    by_parts = F.when(label == "Normal", F.concat(F.lit("data/raw/Normal/"), (F.col("k") % 4 + 97).cast("string"), F.lit(".mat"))).otherwise(
        F.concat(F.lit("data/raw/x/"), F.coalesce(label, F.lit("misc")), F.lit("/"), size, F.lit("/"), F.col("k").cast("string"), ending, F.lit(".mat"))
    )
    digits = F.coalesce(load.cast("string"), F.lit("12"))
    by_type = F.when(label == "Normal", F.concat(F.lit("Normal/97_Normal_"), digits, F.lit(".mat"))).otherwise(
        F.concat(F.lit("12k/"), F.coalesce(label, F.lit("Z")), F.lit("/"), size, F.when(label == "OR", F.concat(F.lit("/@"), (F.col("k") % 12).cast("string"))).otherwise(""), F.lit("/"), F.col("k").cast("string"), F.lit("_"), digits, F.lit(".mat"))
    )
    return rows.select("*", by_load.alias("path_a"), by_parts.alias("path_b"), by_type.alias("path_c"))


def speeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, load, rpm of the manifest's rows: the speed in the file, else that of the load."""
    rpm = F.coalesce("rpm_from_file", rpm_of(F.col("load_hp")).cast("double"))
    return manifest(spark, sf_dir).select("k", F.col("load_hp").alias("load"), rpm.alias("rpm"))


SEGMENTS = "e AS (SELECT vec_id, label, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings)"
RECORDINGS = "v AS (SELECT user_id, list(value ORDER BY ts, event_id) AS x FROM events GROUP BY user_id)"
MANIFEST = """
p0 AS (
  SELECT p_partkey AS k, p_size AS z,
    CASE WHEN p_partkey % 11 <> 10 THEN (p_partkey % 5)::INTEGER END AS load_hp,
    CASE WHEN p_partkey % 9 = 0 THEN 'Normal' WHEN p_partkey % 9 <> 8 THEN (['IR', 'OR', 'B'])[p_partkey % 3 + 1] END AS label,
    CASE WHEN p_partkey % 9 <> 0 AND p_partkey % 13 <> 12 THEN ([7, 14, 21, 28, 40, 99])[p_size % 6 + 1]::INTEGER END AS fault_diameter_mils,
    CASE WHEN p_partkey % 7 <> 6 THEN (['Centered', 'centered_6h', '@3', 'Orthogonal', '@12', 'CENTERED'])[p_size % 6 + 1] END AS or_position,
    CASE WHEN p_partkey % 17 <> 16 THEN ([120000, 121265, 480000, 243938, 84000, 156001])[p_partkey % 6 + 1]::BIGINT END AS n_samples_DE,
    CASE WHEN p_partkey % 10 <> 9 THEN (([1797, 1772, 1750, 1730, 1797])[p_partkey % 5 + 1] + p_size - 25)::DOUBLE END AS rpm_from_file
  FROM part
), p AS (
  SELECT k, load_hp, label, fault_diameter_mils, or_position, n_samples_DE, rpm_from_file,
    coalesce(load_hp::VARCHAR || 'hp', 'misc') || '/' || CASE WHEN label = 'Normal' THEN 'Normal' WHEN label IS NULL THEN k::VARCHAR || '_0'
      ELSE label || '_' || coalesce(lpad(fault_diameter_mils::VARCHAR, 3, '0'), 'x') || CASE WHEN label = 'OR' THEN coalesce('_' || or_position, '') ELSE '' END END || '.mat' AS path_a,
    CASE WHEN label = 'Normal' THEN 'data/raw/Normal/' || (k % 4 + 97)::VARCHAR || '.mat'
      ELSE 'data/raw/x/' || coalesce(label, 'misc') || '/' || coalesce(lpad(fault_diameter_mils::VARCHAR, 3, '0'), 'x') || '/' || k::VARCHAR || coalesce('_' || load_hp::VARCHAR, '') || '.mat' END AS path_b,
    CASE WHEN label = 'Normal' THEN 'Normal/97_Normal_' || coalesce(load_hp::VARCHAR, '12') || '.mat'
      ELSE '12k/' || coalesce(label, 'Z') || '/' || coalesce(lpad(fault_diameter_mils::VARCHAR, 3, '0'), 'x') || CASE WHEN label = 'OR' THEN '/@' || (k % 12)::VARCHAR ELSE '' END || '/' || k::VARCHAR || '_' || coalesce(load_hp::VARCHAR, '12') || '.mat' END AS path_c
  FROM p0
)"""


SPEEDS = "w AS (SELECT k, load_hp AS load, coalesce(rpm_from_file, (CASE load_hp WHEN 0 THEN 1797 WHEN 1 THEN 1772 WHEN 2 THEN 1750 WHEN 3 THEN 1730 ELSE 1797 END)::DOUBLE) AS rpm FROM p)"


def r6(expression: str, digits: int = 6) -> str:
    """DuckDB text of expression rounded, without negative zero."""
    return f"CASE WHEN round({expression}, {digits}) = 0 THEN 0.0::DOUBLE ELSE round({expression}, {digits}) END"
