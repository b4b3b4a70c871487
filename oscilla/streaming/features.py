"""The feature table over recordings that arrive in a folder, as a stream (an extension).

Framing and features are narrow, so a stream needs neither state nor watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.feature_tables import of_recordings

RECORDINGS = "Filepath string, Label int, Load int, signal array<double>"


def arriving(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(RECORDINGS).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def feature_stream(recordings: DataFrame, size: int = 1024, overlap: float = 0.5, demod: str = "hilbert") -> DataFrame:
    return of_recordings(recordings, "signal", size, overlap, demod)


def write(features: DataFrame, path: str, checkpoint: str):
    """Starts the stream into Parquet; each recording is processed once."""
    return features.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(path)
