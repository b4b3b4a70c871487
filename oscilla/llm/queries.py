"""The corpus queries and, where SQL can say the same, their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import centroids, chat, decontam, hmm, infill, langid, metric, minhash, mixing, ranker, repeats, secrets, warc
from .common import table


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op1(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix": op1_mix,
    "op2_secrets": secrets.query,
    "op3_warc": warc.query,
    "op4_chat": chat.query,
    "op5_hmm": hmm.query,
    "op6_vectors": metric.query,
    "op7_minhash": minhash.query,
    "op8_repeats": repeats.query,
    "op9_decontaminate": decontam.query,
    "op10_quality": ranker.query,
    "op11_infill": infill.query,
    "op12_language": langid.query,
    "op13_centroids": centroids.query,
}

ORACLES: dict[str, str] = {
    "op1_mix": mixing.ORACLE,
    "op3_warc": warc.ORACLE,
    "op4_chat": chat.ORACLE,
    "op6_vectors": metric.ORACLE,
    "op7_minhash": minhash.ORACLE,
    "op8_repeats": repeats.ORACLE,
    "op9_decontaminate": decontam.ORACLE,
    "op11_infill": infill.ORACLE,
    "op13_centroids": centroids.ORACLE,
}
