"""Data-quality rules over a manifest; the result are codes, and messages with the values that broke a rule.

A row without drive-end samples is skipped: no other rule looks at it. A missing
load or label is reported for every such row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..config import DIAMETERS, FS, NOMINAL_SECONDS, OTHER_BEARING_DIAMETERS, OTHER_FS, RPM_TOLERANCE, SECONDS_TOLERANCE
from ..functions.kinematics import rpm_of

#: The rules' codes in the order of evaluation.
CODES = (
    "NGHI_NGO_SAMPLING_RATE",
    "THOI_LUONG_BAT_THUONG",
    "RPM_LECH",
    "VONG_BI_NTN",
    "DUONG_KINH_LA",
    "OR_THIEU_VI_TRI",
    "OR_NGOAI_PHAM_VI",
    "THIEU_NHAN",
    "THIEU_TAI",
)

#: What follows each code in its message, as printf formats.
MESSAGES = (
    "n_samples=%d -> %.1fs nếu 12kHz (bất thường), %.1fs nếu 48kHz (hợp lý).",
    "n_samples=%d không khớp ~10s ở cả 12kHz (%.1fs) lẫn 48kHz (%.1fs).",
    "RPM file (%.0f) lệch >20 so với danh định tải %dHP (%d).",
    "đường kính %d mils dùng vòng bi NTN, KHÔNG dùng hình học SKF 6205 để tính BPFO/BPFI/BSF.",
    "%d mils không rõ nguồn gốc.",
    "nhãn OR nhưng không rõ vị trí lỗi.",
    "vị trí '%s' khác phạm vi đã chốt ('Centered').",
    "không parse được nhãn lỗi.",
    "không parse được mức tải.",
)


def rules(n: str = "n_samples_DE", load: str = "load_hp", label: str = "label", mils: str = "fault_diameter_mils", position: str = "or_position", rpm: str = "rpm_from_file") -> dict[str, Column]:
    """Each code's predicate; null counts as not broken."""
    lasts = lambda fs: F.abs(F.col(n) / F.lit(float(fs)) - NOMINAL_SECONDS) <= SECONDS_TOLERANCE
    outer = F.col(label) == "OR"
    broken = (
        lasts(OTHER_FS) & ~lasts(FS),
        ~lasts(OTHER_FS) & ~lasts(FS),
        F.abs(F.col(rpm) - rpm_of(F.col(load), None)) > RPM_TOLERANCE,
        F.col(mils).isin(*OTHER_BEARING_DIAMETERS),
        ~F.col(mils).isin(*DIAMETERS),
        outer & F.col(position).isNull(),
        outer & ~F.lower(position).contains("centered"),
        F.col(label).isNull(),
        F.col(load).isNull(),
    )
    return dict(zip(CODES, broken, strict=True))


def messages(n: str = "n_samples_DE", load: str = "load_hp", mils: str = "fault_diameter_mils", position: str = "or_position", rpm: str = "rpm_from_file", **_: str) -> dict[str, Column]:
    """Each code's message."""
    seconds = [F.col(n) / F.lit(float(fs)) for fs in (FS, OTHER_FS)]
    values = ([F.col(n), *seconds], [F.col(n), *seconds], [F.col(rpm), F.col(load), rpm_of(F.col(load), None)], [F.col(mils)], [F.col(mils)], [], [F.col(position)], [], [])
    return {code: F.format_string(f"{code}: {text}", *v) if v else F.lit(f"{code}: {text}") for code, text, v in zip(CODES, MESSAGES, values, strict=True)}


def flagged(manifest: DataFrame, **columns: str) -> DataFrame:
    """manifest with codes (array), warnings (the codes as text), messages (the full texts) and has_warning.

    Codes and messages are columns of their own, so where no message is read none is formatted.
    """
    skipped, said, broken = F.col(columns.get("n", "n_samples_DE")).isNull(), messages(**columns), rules(**columns)
    each = lambda value: F.when(skipped, F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*(F.when(test, value(code)) for code, test in broken.items()))))
    out = manifest.withColumns({"codes": each(F.lit), "messages": F.array_join(each(lambda code: said[code]), "; ")})
    return out.withColumn("warnings", F.array_join("codes", "; ")).withColumn("has_warning", F.size("codes") > 0)


def observed(checked: DataFrame, into: Observation) -> DataFrame:
    """checked as it is; when it has been written or read whole, ``into`` has the rows, those with a warning and those of each code, counted on the way."""
    counts = [F.count_if(F.array_contains("codes", code)).alias(code) for code in CODES]
    return checked.observe(into, F.count(F.lit(1)).alias("rows"), F.count_if("has_warning").alias("warned"), *counts)


def observed_counts(spark: SparkSession, seen: Observation) -> DataFrame:
    """(code, n) of every code, as ``rule_counts``, from an observation."""
    got = seen.get
    return spark.createDataFrame([(code, got[code]) for code in CODES], "code string, n bigint")


def rule_counts(checked: DataFrame, spark: SparkSession) -> DataFrame:
    """(code, n) of every code, those without rows too."""
    all_ = spark.createDataFrame([(c,) for c in CODES], "code string")
    found = checked.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    return all_.join(found, "code", "left").select("code", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def keyword_counts(checked: DataFrame, keywords: tuple[str, ...] = CODES) -> DataFrame:
    """One row: how often each keyword stands in the warnings."""
    return checked.agg(*(F.coalesce(F.sum(F.regexp_count("warnings", F.lit(k))), F.lit(0)).cast("long").alias(k) for k in keywords))


def expected_codes_found(checked: DataFrame, expected: tuple[str, ...]) -> DataFrame:
    """(code, found): whether each expected code is reported anywhere."""
    wanted = checked.sparkSession.createDataFrame([(c,) for c in dict.fromkeys(expected)], "code string")
    seen = checked.select(F.explode("codes").alias("code")).distinct().withColumn("found", F.lit(True))
    return wanted.join(seen, "code", "left").select("code", F.coalesce("found", F.lit(False)).alias("found"))


def repeated_content(recordings: DataFrame, key: str = "path", signal: str = "data") -> DataFrame:
    """Recordings whose samples are those of another one: (digest, first, n)."""
    digest = F.sha2(F.to_json(signal), 256)
    return recordings.groupBy(digest.alias("digest")).agg(F.min(key).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
