"""Fault frequencies of a bearing, orders and harmonics, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEFAULT_RPM, DRIVE_END, FAULT_MULTIPLIERS, RPM_BY_LOAD, Geometry


def fault_frequencies(rpm: Column, geometry: Geometry = DRIVE_END) -> dict[str, Column]:
    """Rotation, outer and inner race, ball spin and cage frequency in Hz."""
    f = rpm / F.lit(60.0)
    r = geometry.ball_diameter / geometry.pitch_diameter * math.cos(math.radians(geometry.contact_angle))
    return {
        "f_rot": f,
        "BPFO": f * (geometry.balls / 2 * (1 - r)),
        "BPFI": f * (geometry.balls / 2 * (1 + r)),
        "BSF": f * (geometry.pitch_diameter / (2 * geometry.ball_diameter) * (1 - r * r)),
        "FTF": f * ((1 - r) / 2),
    }


def rpm_of(load: Column, default: int | None = DEFAULT_RPM) -> Column:
    """Nominal speed of a load; default (or null) where it is unknown."""
    known = F.create_map(*(F.lit(x) for kv in RPM_BY_LOAD.items() for x in kv))
    return F.coalesce(F.try_element_at(known, load), F.lit(default).cast("int"))


def strict_rpm_of(load: Column) -> Column:
    """Nominal speed of a load; an unknown load is an error."""
    found = rpm_of(load, None)
    return F.when(found.isNull(), F.raise_error(F.concat(F.lit("no nominal speed for load "), F.coalesce(load.cast("string"), F.lit("null"))))).otherwise(found)


def fault_multiples(rpm: Column) -> dict[str, Column]:
    return {name: rpm / F.lit(60.0) * m for name, m in FAULT_MULTIPLIERS.items()}


def order_of(frequency: Column, rpm: Column) -> Column:
    return F.try_divide(frequency, rpm / F.lit(60.0))


def harmonics(frequency: Column, limit: float, count: int = 3) -> Column:
    """(h, frequency) of the first multiples up to limit, as an array of structs."""
    all_ = F.transform(F.sequence(F.lit(1), F.lit(count)), lambda h: F.struct(h.alias("h"), (frequency * h).alias("hz")))
    return F.filter(all_, lambda x: x["hz"] <= limit)
