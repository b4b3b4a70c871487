"""What the paths of recordings say: three layouts, the class label and the file id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import LABEL_NUMBERS, NORMAL_FILES


def _match(text: Column, pattern: str) -> Column:
    """Group 1 of the pattern, null without a match."""
    found = F.regexp_extract(text, pattern, 1)
    return F.when(found != "", found)


def by_load_folder(path: str | Column) -> dict[str, Column]:
    """``<n>hp/<label>_<mils>[_<position>].mat``"""
    path = F.col(path) if isinstance(path, str) else path
    parts = F.split(path, "/")
    folder = F.try_element_at(parts, F.lit(-2))
    stem = F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "")
    words = F.split(stem, "_")
    normal = F.lower(stem).startswith("normal")
    first = F.upper(F.get(words, F.lit(0)))
    second = F.get(words, F.lit(1))
    label = F.when(normal, "Normal").when(first.isin("IR", "OR", "B"), first)
    return {
        "load_hp": _match(folder, r"(?i)(\d+)\s*hp").try_cast("int"),
        "label": label,
        "fault_diameter_mils": F.when(~normal & second.rlike("^[0-9]+$"), second.try_cast("int")),
        "or_position": F.when(~normal & (label == "OR"), F.get(words, F.lit(2))),
    }


def by_path_parts(path: str | Column) -> dict[str, Column]:
    """A part of the path is the label; the load ends the name, or is known for the normal files. -1: unresolved."""
    path = F.col(path) if isinstance(path, str) else path
    parts = F.split(F.upper(path), "/")
    label = F.lit(-1)
    for name, number in reversed(LABEL_NUMBERS.items()):
        label = F.when(F.array_contains(parts, name), number).otherwise(label)
    name = F.element_at(F.split(path, "/"), -1)
    normal_load = F.lit(-1)
    for mark, load in reversed(NORMAL_FILES):
        normal_load = F.when(name.contains(mark), load).otherwise(normal_load)
    load = F.coalesce(_match(name, r"_(\d+)\.mat$").try_cast("int"), F.when(label == 0, normal_load), F.lit(-1))
    return {"Label": label, "Load": load}


def resolved(files: DataFrame, path: str = "path") -> DataFrame:
    """Filepath, Label, Load of the .mat files for which both are known."""
    parsed = by_path_parts(path)
    found = files.filter(F.col(path).endswith(".mat")).select(F.col(path).alias("Filepath"), *(c.alias(k) for k, c in parsed.items()))
    return found.filter((F.col("Label") != -1) & (F.col("Load") != -1))


def by_type_folders(relative: str | Column) -> dict[str, Column]:
    """``<type>/<size>[/@position]/<id>_<load>.mat``; absent parts are the text None, missing folders null."""
    relative = F.col(relative) if isinstance(relative, str) else relative
    folders = F.split(relative, "/")
    at = lambda k: F.try_element_at(folders, F.lit(k))
    normal, placed = relative.contains("Normal"), F.coalesce(at(-2).startswith("@"), F.lit(False))
    none = F.lit("None")
    return {
        "fault_type": F.when(normal, "Normal").when(placed, at(-4)).otherwise(at(-3)),
        "fault_size": F.when(normal, none).when(placed, at(-3)).otherwise(at(-2)),
        "position": F.when(normal | ~placed, none).otherwise(at(-2)),
        "load_hp": _match(at(-1), r"_(\d)\.mat$").try_cast("int"),
    }


def class_label(fault_type: Column, size: Column, position: Column) -> Column:
    return F.when(fault_type == "Normal", "Normal").otherwise(F.concat_ws("_", fault_type, size, F.when(position != "None", position)))


def file_id(*parts: Column) -> Column:
    """Parts joined by _, null as nan."""
    return F.concat_ws("_", *(F.coalesce(p.cast("string"), F.lit("nan")) for p in parts))


def relative_to(path: str | Column, root: str) -> Column:
    return F.regexp_replace(path, "^" + root.rstrip("/").replace(".", r"\.") + "/", "")
