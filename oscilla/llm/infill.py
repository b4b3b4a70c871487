"""Fill-in-middle: texts cut into three pieces at unit boundaries and put in another order.

A grammar of units says which neighbouring characters belong to one unit: pairs of
character classes, the left one's and the right one's. It becomes a regular expression of
zero width (a lookbehind and a lookahead for each pair) that matches between any other
neighbours, so Spark's ``split`` gives the units back whole. An empty text has no unit,
where ``split`` would give one, and is told apart. Only DataFrame functions are used.

Texts are split in blocks of BLOCK characters, whatever their length, so that the units
of a very long text are never held at once: a block's pieces are counted, less one where
a unit goes on from the block before, and only the block in which a cut falls is split
again, for the cut's place.

How a text is cut, and in which form it is given out, depends on the hash of a salt and
its doc_id only: ``plain`` (as it is), ``psm`` (prefix, suffix, middle) or ``spm``
(suffix, prefix, middle), each piece after its mark. Texts that contain a mark, and empty
ones, stay plain, so marks are unambiguous: ``restored`` finds the pieces by them. (A
piece's end and the mark that follows can't make an earlier mark: no mark's end is
another one's beginning.)

Nulls: a null text counts as empty; a null doc_id is hashed as empty text. Repeated rows
come out alike. Columns other than doc_id and text are ignored, an empty table stays
empty.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Characters of a block.
BLOCK = 65_536
PREFIX, SUFFIX, MIDDLE = MARKS = ("<P>", "<S>", "<M>")


@dataclass(frozen=True)
class Units:
    """A unit grammar: neighbours are in one unit where, for some pair, the left one is of its first class and the right one of its second."""

    joins: tuple[tuple[str, str], ...]

    @property
    def boundary(self) -> str:
        """The zero-width expression between two units (not between the two halves of a character beyond the first plane)."""
        return r"(?!\z|\p{Cs})" + "".join(f"(?:(?<!{left})|(?!{right}))" for left, right in self.joins)

    def joined(self, before: Column, after: Column) -> Column:
        """Whether the last unit of one text goes on in the next text."""
        found = F.lit(False)
        for left, right in self.joins:
            found = found | (before.rlike(rf"{left}\z") & after.rlike(rf"\A{right}"))
        return found


GRAMMARS = {
    #: runs of ASCII letters, every other character by itself
    "words": Units((("[A-Za-z]", "[A-Za-z]"),)),
    "characters": Units(()),
    #: lines with the line feed that ends them
    "lines": Units(((r"[^\n]", r"[\s\S]"),)),
    #: runs of white space and of what is between
    "spaces": Units(((r"\s", r"\s"), (r"\S", r"\S"))),
}


def _counted(rows: DataFrame, units: Units, block: int) -> DataFrame:
    """rows (text) with blocks, ends (units begun before each block, and in all) and n."""
    last = F.greatest(F.ceil(F.length("text") / F.lit(block)) - 1, F.lit(0))
    blocks = F.transform(F.sequence(F.lit(0).cast("long"), last), lambda k: F.substr("text", (k * block + 1).cast("int"), F.lit(block)))

    def begun(b: Column, k: Column) -> Column:
        goes_on = (k > 0) & units.joined(F.get("blocks", k - 1), b)
        return F.size(F.split(b, units.boundary)).cast("long") - goes_on.cast("long")

    sums = F.aggregate("counts", F.array(F.lit(0).cast("long")), lambda ends, c: F.concat(ends, F.array(F.element_at(ends, -1) + c)))
    rows = rows.withColumn("blocks", blocks).withColumn("counts", F.when(F.col("text") == "", F.array(F.lit(0).cast("long"))).otherwise(F.transform("blocks", begun)))
    return rows.withColumn("ends", sums).withColumn("n", F.element_at("ends", -1))


def _placed(rows: DataFrame, units: Units, block: int, unit: str, into: str) -> DataFrame:
    """rows with the number of characters before the unit of that number (all, where there is none)."""
    at = F.size(F.filter("ends", lambda e: e <= F.col(unit))) - 1
    rows = rows.withColumn("_at", F.when(F.col(unit) < F.col("n"), at))
    rows = rows.withColumn("_pieces", F.split(F.get("blocks", F.col("_at")), units.boundary))
    goes_on = F.size("_pieces") - F.get("counts", F.col("_at"))  # 1 if the first piece goes on from the block before
    before = F.slice("_pieces", 1, (F.col(unit) - F.get("ends", F.col("_at")) + goes_on).cast("int"))
    inside = F.aggregate(before, F.lit(0), lambda a, x: a + F.length(x))
    place = F.when(F.col("_at").isNull(), F.length("text")).otherwise(F.col("_at") * block + inside)
    return rows.withColumn(into, place.cast("long")).drop("_at", "_pieces")


def cut(docs: DataFrame, units: str = "words", salt: str = "1:", block: int = BLOCK) -> DataFrame:
    """doc_id, text, n, first, second of every row of docs: units, and the characters before either cut."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = _counted(rows, GRAMMARS[units], block)
    a, b = (_hashed(k, salt) % (F.col("n") + 1) for k in (1, 2))
    rows = rows.withColumns({"u": F.least(a, b), "v": F.greatest(a, b)})
    for unit, into in (("u", "first"), ("v", "second")):
        rows = _placed(rows, GRAMMARS[units], block, unit, into)
    return rows.select("doc_id", "text", "n", "first", "second")


def _hashed(k: int, salt: str) -> Column:
    """The k-th group of eight digits of the hash of a row's doc_id, as a number."""
    digest = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    return F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, units: str = "words", plain: int = 10, suffix_first: int = 20, salt: str = "1:", block: int = BLOCK) -> DataFrame:
    """doc_id, text, n, form, prefix_chars, middle_chars, output of every row of docs (doc_id, text).

    plain, suffix_first: the percentages of texts left plain, and of the others' spm form.
    """
    rows = cut(docs, units, salt, block)
    marked = F.lit(False)
    for mark in MARKS:
        marked = marked | F.contains("text", F.lit(mark))
    form = F.when((F.col("n") == 0) | marked | (_hashed(3, salt) % 100 >= 100 - plain), "plain").when(_hashed(4, salt) % 100 < suffix_first, "spm").otherwise("psm")
    size = F.length("text")
    piece = lambda start, end: F.substr("text", (start + 1).cast("int"), (end - start).cast("int"))
    first, second = F.col("first"), F.col("second")
    prefix, middle, suffix = piece(F.lit(0), first), piece(first, second), piece(second, size)
    rows = rows.withColumn("form", form)
    output = F.when(F.col("form") == "plain", F.col("text")).when(
        F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    ).otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
    cut_ = F.col("form") != "plain"
    return rows.select("doc_id", "text", "n", "form", F.when(cut_, first).alias("prefix_chars"), F.when(cut_, second - first).alias("middle_chars"), output.alias("output"))


def restored(rows: DataFrame, into: str = "restored") -> DataFrame:
    """rows (form, output, ...) with the text that output was made from."""
    rows = rows.withColumn("_parts", F.when(F.col("form") != "plain", F.split("output", "|".join(re.escape(m) for m in MARKS))))
    one, two, middle = (F.get("_parts", F.lit(k)) for k in (1, 2, 3))
    text = F.when(F.col("form") == "psm", F.concat(one, middle, two)).when(F.col("form") == "spm", F.concat(two, middle, one)).otherwise(F.col("output"))
    return rows.withColumn(into, text).drop("_parts")


def op11(docs: DataFrame) -> DataFrame:
    rows = restored(fill_in_middle(docs))
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output").alias("output_sha256"), digest("restored").alias("restored_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), u AS (
  SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS w, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
         ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d
), c AS (
  SELECT doc_id, t, w, len(w) AS n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS a, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u
), p AS (
  SELECT doc_id, t, n, form, coalesce(array_to_string(w[1:a], ''), '') AS p, coalesce(array_to_string(w[a + 1:b], ''), '') AS m, coalesce(array_to_string(w[b + 1:], ''), '') AS s FROM c
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""
