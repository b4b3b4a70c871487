"""Language identification: known words first, shorter and shorter character n-grams for the others.

A text's words are its runs of letters, lower case, composed (NFC). A word that training
texts have often enough is scored by the log of its frequency in each language. Any other
word, put between blanks, is cut into n-grams: those of ORDERS[0] characters that are
known are used, and if there are none those of the next shorter order, and so on; the word's score is the mean of
theirs. A word none of whose characters is known says nothing. The language with the
largest sum over all words of the text is predicted, and its share of the sum of the
languages' likelihoods is the score.

Learning: words are counted by language in their tasks, summed by shuffle, and n-grams
are counted from the table of distinct words, so texts are read once. What is sent to
the tasks is bounded whatever the corpus: an entry (language, word) is kept if the word
has at least a share of L / WORDS of the language's words (L languages), of which there
are at most WORDS entries in all; n-grams likewise with GRAMS for each order. A language
in which a known word doesn't pass has half of that share for it. Languages themselves
are taken to be few (at most some thousands): their totals go through the driver.

Nulls: a null text, or one without a letter, is ``und`` with a score of 0; so is every
text where nothing was learned. Rows whose lang or text is null teach nothing. A null
doc_id isn't held out. Ties go to the language with more words in training, then to the
smaller name. Repeated rows are predicted alike, and count as often as they occur in
training. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Collection, Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, scratch, staged, table, texts, tune
from .ranker import remainder

#: Orders of n-grams, the longest first.
ORDERS = (5, 4, 3, 2, 1)
#: Bounds of the model's entries: of words, and of the n-grams of each order.
WORDS, GRAMS = 100_000, 50_000
#: Counts that a task holds before it gives them out.
HELD = 200_000
#: Bytes of the vectors of words that a task keeps.
CACHE_BYTES = 32_000_000
UNKNOWN = "und"

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """The runs of letters of a text; a run without any letter (such as a fraction sign) is none."""
    found = _WORD.findall((text if text.isascii() else unicodedata.normalize("NFC", text)).lower())
    return found if "".join(found).isalpha() else [w for w in found if any(map(str.isalpha, w))]


def grams_of(word: str, order: int) -> list[str]:
    """The n-grams of a word between blanks; single characters without these."""
    padded = word if order == 1 else f" {word} "
    return [padded[k : k + order] for k in range(len(padded) - order + 1)]


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, level, token, n): the words (level 0) of docs (text, lang), summed by language."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: defaultdict[str, Counter] = defaultdict(Counter)
        for batch in batches:
            for text, lang in zip(texts(batch), batch.column("lang").to_pylist(), strict=True):
                held[lang].update(words_of(text))
                if len(held[lang]) > HELD or len(held) > HELD:
                    yield from given(held)
                    held.clear()
        yield from given(held)

    def given(held: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, found in held.items():
            made = pa.table({"lang": pa.repeat(lang, len(found)), "token": pa.array(found.keys(), pa.string()), "n": pa.array(found.values(), pa.int64())})
            yield from made.to_batches(max_chunksize=10_000)

    made = docs.mapInArrow(counts, "lang string, token string, n bigint")
    return made.groupBy("lang", "token").agg(F.sum("n").alias("n")).select("lang", F.lit(0).alias("level"), "token", "n")


def gram_counts(words: DataFrame) -> DataFrame:
    """(lang, level, token, n): the n-grams of a table of words, the level being their order."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: defaultdict[tuple[str, int], Counter] = defaultdict(Counter)
        for batch in batches:
            for lang, word, n in zip(*(batch.column(c).to_pylist() for c in ("lang", "token", "n")), strict=True):
                for order in ORDERS:
                    found = held[lang, order]
                    for gram in grams_of(word, order):
                        found[gram] += n
            if sum(map(len, held.values())) > HELD:
                yield from given(held)
                held.clear()
        yield from given(held)

    def given(held: dict[tuple[str, int], Counter]) -> Iterator[pa.RecordBatch]:
        for (lang, order), found in held.items():
            data = [pa.repeat(lang, len(found)), pa.repeat(pa.scalar(order, pa.int32()), len(found)), pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())]
            yield from pa.table(data, names=["lang", "level", "token", "n"]).to_batches(max_chunksize=10_000)

    made = words.select("lang", "token", "n").mapInArrow(counts, "lang string, level int, token string, n bigint")
    return made.groupBy("lang", "level", "token").agg(F.sum("n").alias("n"))


class Model:
    """Entries by level: for each token the languages that have it and by how much their log share exceeds the level's floor."""

    def __init__(self, langs: list[str], floors: dict[int, np.ndarray], entries: dict[int, dict[str, dict[str, float]]]):
        self.langs = langs
        place = {lang: k for k, lang in enumerate(langs)}
        self.index: dict[int, dict[str, int]] = {}
        self.floors = floors
        starts, where, above = [0], [], []
        for level, tokens in entries.items():
            slots = self.index[level] = {}
            for token, by_lang in tokens.items():
                slots[token] = len(starts) - 1
                for lang, log in by_lang.items():
                    where.append(place[lang])
                    above.append(log - floors[level][place[lang]])
                starts.append(len(where))
        self.by_order = [(order, self.index.get(order, {})) for order in ORDERS]
        self.starts, self.where, self.above = np.array(starts), np.array(where, np.int32), np.array(above)

    def backed_off(self, word: str) -> tuple[int, list[int]]:
        """The longest order of which n-grams of an unseen word are known, and these; 0 if none is."""
        for order, known in self.by_order:
            if found := [slot for slot in map(known.get, grams_of(word, order)) if slot is not None]:
                return order, found
        return 0, []

    def vectors(self, words: list[str]) -> np.ndarray:
        """A row a word: what one occurrence of it adds to every language's log likelihood."""
        known, width = self.index.get(0, {}), len(self.langs)
        slots: list[int] = []
        found = [(0, [slot]) if (slot := known.get(word)) is not None else self.backed_off(word) for word in words]
        for _, some in found:
            slots += some
        levels, sizes = np.array([level for level, _ in found]), np.array([len(some) for _, some in found])
        at = np.array(slots, int)
        entries = self.starts[at + 1] - self.starts[at]
        flat = np.repeat(self.starts[at + 1] - np.cumsum(entries), entries) + np.arange(entries.sum())
        owner = np.repeat(np.repeat(np.arange(len(words)), sizes), entries)
        out = np.bincount(owner * width + self.where[flat], self.above[flat] / sizes[owner], len(words) * width).astype(float).reshape(len(words), width)
        for level in np.unique(levels):
            some = (levels == level) & (sizes > 0)
            out[some] += self.floors[level]
        return out


class Scorer:
    """Predicts with a model; words met before are kept with their vectors, up to CACHE_BYTES."""

    def __init__(self, model: Model):
        self.model, self.langs = model, model.langs
        self.most = max(1, CACHE_BYTES // (8 * max(1, len(self.langs)) + 100))
        self.known: dict[str, int] = {}
        self.vectors = np.zeros((min(self.most, 1024), len(self.langs)))

    def placed(self, words: Collection[str]) -> np.ndarray:
        """Where the vectors of these words (self.most at most) stand."""
        found = list(map(self.known.get, words))
        if None in found:
            fresh = [w for w, at in zip(words, found, strict=True) if at is None]
            first, size = len(self.known), len(self.known) + len(fresh)
            if size > self.most:
                self.known.clear()
                return self.placed(words)
            if size > len(self.vectors):
                more = min(self.most, 2 * size)
                self.vectors = np.concatenate([self.vectors[:first], np.zeros((more - first, len(self.langs)))])
            self.known.update(zip(fresh, range(first, size), strict=True))
            self.vectors[first:size] = self.model.vectors(fresh)
            found = list(map(self.known.get, words))
        return np.fromiter(found, np.intp, len(found))

    def likelihoods(self, words: list[str]) -> np.ndarray:
        """The log likelihood of the words in every language."""
        counts, total = Counter(words), np.zeros(len(self.langs))
        if len(counts) <= self.most:
            return self._summed(counts.keys(), counts.values())
        for some in batched(counts.items(), self.most):
            total += self._summed(*zip(*some, strict=True))
        return total

    def _summed(self, words: Collection[str], counts: Collection[int]) -> np.ndarray:
        at = self.placed(words)
        return np.fromiter(counts, float, len(counts)) @ self.vectors[at]

    def predict(self, text: str | None) -> tuple[str, float]:
        words = words_of(text or "")
        if not words or not self.langs:
            return UNKNOWN, 0.0
        logs = self.likelihoods(words)
        best = int(logs.argmax())
        return self.langs[best], float(1 / np.exp(logs - logs[best]).sum())


def learn(docs: DataFrame, words: int = WORDS, grams: int = GRAMS) -> Model:
    """The model of docs (text, lang)."""
    spark = docs.sparkSession
    tune(spark)
    with scratch(spark):
        known = docs.select(F.col("lang").cast("string").alias("lang"), "text").filter("lang is not null and text is not null")
        counted = staged(word_counts(known), "langid-words")
        counted = counted.unionByName(staged(gram_counts(counted), "langid-grams"))
        totals = counted.groupBy("level", "lang").agg(F.sum("n").alias("all"))
        sizes = {(r.level, r.lang): r["all"] for r in totals.collect()}
        langs = sorted({lang for level, lang in sizes if level == 0}, key=lambda x: (-sizes[0, x], x))
        least = {(level, lang): n * len(langs) / (words if level == 0 else grams) for (level, lang), n in sizes.items()}
        bounds = spark.createDataFrame([(lang, level, x) for (level, lang), x in least.items()], "lang string, level int, least double")
        rows = counted.join(F.broadcast(bounds), ["lang", "level"]).filter("n >= least").select("level", "lang", "token", "n").toArrow()
    floors, entries = {}, {}
    for level in (0, *ORDERS):
        shares = [max(len(langs) / (words if level == 0 else grams), 1 / (sizes.get((level, lang), 0) + 1)) for lang in langs]
        floors[level], entries[level] = np.log(np.array(shares) / 2), {}
    for level, lang, token, n in sorted(zip(*(rows[c].to_pylist() for c in ("level", "lang", "token", "n")), strict=True)):
        entries[level].setdefault(token, {})[lang] = math.log(n / sizes[level, lang])
    return Model(langs, floors, entries)


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score of every row of docs (doc_id, text)."""
    tune(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        scorer = Scorer(sent.value)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [scorer.predict(t) for t in texts(batch)]
            made = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), *made], names=["doc_id", "lang_pred", "score"])

        return each

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, "doc_id bigint, lang_pred string, score double")


def op12(docs: DataFrame, words: int = WORDS, grams: int = GRAMS) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; the model learns from those that aren't held out."""
    held = remainder(F.col("doc_id"), 4) == 2
    model = learn(docs.filter(~held).select("text", "lang"), words, grams)
    return identified(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12(table(spark, sf_dir, "documents"))
