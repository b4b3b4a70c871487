import math
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from oscilla.llm import langid, queries

LETTERS = {"aa": "abcdef", "bb": "defghé", "cc": "ghäöxy"}


def invented(count, seed=1, longest=12):
    """(doc_id, text, lang): words of each language's letters, some shared; some rows without a language."""
    rng = random.Random(seed)
    pool = {lang: ["".join(rng.choice(x) for _ in range(rng.randrange(1, 8))) for _ in range(60)] for lang, x in LETTERS.items()}
    rows = []
    for k in range(count):
        lang = rng.choice(sorted(LETTERS))
        words = [rng.choice(pool[lang]) if rng.random() < 0.8 else "".join(rng.choice(LETTERS[lang] + "aZq") for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(longest))]
        rows.append((k, " ".join(words).capitalize() + rng.choice(["", ".", " 12 ½"]), lang if rng.random() < 0.9 else None))
    return rows


def frame(spark, rows, clash=True):
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    return df.withColumns({c: F.lit(1) for c in ("n", "token", "level", "score", "all", "least", "a.b")}) if clash else df


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def plain_model(rows, words, grams):
    """Counts and scores written down as the docstring has them, without tables of entries."""
    levels = (0, *langid.ORDERS)
    tokens = lambda text, level: [t for w in langid.words_of(text) for t in ([w] if level == 0 else langid.grams_of(w, level))]
    counts = {(level, lang): Counter() for level in levels for lang in {x for _, t, x in rows if x and langid.words_of(t or "")}}
    for doc_id, text, lang in rows:
        if not held_out(doc_id) and lang and text:
            for level in levels:
                counts.setdefault((level, lang), Counter()).update(tokens(text, level))
    langs = sorted({lang for (level, lang), c in counts.items() if level == 0 and c}, key=lambda x: (-counts[0, x].total(), x))
    bound = lambda level: words if level == 0 else grams
    passes = lambda level, lang, t: counts[level, lang][t] > 0 and counts[level, lang][t] >= counts[level, lang].total() * len(langs) / bound(level)
    known = lambda level, t: any(passes(level, lang, t) for lang in langs)

    def log(level, lang, t):
        total = counts[level, lang].total()
        return math.log(counts[level, lang][t] / total) if passes(level, lang, t) else math.log(max(len(langs) / bound(level), 1 / (total + 1)) / 2)

    def predict(text):
        found = langid.words_of(text or "")
        if not found or not langs:
            return "und", 0.0
        sums = dict.fromkeys(langs, 0.0)
        for w in found:
            use, level = ([w], 0) if known(0, w) else ([], 0)
            for order in langid.ORDERS:
                if use:
                    break
                use, level = [g for g in langid.grams_of(w, order) if known(order, g)], order
            for lang in langs:
                sums[lang] += sum(log(level, lang, t) for t in use) / max(1, len(use))
        best = max(langs, key=lambda x: sums[x])
        return best, 1 / sum(math.exp(sums[x] - sums[best]) for x in langs)

    return predict


@pytest.mark.parametrize(("words", "grams"), [(100_000, 50_000), (200, 100)])
def test_same_as_plain_model(spark, words, grams):
    """With bounds that keep all entries, and with such that keep few."""
    rows = invented(300)
    predict = plain_model(rows, words, grams)
    for r in langid.op12(frame(spark, rows), words, grams).collect():
        lang, score = predict(rows[r.doc_id][1])
        assert (r.held_out, r.score) == (held_out(r.doc_id), pytest.approx(score, rel=1e-6, abs=1e-12))
        assert r.lang_pred == lang or score == pytest.approx(0.5, abs=0.17)  # sums in another order may part a tie otherwise


def test_edges(spark):
    long = "wort " * 200_000
    rows = [(1, "wort wort", "de"), (3, "word", "en"), (3, "word", "en"), (None, "word", "en"), (4, None, "de"), (5, "", "de"), (6, "12 ½ ²-_", "de"), (7, "Wort", None), (8, long, "de"), (9, "x" * 500_000, None), (10, "漢字", None)]
    got = sorted(((r.doc_id, r.lang_pred, r.held_out) for r in langid.op12(frame(spark, rows)).collect()), key=repr)
    want = {1: "de", 3: "en", None: "en", 4: "und", 5: "und", 6: "und", 7: "de", 8: "de"}
    assert len(got) == len(rows) and all(lang == want[k] for k, lang, _ in got if k in want)
    assert {lang for k, lang, _ in got if k in (9, 10)} <= {"de", "en"}
    assert langid.op12(frame(spark, [])).count() == 0


def test_nothing_to_learn(spark):
    assert [(r.lang_pred, r.score) for r in langid.op12(frame(spark, [(1, "word", None)])).collect()] == [("und", 0.0)]


def test_backing_off_takes_the_longest_known_order(spark):
    model = langid.learn(spark.createDataFrame([("abcdef zz", "aa"), ("xyz", "bb")], "text string, lang string"))
    assert model.backed_off("abcdq")[0] == 5 and model.backed_off("qabcq")[0] == 3 and model.backed_off("qaq")[0] == 1
    assert model.backed_off("qqq") == (0, [])
    scorer = langid.Scorer(model)
    assert scorer.predict("qabcq")[0] == "aa" and scorer.predict("yzq")[0] == "bb"


def test_little_room_for_vectors(spark, monkeypatch):
    """Words that don't fit into what a task keeps are looked up again."""
    rows = invented(60)
    model = langid.learn(frame(spark, rows))
    want = [langid.Scorer(model).predict(t) for _, t, _ in rows]
    for room in (1, 1000):
        monkeypatch.setattr(langid, "CACHE_BYTES", room)
        scorer = langid.Scorer(model)
        for (_, text, _), (lang, score) in zip(rows, want, strict=True):
            got = scorer.predict(text)
            assert got[1] == pytest.approx(score) and (got[0] == lang or score < 0.67)


def test_entries_are_bounded(spark):
    """However many distinct words there are, the model has no more entries than its bounds."""
    rng = random.Random(5)
    rows = [("".join(rng.choice("abcdefghij") for _ in range(6)) + " the", lang) for lang in ("aa", "bb") for _ in range(2000)]
    model = langid.learn(spark.createDataFrame(rows, "text string, lang string"), 300, 200)
    assert 0 < len(model.index[0]) <= 300 and all(len(model.index[k]) <= 200 for k in langid.ORDERS)
    assert "the" in model.index[0]


def test_held_out_documents(spark):
    """Texts of the given table that the model hasn't learned from."""
    sf = "/root/testdata/sf0.01"
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    rows = queries.QUERIES["op12_language"](spark, sf).join(truth, "doc_id").filter("held_out and lang_pred <> 'und'").collect()
    right = sum(r.lang == r.lang_pred for r in rows) / len(rows)
    assert len(rows) > 150 and right >= 0.97
