import random
from collections import Counter

import pytest
from conftest_llm import rows_of, sha

from oscilla.llm import repeats


def want(rows, size=200):
    raw = [(k, (t or "").encode()) for k, t in rows]
    seen = Counter(r[i : i + size] for _, r in raw for i in range(len(r) - size + 1))
    out = []
    for k, r in raw:
        gone = [False] * len(r)
        for i in range(len(r) - size + 1):
            if seen[r[i : i + size]] > 1:
                gone[i : i + size] = [True] * size
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((k, len(r), sum(gone), runs, sha(bytes(b for b, g in zip(r, gone, strict=True) if not g))))
    return sorted(out, key=repr)


def text(rng, n):
    return "".join(rng.choice("abcdefgh ijklé\n") for _ in range(n))


def corpus(seed):
    rng = random.Random(seed)
    passages = [text(rng, n) for n in (150, 199, 200, 201, 260, 500, 1500)]
    rows = []
    for k in range(60):
        parts = []
        for _ in range(rng.randrange(4)):
            parts += [text(rng, rng.randrange(300)), rng.choice(passages)[rng.randrange(60) :]]
        rows.append((k, "".join(parts)))
    near = list(rows[-1][1] or text(rng, 900))
    for k in range(12):
        copy = near[:]
        for _ in range(k):
            copy[rng.randrange(len(copy))] = "#"
        rows.append((100 + k, "".join(copy)))
    return [*rows, (200, "x" * 450), (201, "x" * 199), (202, "ab" * 300), (203, "y" * 200 + "x" * 210), (204, rows[3][1]), (205, None), (206, ""), (None, rows[5][1]), (5, rows[5][1])]


@pytest.mark.parametrize(("seed", "hot"), [(1, repeats.HOT), (2, repeats.HOT), (3, 2)])
def test_against_brute_force(docs, monkeypatch, seed, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    rows = corpus(seed)
    got = repeats.without_repeats(docs(rows))
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want(rows)


def test_without_repeats_nothing_goes(docs):
    rng = random.Random(9)
    rows = [(k, text(rng, 400)) for k in range(20)]
    assert all(v[1] == 0 for v in rows_of(repeats.without_repeats(docs(rows))).values())
    assert repeats.without_repeats(docs(rows).filter("false")).count() == 0


def test_repeats_within_one_long_text(docs):
    rng = random.Random(4)
    passage = text(rng, 300)
    rows = [(1, passage + text(rng, 30_000) + passage + text(rng, 2000))]
    assert [tuple(r) for r in repeats.without_repeats(docs(rows)).collect()] == want(rows)


def test_spans_cover_what_is_removed(docs):
    rows = corpus(5)
    full = {k: v[1] for k, *v in want(rows) if k is not None and k != 5}
    got = {}
    for r in repeats.repeated_spans(docs(rows)).collect():
        got[r.doc_id] = len({b for s in r.spans for b in range(s.start, s.end)})
    assert {k: got.get(k, 0) for k in full} == full


def test_periodic_texts_have_few_anchors(docs):
    assert all(len(a[0]) < 5 for a in repeats.anchors([b"z" * 1_200_000, b"abc" * 100_000]))
    rng = random.Random(8)
    rows = [(1, "z" * 700), (2, text(rng, 100) + "z" * 260 + text(rng, 90)), (3, "ab" * 180), (4, text(rng, 50) + "ab" * 104), (5, "abc" * 70 + text(rng, 250) + "z" * 199)]
    assert sorted((tuple(r) for r in repeats.without_repeats(docs(rows)).collect()), key=repr) == want(rows)


def test_every_window_has_one_anchor():
    rng = random.Random(6)
    raw = [text(rng, n).encode() for n in (0, 50, 199, 200, 201, 5000)] + [b"z" * 1000]
    for r, (_, _, lo, hi, *_) in zip(raw, repeats.anchors(raw), strict=True):
        covered = [i for a, b in zip(lo, hi, strict=True) for i in range(a, b + 1)]
        assert covered == list(range(max(0, len(r) - 199)))


def test_classes_of_suffixes_against_prefixes():
    rng = random.Random(2)
    strings = [bytes(rng.choice(b"ab\0") for _ in range(rng.randrange(9))) for _ in range(300)]
    order = repeats.SuffixOrder(strings, 8)
    assert [strings[k] for k in order.order] == sorted(strings)
    for depth in range(1, 9):
        classes = order.classes(depth)
        for i in range(0, 300, 7):
            for j in range(300):
                if min(len(strings[i]), len(strings[j])) >= depth:
                    assert (classes[i] == classes[j]) == (strings[i][:depth] == strings[j][:depth])


def test_phrases_of_copied_texts_are_read_once(spark, docs, monkeypatch):
    """One text many times, and one other that shares a passage: copies add no phrases."""
    rng = random.Random(12)
    passage = text(rng, 900)
    hot, other = text(rng, 500) + passage + text(rng, 400), text(rng, 300) + passage
    seen = []
    real = repeats.phrase_bytes

    def watched(*args):
        found = real(*args)
        seen.append((found.count(), found.select("core", "phrase").distinct().count()))
        return found

    monkeypatch.setattr(repeats, "phrase_bytes", watched)
    for rows in ([(k, hot) for k in range(60)] + [(1000, other)], [(None, hot)] * 60 + [(1000, other)]):
        got = repeats.without_repeats(docs(rows))
        assert sorted((tuple(r) for r in got.collect()), key=repr) == want(rows)
    assert seen[0][0] == seen[0][1] > 0
    assert seen[1][0] <= seen[1][1] * spark.sparkContext.defaultParallelism


def test_windows_of_hot_cores_are_runs_again(docs, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", 1)
    made = []
    real = repeats.hot_ends
    monkeypatch.setattr(repeats, "hot_ends", lambda *a: made.append(real(*a).collect()) or real(*a))
    rows = corpus(11)
    assert sorted((tuple(r) for r in repeats.without_repeats(docs(rows)).collect()), key=repr) == want(rows)
    spans = [tuple(r) for r in made[0]]
    assert max(b - a for _, a, b in spans) > repeats.SIZE and len(spans) == len(set(spans))
