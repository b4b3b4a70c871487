import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest_llm import rows_of

from oscilla.llm import hmm


def held_out(doc_id):
    return zlib.crc32(str(doc_id if doc_id is not None else "").encode()) % 10 == 0


def tokens(text):
    return [*(text or "").encode().lower().split(), b" "]


def corpus(n=300):
    rng = random.Random(2)
    words = [[f"{p}{k}" for k in range(40)] for p in ("al", "be", "ga")]
    rows = [(k, " ".join(rng.choice(words[k % 3]) for _ in range(rng.randrange(60)))) for k in range(n)]
    return [*rows, (900, None), (901, ""), (902, "NEW new unseen"), (10, "al1 al1 É"), (10, "al1 al1 É")]


def test_base_scores_are_exact(docs):
    rows = corpus()
    got = {}
    for r in hmm.scored(docs(rows)).collect():
        got.setdefault(r.doc_id, r)
    counts = Counter(t for k, x in rows if not held_out(k) for t in tokens(x))
    n, v = sum(counts.values()), len(counts)
    for k, x in rows[:-2]:
        if k == 10:
            continue
        w = tokens(x)
        base = sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in w)
        assert (got[k].held_out, got[k].n_tokens, got[k].n_known, got[k].train_tokens) == (held_out(k), len(w), sum(t in counts for t in w), n)
        assert got[k].base_score == pytest.approx(base, rel=1e-12)
    out = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)  # the states know which words go together


def test_lookups_by_join_give_the_same(docs, monkeypatch):
    df = docs(corpus())
    base = {k: v[4] for k, v in rows_of(hmm.scored(df)).items()}
    monkeypatch.setattr(hmm, "KNOWN_WORDS", 20)
    monkeypatch.setattr(hmm, "CLASS_WORDS", 10)
    assert {k: v[4] for k, v in rows_of(hmm.scored(df)).items()} == pytest.approx(base)


def model(states=3, classes=4, seed=1):
    rng = np.random.default_rng(seed)
    norm = lambda x, axis: x / x.sum(axis, keepdims=True)
    return hmm.Model(norm(rng.random(states), 0), norm(rng.random((states, states)), 1), norm(rng.random((classes, states)), 0))


def brute(m, seq):
    total, posterior = 0.0, np.zeros((len(seq), len(m.start)))
    for path in itertools.product(range(len(m.start)), repeat=len(seq)):
        p = m.start[path[0]] * m.emits[seq[0], path[0]]
        for t in range(1, len(seq)):
            p *= m.moves[path[t - 1], path[t]] * m.emits[seq[t], path[t]]
        total += p
        for t, s in enumerate(path):
            posterior[t, s] += p
    return total, posterior / total


def test_forward_and_expected_counts_are_exact():
    m = model()
    seqs = [[0, 1, 2, 3, 1], [2], [3, 3], [1, 0, 2, 2, 1, 0]]
    codes, lengths = np.array(sum(seqs, [])), np.array(list(map(len, seqs)))
    laid = hmm.TimeMajor(codes, lengths)
    _, scales, _ = hmm.forward(m, laid, False)
    logs = np.add.reduceat(np.log(scales)[laid.place], laid.first)
    assert np.allclose(logs, [math.log(brute(m, s)[0]) for s in seqs])
    start, moves, emits = np.zeros(3), np.zeros((3, 3)), np.zeros((4, 3))
    hmm.expected(m, laid, start, moves, emits)
    full = np.zeros((4, 3))
    for s in seqs:
        for t, row in enumerate(brute(m, s)[1]):
            full[s[t]] += row
    assert np.allclose(emits, full) and np.allclose(start, sum(brute(m, s)[1][0] for s in seqs)) and moves.sum() == pytest.approx(sum(lengths - 1))


def test_training_raises_the_likelihood():
    rng = np.random.default_rng(3)
    codes, lengths = np.concatenate([rng.integers(0, 5, 400), rng.integers(5, 10, 400)]), np.full(40, 20)
    laid, m, before = hmm.TimeMajor(codes, lengths), hmm.Model.random(np.full(10, 0.1), 3), -np.inf
    for _ in range(15):
        sums = np.zeros(3), np.zeros((3, 3)), np.zeros((10, 3))
        now = hmm.expected(m, laid, *sums)
        assert now > before - 5
        before, m = now, hmm.Model.of_counts(*sums, np.full(10, 0.1))
    assert before > 800 * math.log(1 / 6)


def test_pieces_and_blocks():
    assert [x.tolist() for x in hmm.pieces(np.array([5, 0, 8, 4]), 4, 1)] == [[0, 3, 5, 8, 13], [5, 2, 5, 5, 4], [0, 1, 0, 1, 0], [4, 2, 4, 5, 4]]
    codes, lengths = np.arange(21), np.array([5, 0, 8, 8])
    seen = {}
    for chosen, laid, _ in hmm.laid_out(codes, lengths, 8):
        back = laid.codes[laid.place]
        for k, a in zip(chosen, laid.first, strict=True):
            seen[int(k)] = back[a : a + lengths[k]].tolist()
    assert seen == {0: [0, 1, 2, 3, 4], 1: [], 2: list(range(5, 13)), 3: list(range(13, 21))}


def test_empty_tables(docs):
    df = docs(corpus(20))
    assert hmm.scored(df.filter("false")).count() == 0
    none = hmm.scored(df.filter("crc32(cast(doc_id as string)) % 10 = 0")).collect()
    assert none and all(r.train_tokens == 0 and r.base_score == pytest.approx(0) and math.isfinite(r.score) for r in none)


def test_long_text(docs):
    rows = [*corpus(30), (50, "al1 al2 " * 60_000)]
    got = rows_of(hmm.scored(docs(rows)))[50]
    assert got[1] == 120_001 and math.isfinite(got[5])


def test_training_sees_whole_texts_until_the_likelihood_settles(spark):
    # what stands after the first words decides the states; a start from the first 400 words knows one language only
    rng = np.random.default_rng(5)
    seqs = [np.concatenate([np.zeros(400, int), rng.integers(1 + 20 * (k % 2), 21 + 20 * (k % 2), 400)]).tolist() for k in range(40)]
    rows = spark.createDataFrame([(x,) for x in seqs], "ids array<int>").repartition(3)
    prior = np.bincount(np.concatenate(seqs), minlength=41) + 0.1
    prior = prior / prior.sum()
    m = hmm.trained(rows, prior)
    after, now = hmm.baum_welch(rows, m, prior)
    _, later = hmm.baum_welch(rows, after, prior)
    assert later - now <= 2 * hmm.SETTLED * abs(now)
    assert now > 40 * 400 * math.log(1 / 22)
    sums = np.zeros(8), np.zeros((8, 8)), np.zeros((41, 8))
    assert now == pytest.approx(hmm.expected(m, hmm.TimeMajor(np.concatenate(seqs), np.full(40, 800)), *sums), rel=1e-5)


def test_cut_texts_give_the_counts_of_whole_ones():
    rng = np.random.default_rng(8)
    m = model(3, 6)
    lengths = np.array([700, 20, 0, 1300])
    codes = rng.integers(0, 6, lengths.sum())

    def counts(codes, lengths, own):
        sums = np.zeros(3), np.zeros((3, 3)), np.zeros((6, 3))
        reached = sum(hmm.expected(m, laid, *sums, part) for _, laid, part in hmm.laid_out(codes, lengths, 300, own))
        return *sums, reached

    whole = counts(codes, lengths, None)
    cut = counts(*hmm.in_pieces(codes, lengths, 100, 40))
    assert cut[0].sum() == pytest.approx(3) and cut[1].sum() == pytest.approx(lengths.sum() - 3) and cut[2].sum() == pytest.approx(lengths.sum())
    assert all(np.allclose(a, b, rtol=1e-6, atol=1e-6) for a, b in zip(whole[:3], cut[:3], strict=True))
    assert cut[3] == pytest.approx(whole[3], rel=1e-6)


def test_score_is_that_of_a_plain_model(docs, monkeypatch):
    """The whole score, classes, shares, rare and unknown words included, by dictionaries and plain loops."""
    monkeypatch.setattr(hmm, "KNOWN_WORDS", 60)
    monkeypatch.setattr(hmm, "CLASS_WORDS", 25)
    made = []
    real = hmm.trained
    monkeypatch.setattr(hmm, "trained", lambda *a: made.append(real(*a)) or made[-1])
    rows = corpus(120)
    got = {r.doc_id: r for r in hmm.scored(docs(rows)).collect()}
    m = made[0]
    counts = Counter(t for k, x in rows if not held_out(k) for t in tokens(x))
    steps = Counter(math.floor(math.log2(c) * 64) for c in counts.values())
    known, size = set(), 0
    for step in sorted(steps, reverse=True):
        size += steps[step]
        if size > 60:
            break
        known |= {t for t, c in counts.items() if math.floor(math.log2(c) * 64) == step}
    own = sorted(known, key=lambda t: (-counts[t], t))[:25]
    n = len(own)
    suffix = lambda t: zlib.crc32(t[-3:]) % hmm.SUFFIXES
    mass = [0.1] * hmm.SUFFIXES
    for t, c in counts.items():
        if t not in own:
            mass[suffix(t)] += c + 0.1
    assert m.emits.shape[0] == n + hmm.SUFFIXES and 0 < len(known) <= 60 < len(counts)
    states = range(len(m.start))
    for k, x in rows:
        if k == 10:  # three texts
            continue
        w = tokens(x)
        code = [own.index(t) if t in own else n + suffix(t) for t in w]
        share = sum(math.log10((counts[t] + 0.1) / mass[suffix(t)]) for t in w if t not in own)
        a = [m.start[i] * m.emits[code[0], i] for i in states]
        for c in code[1:]:
            a = [sum(a[i] * m.moves[i, j] for i in states) * m.emits[c, j] for j in states]
        assert got[k].score == pytest.approx(math.log10(sum(a)) + share, rel=1e-6), k


def test_the_model_is_better_than_its_base_on_documents(spark):
    held = hmm.query(spark, "/root/testdata/sf0.01").filter("held_out").selectExpr("sum(score) AS s", "sum(base_score) AS b", "sum(n_tokens) AS n").first()
    assert held.s > held.b


def test_ties_in_the_vocabulary_cut_are_in_or_out_together(docs, monkeypatch):
    monkeypatch.setattr(hmm, "KNOWN_WORDS", 5)
    texts = docs([(k, "a b c d e f g h i j") for k in range(12)])
    counts = hmm.counted(texts)
    v = hmm.Vocabulary(counts)
    assert v.words == [] and v.distinct == 11 and v.total == 12 * 11
    assert [r.score for r in hmm.scored(texts).collect()] == pytest.approx([hmm.scored(texts).first().score] * 12)
