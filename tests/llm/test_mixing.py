import re

import pytest
from conftest_llm import rows_of

from oscilla.llm import mixing


def level(sizes, weights, whole):
    """Targets by clamping and resharing by turns."""
    target, free, left = {}, set(sizes), whole
    while free:
        total = sum(weights[s] for s in free)
        over = {s for s in free if left * weights[s] / total > 2 * sizes[s] + 1e-9}
        if not over:
            return target | {s: left * weights[s] / total for s in free}
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        free -= over
    return target


def test_targets_are_the_fixpoint(docs):
    rows = [(k, " ".join(["w"] * n), s) for k, (n, s) in enumerate([(50, "a"), (400, "b"), (30, "c"), (7, "d"), (300, "é"), (200, None), (0, "z")])]
    got = rows_of(mixing.op1(docs(rows)))
    order = ["a", "b", "c", "d", "z", "é", None]
    sizes = {s: sum(len((t or "").split()) for _, t, x in rows if x == s) for s in order}
    want = level(sizes, {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, 1.5 * sum(sizes.values()))
    for doc_id, text, source in rows:
        size, total, target, taken = got[doc_id]
        assert size == len(text.split()) and total == sizes[source] and target == pytest.approx(want[source])
        assert 0 <= taken <= 2 * size and (size == 0 or taken % size == 0)


def test_taken_words_come_near_and_reruns_agree(docs):
    rows = [(k, "x " * (1 + k * 37 % 90), f"s{k * k % 7}") for k in range(1500)]
    first, again = rows_of(mixing.op1(docs(rows))), rows_of(mixing.op1(docs(rows)))
    assert first == again
    by_source = {}
    for k, _, s in rows:
        size, total, target, taken = first[k]
        assert taken <= 2 * size
        by_source.setdefault(s, [target, 0])[1] += taken
    assert all(abs(taken - target) <= 90 for target, taken in by_source.values())


def test_nulls_empty_and_repeats(docs):
    rows = [(None, "a b", None), (1, None, "s"), (1, None, "s"), (2, "", "s"), (3, "c d e", "s"), (3, "c d e", "s")]
    got = mixing.op1(docs(rows)).collect()
    assert len(got) == 6 and sum(r["size"] for r in got) == 8
    assert mixing.op1(docs([(1, "a", "s")]).filter("false")).count() == 0
    assert mixing.op1(docs([(1, None, None)])).first().taken == 0


def test_words_are_runs_of_other_than_ascii_space(docs):
    text = "a b\x0bc\x1cd e  f\n"
    assert rows_of(mixing.op1(docs([(1, text)])))[1][0] == len(re.findall(r"[^\x20\x09-\x0D]+", text)) == 3


def test_mix_repeats_rows_and_keeps_columns(docs):
    df = docs([(k, "w " * 10, "ab"[k % 2]) for k in range(40)], clash=False)
    got = mixing.mix_sources(df)
    assert got.columns == [*df.columns, "copy"]
    taken = rows_of(mixing.op1(df))
    counts = {r.doc_id: r["count"] for r in got.groupBy("doc_id").count().collect()}
    assert all(counts.get(k, 0) * 10 == taken[k][3] for k in range(40))


def test_mix_of_clashing_columns(docs):
    df = docs([(1, "a b"), (2, "c d e")])
    got = mixing.mix_sources(df)
    assert got.columns == [*df.columns, "copy_"] and got.count() == got.filter("copy = 1").count()


def test_native_plan(docs):
    plan = mixing.op1(docs([(1, "a b")]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_a_very_long_text(docs):
    """One text of two million words in a source of its own, beside small ones."""
    rows = [(1, "w " * 2_000_000, "a"), (2, "one two three", "b"), (3, "x " * 100, "b")]
    got = rows_of(mixing.op1(docs(rows)))
    assert {k: v[0] for k, v in got.items()} == {1: 2_000_000, 2: 3, 3: 100}
    assert all(v[3] <= 2 * v[0] for v in got.values()) and got[1][3] <= got[1][2] + 2_000_000
