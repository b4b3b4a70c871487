import random

import numpy as np
import pytest
from conftest_llm import rows_of

from oscilla.llm import minhash
from oscilla.llm.common import connected_components, least_of_components


def shingles(text, width):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset()


def want(rows, width=4, percent=80):
    sets, root = {}, {}
    for k, text in rows:
        if k is not None:
            sets.setdefault(k, []).append(shingles(text, width))
            root[k] = k

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i in ids:
        for j in ids:
            if i < j and any(a and b and 100 * len(a & b) >= percent * len(a | b) for a in sets[i] for b in sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {k: find(k) for k in ids}


def corpus(seed, groups=12, alone=40):
    rng = random.Random(seed)
    word = lambda: f"v{rng.randrange(3000)}"
    rows = [(k, " ".join(word() for _ in range(rng.randrange(1, 120)))) for k in range(alone)]
    for _ in range(groups):
        base = [word() for _ in range(rng.randrange(20, 150))]
        for _ in range(rng.randrange(2, 14)):
            copy = [word() if rng.random() < rng.choice((0, 0.01, 0.02, 0.05)) else w for w in base]
            rows.append((len(rows), " ".join(copy)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(docs, seed):
    rows = corpus(seed)
    got = minhash.op7(docs(rows))
    root = want(rows)
    assert len(set(root.values())) < len(root) - 10
    assert rows_of(got) == {k: (len(shingles(t, 4)), root[k], root[k] == k) for k, t in rows}


def test_special_rows(docs):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "A  b"), (6, "a b c d e"), (7, "a b c d e"), (7, "q r s t u v"), (8, "Q r s t u v"), (None, "a b"), (9, "b a"), (10, "É x"), (11, "é x"), (6, "a b c d e")]
    got = sorted((tuple(r) for r in minhash.op7(docs(rows)).collect()), key=repr)
    root = want(rows)
    assert root[8] == 6
    assert got == sorted(((k, len(shingles(t, 4)), root.get(k), k is None or root[k] == k) for k, t in rows), key=repr)
    assert minhash.op7(docs(rows).filter("false")).count() == 0


def test_two_texts_of_one_id(docs):
    a, b = " ".join(f"a{k}" for k in range(60)), " ".join(f"b{k}" for k in range(60))
    rows = [(7, a), (7, b), (8, a + " x"), (9, b + " x"), (20, "c d e f g h"), (21, "c d e f g h"), (3, "z z z z z")]
    assert {k: v[1] for k, v in rows_of(minhash.op7(docs(rows))).items()} == want(rows) == {7: 7, 8: 7, 9: 7, 20: 20, 21: 20, 3: 3}


def test_one_of_each_stays(docs):
    rows = corpus(7)
    df = docs(rows)
    left = minhash.distinct_documents(df, width=5)
    root = want(rows, 5)
    assert left.columns == df.columns and sorted(r.doc_id for r in left.collect()) == sorted(set(root.values()))


def test_one_of_repeated_and_null_ids_stays(docs):
    rng = random.Random(3)
    words = lambda n: " ".join(f"q{rng.randrange(9000)}" for _ in range(n))
    a, b, c = words(40), words(40), words(40)
    rows = [(5, a), (5, a), (3, a + " x"), (None, b), (None, b), (None, b + " y"), (7, c), (None, c), (8, words(30)), (8, words(30)), (None, None), (None, ""), (9, None)]
    left = sorted(((r.doc_id, r.text) for r in minhash.distinct_documents(docs(rows), width=5).collect()), key=repr)
    assert [k for k, _ in left].count(None) == 3 and len([t for k, t in left if k is None and t]) == 1
    assert sorted(k for k, _ in left if k is not None) == [3, 7, 8, 8, 9]


@pytest.mark.parametrize("seed", range(2))
def test_divided_keys_lose_no_link(docs, seed):
    """Every key with members outside its largest component goes by way of a second chunk."""
    rows = corpus(seed + 20, groups=25)
    rng = random.Random(seed)
    base = [f"v{k}" for k in range(80)]  # half alike, and links among them
    for k in range(60):
        rows.append((1000 + k, " ".join(w if rng.random() < rng.choice((0.8, 0.97)) else f"r{rng.randrange(10**6)}" for w in base)))
    root = want(rows)
    for split in (0, 3, 10**6):
        got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs(rows), 4, 80, split=split).collect()}
        assert got == root


def test_long_texts_of_divided_keys_lose_no_link(docs):
    """Texts of keys that are divided by a second chunk as they are long, or some of them."""
    rows, rng = corpus(31, groups=10), random.Random(5)
    base = [f"v{k}" for k in range(80)]
    rows += [(1000 + k, " ".join(w if rng.random() < rng.choice((0.8, 0.97)) else f"r{rng.randrange(10**6)}" for w in base)) for k in range(40)]
    root = want(rows)
    for long in (0, 70):
        assert {r.doc_id: r.component_id for r in minhash.near_duplicates(docs(rows), 4, 80, split=0, long=long).collect()} == root


def test_texts_that_share_keys_but_are_not_similar_are_not_all_paired(docs, monkeypatch):
    """300 texts share 60 of 71 shingles, others a line: pairs grow with the texts, not with their square, and links among them are found."""
    from pyspark.sql import functions as F

    rng, compared = random.Random(2), []
    own = lambda n: [f"o{rng.randrange(10**7)}" for _ in range(n)]
    core, line = [f"c{k}" for k in range(63)], [f"l{k}" for k in range(12)]
    rows = [(k, " ".join([*core, *own(11)])) for k in range(300)] + [(300 + k, " ".join([*line, *own(20)])) for k in range(100)]
    rows += [(1000 + k, rows[k][1] + " more") for k in (7, 150, 299, 310, 399)]

    def across(open_, *rest, known=minhash.across_components, **named):
        compared.extend(tuple(r) for r in open_.groupBy("key").agg(F.count(F.lit(1)), F.count_if(F.col("component") != F.col("main"))).collect())
        return known(open_, *rest, **named)

    def rarest(*given, known=getattr(minhash, "by_rarest", None)):
        found = known(*given)
        few.append(found.count())
        return found

    few = []
    monkeypatch.setattr(minhash, "across_components", across)
    monkeypatch.setattr(minhash, "by_rarest", rarest, raising=False)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs(rows), 4, 80).collect()}
    assert got == {k: k - 1000 if k >= 1000 else k for k, _ in rows}
    assert sum(n * outside for _, n, outside in compared) + sum(few) < 36 * 16 * len(rows)


def test_rarest_shingles_find_all_similar_pairs(spark):
    rng = random.Random(8)
    sets, component = [], {}
    for group in range(12):
        base = [rng.randrange(-(2**62), 2**62) for _ in range(rng.choice((1, 3, 5, 20, 21, 60)))]
        for _ in range(15):
            x = {v if rng.random() < rng.choice((0.85, 0.95, 1)) else rng.choice((group, rng.randrange(2**62))) for v in base} | set(range(rng.randrange(3)))
            component[len(sets)] = rng.choice((group, len(sets) + 100, len(sets) + 100))
            sets.append(x)
    ids = spark.createDataFrame(list(component.items()), "id bigint, component bigint")
    table = spark.createDataFrame([(k, list(x), len(x)) for k, x in enumerate(sets)], "id bigint, shingles array<bigint>, n bigint")
    for percent in (80, 65):
        pairs = [(a, b) for a in component for b in component if a < b and component[a] != component[b]]
        similar = {(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])}
        got = [tuple(r) for r in minhash.by_rarest(ids, table, percent).collect()]
        assert len(similar) > 100 and similar <= {r[:2] for r in got} and len(got) == len(set(got)) < len(pairs) / 3
        assert all(a < b and (component[a], component[b]) == (x, y) and x != y for a, b, x, y in got)


def test_second_chunks_keep_all_pairs_within_the_errors():
    """By pigeonhole: signatures with at most ERRORS errors that share a key share one of its divided keys."""
    import pyarrow as pa

    rng = np.random.default_rng(4)
    each = minhash.COMPONENTS // minhash.CHUNKS
    for _ in range(300):
        a = rng.integers(0, 2**16, minhash.COMPONENTS, dtype=np.uint16)
        b = a.copy()
        places = rng.choice(minhash.COMPONENTS, int(rng.integers(0, minhash.ERRORS + 1)), replace=False)
        b[places] ^= 1
        parts = minhash.chunks_of(pa.array([a.tobytes(), b.tobytes()]))
        shared = [(c, x) for c in range(minhash.CHUNKS) for x in range(each) if len(set(minhash.variants(parts, c, (x,)).tolist())) == 1]
        assert shared
        for own, _ in shared:
            assert any(len(set(minhash.variants(parts, c, (x, y)).tolist())) == 1 for c in range(minhash.CHUNKS) if c != own for x in range(each) for y in range(x + 1, each))


def test_a_pair_is_given_out_under_its_first_key_only(spark):
    """Over all keys and divided keys that pairs of signatures share, exactly one is the first."""
    import pyarrow as pa
    from pyspark.sql import functions as F

    rng = np.random.default_rng(9)
    each, rows = minhash.COMPONENTS // minhash.CHUNKS, []
    for n in range(120):
        a = rng.integers(0, 2**16, minhash.COMPONENTS, dtype=np.uint16)
        b = a.copy()
        for c in range(minhash.CHUNKS):
            places = c * each + rng.choice(each, int(rng.choice([0, 1, 1, 2, 2, 3])), replace=False)
            b[places] ^= rng.choice([1, 0x8000, 0xFFFF, 0x10], len(places)).astype(np.uint16)
        parts = minhash.chunks_of(pa.array([a.tobytes(), b.tobytes()]))
        x = (a.view(np.int64) ^ b.view(np.int64)).tolist()
        for c in range(minhash.CHUNKS):
            for left in range(each):
                if len(set(minhash.variants(parts, c, (left,)).tolist())) == 1:
                    rows.append((n, -1, False, c * each + left, *x))
                    if left == 0:
                        for c2 in range(minhash.CHUNKS):
                            for v, pair in enumerate(minhash.PAIRS_LEFT_OUT):
                                if c2 != c and len(set(minhash.variants(parts, c2, pair).tolist())) == 1:
                                    rows.append((n, c, True, c << 6 | (c2 * len(minhash.PAIRS_LEFT_OUT) + v), *x))
    names = [f"x{k}" for k in range(minhash.CHUNKS)]
    df = spark.createDataFrame(rows, "n int, own int, second boolean, key bigint, " + ", ".join(f"{x} bigint" for x in names))
    apart = [F.col(x) for x in names]
    first = F.when(F.col("second"), minhash.first_shared(F.col("key"), apart, True)).otherwise(minhash.first_shared(F.col("key"), apart, False))
    got = df.groupBy("n", "own").agg(F.count_if(first).alias("firsts")).collect()
    assert len(got) > 200 and all(r.firsts == 1 for r in got)


def test_large_components_are_not_paired_within(spark):
    """A key with one large component and few others: rows grow with its members, not with their square."""
    rows = [(64, k, 0) for k in range(500)] + [(64, 500, 500), (64, 501, 501), (128, 1, 0), (128, 2, 0)]
    members = minhash.outside(spark.createDataFrame(rows, "key bigint, id bigint, component bigint"))
    assert members.count() == 502 and {(r.main, r.rest) for r in members.collect()} == {(0, 2)}
    sets = spark.range(502).selectExpr("id", "10L AS n", *(f"0L AS x{k}" for k in range(minhash.SKETCH)), *(f"0L AS s{k}" for k in range(minhash.CHUNKS)))
    found = minhash.across_components(members, sets, 80).collect()
    assert len(found) == 2 * 500 + 1 and all(r.a < r.b and r.ca != r.cb for r in found)
    assert {(r.a, r.b, r.ca, r.cb) for r in found if r.b == 501 and r.a >= 499} == {(499, 501, 0, 501), (500, 501, 500, 501)}


def test_sketches_never_rule_out_similar_sets():
    rng = np.random.default_rng(1)
    for n in (1, 4, 30, 500, 6000):
        a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        b = np.concatenate([a[: int(n * 0.95)], rng.integers(0, 2**64, n // 20, dtype=np.uint64)])
        apart = sum(int(x).bit_count() for x in (minhash.sketch(a) ^ minhash.sketch(b)).view(np.uint64))
        assert apart <= len(set(a.tolist()) ^ set(b.tolist()))


def test_long_texts_in_blocks():
    text = b" ".join(b"w%d" % (k % 5000) for k in range(400_000))
    sets = list(minhash.shingle_sets([b"a b c d", text, b"", b"a b c d"], 4))
    assert len(sets[1]) == 5000 and (sets[0] == sets[3]).all() and len(sets[2]) == 0


@pytest.mark.parametrize("local", [0, 10**6])
def test_components(spark, local):
    rng = random.Random(5)
    edges = [(k, k + 1) for k in range(30)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)] + [(500, k) for k in range(501, 700)] + [(9, 9)]
    a, b = (np.array(x) for x in zip(*[e for e in edges if e[0] != e[1]], strict=True))
    ids, least = least_of_components(a, b)
    got = connected_components(spark.createDataFrame(edges, "a bigint, b bigint"), local_edges=local)
    assert {r.id: r.component for r in got.collect()} == dict(zip(ids.tolist(), least.tolist(), strict=True))
    assert connected_components(spark.createDataFrame(edges, "a bigint, b bigint").filter("false"), local_edges=local).count() == 0
