import random
import re
import subprocess
import sys
from pathlib import Path

import pytest
from conftest_llm import rows_of, sha

from oscilla.llm import decontam


def words(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def want(documents, items, width=10):
    out = {}
    for doc_id, text in documents:
        w, hit, ids = words(text), set(), set()
        for item_id, item in items:
            iw = words(item)
            for k in range(max(1, len(iw) - width + 1)) if iw else ():
                win = iw[k : k + width]
                for i in range(len(w) - len(win) + 1):
                    if w[i : i + len(win)] == win:
                        hit.update(range(i, i + len(win)))
                        if item_id is not None:
                            ids.add(str(item_id))
        out[doc_id] = (len(w), len(hit), len(ids), sha(",".join(sorted(ids))), bool(hit))
    return out


BASE = [f"w{k}" for k in range(30)]
ITEMS = [(2, " ".join(BASE[:12])), (10, " ".join(BASE[5:18])), (3, "Short One!"), (4, None), (5, "..."), (None, " ".join(BASE[20:])), (3, "short one"), (7, "a b a b")]
DOCS = [
    (1, "x " + " ".join(BASE) + " y"),
    (2, "prefix w0, W1\nw2-w3 w4 w5 w6 w7 w8 w9."),
    (3, "this short  ONE and shortone short-one"),
    (4, None),
    (5, ""),
    (6, " ".join(BASE[:9])),
    (7, "a b a b a b c a b"),
    (8, "Ünïcode Short one short one"),
    (9, " ".join(BASE[20:30])),
]


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id bigint, text string")


def test_against_brute_force(spark, docs):
    for rows in (DOCS, DOCS[:1] * 3):
        got = decontam.op9(docs(rows), items(spark, ITEMS))
        assert rows_of(got) == want(rows, ITEMS) and got.count() == len(rows)


@pytest.mark.parametrize("settings", [{"shard": 40}, {"shard": 40, "most": 100}])
def test_shards_and_passes_give_the_same(spark, docs, settings):
    def counted(**settings):
        runs = decontam.scan(docs(DOCS), items(spark, ITEMS), **settings)
        return sorted(tuple(map(str, r)) for r in runs.collect())

    assert counted(**settings) == counted()


def test_random_texts_against_brute_force(spark, docs):
    rng = random.Random(3)
    vocabulary = ["a", "b", "ab", "é", "B", "7"]
    words_ = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    for width in (10, 5, 3, 1):
        benchmark = [(k if k % 7 else None, words_(rng.choice([0, 1, 2, 4, 9, 10, 11, 17, 40]))) for k in range(40)]
        rows = [(k, words_(rng.randrange(60)) + " " + (rng.choice(benchmark)[1] if k % 2 else "")) for k in range(60)]
        index = decontam.Index([(i, decontam.normalised(t)) for i, t in benchmark], width)
        for k, (n, hit, n_items, digest, any_) in want(rows, benchmark, width).items():
            runs, ids = index.find(decontam.normalised(rows[k][1]))
            assert (sum(b - a for a, b in runs), len(ids), decontam.sha256_of_items(ids), bool(runs)) == (hit, n_items, digest, any_), (width, k)


def test_long_items_are_cut_into_pieces(spark, docs):
    long = " ".join(f"x{k}" for k in range(100))
    cut = decontam.pieces(items(spark, [(1, long), (1, long), (2, "a b"), (3, None)]), piece=20).collect()
    assert sorted(len(r.words.split()) for r in cut) == [2, 12, *[20] * 8]
    rows = [(1, f"a {' '.join(long.split()[25:47])} b"), (2, long), (3, "a b c")]
    index = decontam.Index([(r.item_id, bytes(r.words)) for r in cut])
    for k, (n, hit, *_) in want(rows, [(1, long), (2, "a b")]).items():
        assert sum(b - a for a, b in index.find(decontam.normalised(dict(rows)[k]))[0]) == hit


def test_memory_of_large_benchmarks_is_bounded():
    """20 MB of items in shards of the set size: what a worker holds at a time stays below its share of an executor."""
    code = """
import random, resource, sys
sys.path[:0] = [{root!r}]
from oscilla.llm import decontam as d
rng = random.Random(1)
class Sent:
    value = []
size = 0
for k in range(10):
    rows, n = [], 0
    while n < d.SHARD_BYTES - 4000:
        rows.append((len(rows), " ".join("w%x" % rng.randrange(200_000) for _ in range(500)).encode()))
        n += len(rows[-1][1])
    Sent.value.append(rows)
    size += n
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
sent = Sent()
probe = b" ".join(Sent.value[7][3][1].split()[50:70])
found = [d._index(sent, k, 10).find(probe) for k in range(10)]
after = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
assert [bool(x[0]) for x in found] == [k == 7 for k in range(10)] and found[7][1] == {{3}}
print(size, (after - before) // 1024, max(x.size for x in d._indexes.values()) // 2**20)
"""
    root = str(Path(__file__).resolve().parents[2])
    done = subprocess.run([sys.executable, "-c", code.format(root=root)], capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr
    size, grown, largest = map(int, done.stdout.split())
    assert size > 19_000_000 and grown < 700 and largest < 120, done.stdout


def test_empty_tables_and_clean(spark, docs):
    assert decontam.op9(docs(DOCS), items(spark, ITEMS).filter("false")).filter("contaminated").count() == 0
    assert decontam.op9(docs(DOCS).filter("false"), items(spark, ITEMS)).count() == 0
    df = docs(DOCS)
    left = decontam.clean(df, items(spark, ITEMS))
    assert left.columns == df.columns and {r.doc_id for r in left.collect()} == {k for k, v in want(DOCS, ITEMS).items() if not v[4]}


def test_original_offsets():
    text = "Say: w0, W1 -- w2 end"
    runs, ids = decontam.Index([(1, b"w0 w1 w2")]).find(decontam.normalised(text))
    assert (runs, ids) == ([(1, 4)], {1}) and decontam.original_spans(text, runs) == [(5, 17)] and text[5:17] == "w0, W1 -- w2"


def test_located_in_the_original(spark, docs):
    text = "Ünder 😀 Short,  ONE! and short one"
    got = decontam.located(docs([(1, text), (2, "nothing"), (3, None)]), items(spark, ITEMS)).collect()
    assert [(r.doc_id, r["items"], [text[s.start : s.end] for s in r.spans]) for r in got] == [(1, [3], ["Short,  ONE", "short one"])]


def test_long_text(spark, docs):
    text = "filler " * 300_000 + " ".join(BASE)
    assert rows_of(decontam.op9(docs([(1, text)]), items(spark, ITEMS[:2])))[1][:2] == (300_030, 18)
