import hashlib
import random
import re

import pytest
from conftest_llm import rows_of, sha

from oscilla.llm import infill

SPLIT = {"words": r"[A-Za-z]+|[^A-Za-z]", "characters": r"[\s\S]", "lines": r"[^\n]*\n|[^\n]+", "spaces": r"\s+|\S+"}


def expected(doc_id, text, units="words"):
    text = text or ""
    tokens = re.findall(SPLIT[units], text, re.ASCII)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]
    n = len(tokens)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def random_texts(count, alphabet, longest=60, seed=1):
    rng = random.Random(seed)
    return [(k, "".join(rng.choice(alphabet) for _ in range(rng.randrange(longest)))) for k in range(count)]


@pytest.mark.parametrize("units", sorted(SPLIT))
@pytest.mark.parametrize("block", [1, 3, 65_536])
def test_same_as_plain_python(spark, docs, units, block):
    """Whatever the blocks: units that go over several of them, and characters outside the first plane."""
    rows = random_texts(150, "abZ <>PSM\n\t0é\U0001f600\U00010400", seed=block)
    rows += [(900, "<"), (901, "<P"), (902, "a<P>b"), (903, "a" * 50), (904, "\U0001f600" * 9), (905, "\n"), (906, "a\r\nb\n")]
    found = infill.restored(infill.fill_in_middle(docs(rows), units, block=block))
    got = rows_of(found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output"))
    assert got == {k: expected(k, t, units) for k, t in rows}
    assert rows_of(found.select("doc_id", "restored")) == {k: (t,) for k, t in rows}


def test_edges(spark, docs):
    rows = [(1, None), (2, ""), (None, "one two"), (3, "same same"), (3, "same same"), (4, "word " * 300_000), (5, "x" * 700_000), (6, " a<M>")]
    got = infill.op11(docs(rows)).collect()
    want = sorted(((k, n, form, p, m, sha(out), sha(t or "")) for k, t in rows for n, form, p, m, out in [expected(k, t)]), key=repr)
    assert sorted((tuple(r) for r in got), key=repr) == want
    assert infill.op11(docs([])).count() == 0


def test_forms_follow_their_percentages(spark, docs):
    forms = [r.form for r in infill.fill_in_middle(docs([(k, "some words here") for k in range(3000)])).collect()]
    assert 0.08 < forms.count("plain") / 3000 < 0.12 and 0.15 < forms.count("spm") / (3000 - forms.count("plain")) < 0.25
    assert {r.form for r in infill.fill_in_middle(docs([(k, "a b") for k in range(50)]), plain=0, suffix_first=100).collect()} == {"spm"}


def test_plan_has_no_python_and_no_shuffle(spark, docs):
    plan = infill.op11(docs([(1, "a b")]))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and not re.search("Python|Arrow|Pandas", plan)
