import pytest
from conftest_llm import rows_of, sha

from oscilla.llm import secrets


def lex(text):
    return [text[a:b] for a, k, b in secrets.all_spans(text)[1] if k == 3]


def test_base_patterns(docs):
    token = "token = \"0123456789abcdef01234567\""
    rows = [
        (1, f"x {token} y"),
        (2, "AKIA" + "Z" * 16 + " AKIA" + "Z" * 15),
        (3, "PassWord:hunter2! secret=abc12"),
        (4, None),
        (5, ""),
        (6, "apikey: x token=abcdefgh api_key=1234567"),
        (7, "ſecret=abcdefgh toKen=abcdefgh"),  # look-alikes that fold to s and k
        (8, "é token='ab/cd+ef=' " + "f" * 23 + " " + "f" * 24),
    ]
    got = rows_of(secrets.scan(docs(rows)))
    assert {k: v[:3] for k, v in got.items()} == {1: (1, 0, 1), 2: (0, 1, 0), 3: (1, 0, 0), 4: (0, 0, 0), 5: (0, 0, 0), 6: (2, 0, 0), 7: (0, 0, 0), 8: (1, 0, 1)}
    assert got[1][3] == sha("assign:2:35,hex:11:35") and got[1][4] == "assign:2:35,hex:11:35"
    assert got[4][3] == got[5][3] == sha("") and got[4][4] == ""
    assert got[8][4].startswith("assign:2:18,hex:44:68")


def test_base_spans_stay_in_order(docs):
    text = "secret: " + "a" * 30
    base = secrets.base_spans(text)
    assert secrets.written(base) == "assign:0:38,hex:8:38"
    got = rows_of(secrets.scan(docs([(1, text)])))[1]
    assert got[3] == sha(secrets.written(base)) and got[4] == secrets.written(base)


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("private_key = 'Zk8#pQ2!vX9'", ["Zk8#pQ2!vX9"]),
        ("dbPwd := \"p0ssW!rd-77\";", ["p0ssW!rd-77"]),
        ("half = \"Zx81kQ\"\nrest = 'pp93Lm'\nauthToken = half + rest\n", ["Zx81kQ", "pp93Lm"]),
        ("export CLIENT_CREDENTIAL=Qm9vbT8x\n", ["Qm9vbT8x"]),
        ("{\"encryptionKey\": \"a9!Kd02mvQ\"}", ["a9!Kd02mvQ"]),
        ("private_key = \"${PRIVATE_KEY}\"", []),
        ("private_key = \"changeme\"", []),
        ("private_key_path = \"/etc/keys/one.pem\"", []),
        ("color = \"Zk8pQ2vX9\"", []),
        ("the key: it was there all along in the house", []),
        ("if private_key == \"Zk8pQ2vX9q\":", []),
        ("see http://example.com/a?b for more", []),
        ("private_key = unknown + 'Zk8pQ2vX9'", []),
    ],
)
def test_lexer(text, found):
    assert lex(text) == found


def test_redaction_keeps_clean_documents(docs):
    df = docs([(1, "a token=abcdefgh b"), (2, "clean text"), (3, None), (4, "pwd = \"s3cr!t-99x\"")])
    got = {r.doc_id: r for r in secrets.redact(df).collect()}
    assert secrets.redact(df).columns == df.columns
    assert got[1].text == "a [REDACTED] b" and got[1].n_chars == len(got[1].text)
    assert got[2].text == "clean text" and got[3].text is None and got[4].text == 'pwd = "[REDACTED]"'
    assert secrets.redact(df.filter("false")).count() == 0


def test_long_lines_are_read_in_linear_time():
    import time

    began = time.monotonic()
    secrets.all_spans("a=b " * 300_000 + "'=\"" * 100_000)
    assert time.monotonic() - began < 30


@pytest.mark.parametrize("sized", [1, 65, 200, 3000])
def test_names_indents_and_literals_of_any_length(sized):
    name = "x" * sized + "_private_key"
    value = "Zk8pQ2vX9q/+"
    assert lex(f"{name} = '{value}'") == [value]
    assert lex(f"a\n{' ' * sized}private_key: {value}\n") == [value]
    assert lex(f"{name}{' ' * sized}=\t{' ' * sized}'{value * sized}'") == [value * sized]
    assert lex("private_key = [" + ", ".join(f"'{value}{k}'" for k in range(sized)) + "]") == [f"{value}{k}" for k in range(sized)]
    first, last = f"first = '{value}'\n", "private_key = first + filler\n"
    assert lex(first + f"filler = '{'a' * 5000 * sized}'\n" + last)[0] == value


@pytest.mark.parametrize(
    "text",
    [
        "a=b " * 200_000, "a: " * 200_000, "'\"`" * 200_000, "x" * 500_000 + " = " * 10, "=\"\"\"" * 100_000, "a='\\" * 100_000, "a=[" * 100_000, "a=(" * 100_000 + ")" * 100_000,
        " " * 300_000 + "a=b " * 50_000, "a:b[" * 100_000, "a: |\n" * 50_000, "x='a'\n" + "x=x+x\n" * 20_000, "x='a' 'b' " * 50_000, "a." * 200_000 + "=1", "a=#\n" * 50_000, "a=[#\n" * 50_000, "a.b=['c','d']\n" * 30_000,
        '"a ' * 200_000, "a " * 200_000 + "=", "a=`" * 100_001, "k=[" + "'a'," * 100_000,
    ],
)
def test_lexer_is_linear(text):
    import time

    began = time.monotonic()
    secrets.all_spans(text)
    assert time.monotonic() - began < 15


@pytest.mark.parametrize("text", ["# x=[\n" * 200_000, "// a=(\n" * 200_000, "x=[ # a\n" * 100_000, "x=f(\n" * 100_000, "a=['b'\n+ # c\n" * 50_000])
def test_lists_in_comments_are_read_in_linear_time(text):
    import time

    began = time.monotonic()
    secrets.all_spans(text)
    assert time.monotonic() - began < 30


@pytest.mark.parametrize("value", ["Zx81,kQp09aa", "Zx81kQp09aa;x", 'Zx81kQp"09aaZZ', "Zx81'kQ`p09aaZZ#4", "Zx81{kQp}09(aa)Z"])
@pytest.mark.parametrize("end", ["", "\n", " # note", ",", ";\n"])
def test_bare_values_reach_to_the_end_of_their_line(value, end):
    assert lex(f"private_key={value}{end}") == [value] and lex(f"signing_key: {value}{end}") == [value]


def test_literals_in_calls():
    value = "Zk8pQ2vX9q/+"
    assert lex(f'encryption_key = base64.b64decode("{value}")') == [value]
    assert lex(f"private_key = os.environ.get('X', '{value}')") == [value]
    assert lex(f'signing_key = load("a b", [\n  "{value}",\n], 3)') == [value]
    assert lex("private_key = load(name, other)") == [] and lex('private_key = conf["name"]') == []
    assert lex(f"private_key = load(name)\nsigning_key: {value}") == [value]


def brute_base(text):
    """The base spans by the contract's words, character by character."""
    out = []
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    value = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")

    def run(at, allowed):
        while at < len(text) and text[at] in allowed:
            at += 1
        return at

    def assign(at):
        for word in ("password", "passwd", "secret", "token", "api_key", "apikey"):
            if lower.startswith(word, at):
                k = at + len(word)
                for quote in (1, 0):
                    if quote and text[k : k + 1] not in ('"', "'"):
                        continue
                    i = run(k + quote, " ")
                    if text[i : i + 1] in (":", "="):
                        i = run(i + 1, " ")
                        j = i + 1 if text[i : i + 1] in ('"', "'") and text[i : i + 1] else i
                        end = run(j, value)
                        if end > j:
                            return j, end
        return None

    at = 0
    while at < len(text):
        found = assign(at)
        if found:
            if found[1] - found[0] >= 6:
                out.append((at, 0, found[1]))
            at = found[1]
        else:
            at += 1
    upper = set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
    at = 0
    while at < len(text):
        end = run(at + 4, upper) if text.startswith("AKIA", at) else at
        if end > at + 4:
            if end - at >= 20:
                out.append((at, 1, end))
            at = end
        else:
            at += 1
    at = 0
    while at < len(text):
        end = run(at, set("0123456789abcdef"))
        if end - at >= 24:
            out.append((at, 2, end))
        at = max(at + 1, end)
    return sorted(out)


def test_base_spans_of_random_texts_are_those_of_brute_force():
    import random

    rng = random.Random(7)
    pieces = ["password", "PassWd", "secret", "TOKEN", "api_key", "apikey", "api", "AKIA", "A", "0123456789ab", "deadbeef", "=", ":", " ", "  ", '"', "'", "\t", "x", "Z9", "_", "é", "\n", "AKIAAKIA", "0" * 24]
    hits = 0
    for _ in range(6000):
        text = "".join(rng.choices(pieces, k=rng.randint(0, 25)))
        want = brute_base(text)
        assert secrets.base_spans(text) == want, text
        hits += bool(want)
    assert hits > 1500


def test_base_columns_agree_with_sql(spark):
    """Counts of the base patterns over all documents, by DuckDB."""
    import duckdb

    sf = "/root/testdata/sf0.1"
    kinds = (r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]+", "AKIA[A-Z0-9]+", "[0-9a-f]+")
    lists = [f"regexp_extract_all(coalesce(text, ''), $r${k}$r$)" for k in kinds]
    tail = r"regexp_extract(x, $r$[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)$$r$, 1)"
    counted = [f"len(list_filter({lists[0]}, lambda x: len({tail}) >= 6))", f"len(list_filter({lists[1]}, lambda x: len(x) >= 20))", f"len(list_filter({lists[2]}, lambda x: len(x) >= 24))"]
    want = {r[0]: r[1:] for r in duckdb.sql(f"SELECT doc_id, {', '.join(counted)} FROM '{sf}/documents.parquet'").fetchall()}
    got = {r[0]: tuple(r)[1:4] for r in secrets.query(spark, sf).collect()}
    assert got == want and sum(map(sum, want.values())) > 0


def test_long_text():
    text = "word " * 200_000 + "token=abcdefgh" + " = " * 1000
    assert len(secrets.base_spans(text)) == 1 and secrets.all_spans(text)[1]


@pytest.mark.parametrize("size", [512, 513, 5000])
@pytest.mark.parametrize("line", ["AUTH={}", "export PRIVATE_KEY={}  # rotated", "client-credential: {}\r"])
def test_bare_values_of_any_length(docs, line, size):
    value = ("Zk8pQ2vX9q/+" * size)[:size]
    text = f"a = 1\n{line.format(value)}\nnext line"
    assert lex(text) == [value]
    assert secrets.redact(docs([(1, text)])).first().text == f"a = 1\n{line.format('[REDACTED]')}\nnext line"


def test_long_bare_values_are_read_in_linear_time():
    import time

    began = time.monotonic()
    secrets.all_spans("auth=" + "key=k9:" * 100_000 + ",\n" + "auth=" * 100_000 + "x")
    assert time.monotonic() - began < 30


def test_all_literals_of_a_value_are_found(docs):
    pieces = [f"Zk8{k:05d}" for k in range(200)]
    source = "private_key = " + "\n  + ".join(f"'{x}'" for x in pieces) + "\n"
    assert lex(source) == pieces
    by_names = "".join(f"p{k} = '{x}'\n" for k, x in enumerate(pieces)) + "private_key = " + " + ".join(f"p{k}" for k in range(200)) + "\n"
    assert lex(by_names) == pieces
    chained = f"p0 = '{pieces[0]}'\n" + "".join(f"p{k} = p{k - 1} + '{x}'\n" for k, x in enumerate(pieces) if k) + "auth_token = p199\n"
    assert lex(chained) == pieces
    left = secrets.redact(docs([(k, x) for k, x in enumerate((source, by_names, chained))])).collect()
    assert not any(x in r.text for r in left for x in pieces)


def test_shared_parts_are_read_in_linear_time():
    import time

    began = time.monotonic()
    text = "k = 'Zk8pQ2vX9q'\n" + "k = k + k\n" * 2_000 + "".join(f"k = k + 'a{j:05d}'\n" for j in range(2_000)) + "private_key = k\n"
    assert len(lex(text)) == 2_001
    assert time.monotonic() - began < 30
