"""Secret scans: fixed patterns and an assignment-aware lexer.

The base patterns are matched leftmost and without overlaps, each kind by itself;
matches that are too short are dropped afterwards, so what they cover stays used.

The lexer (``lexer``) reads names and the literals that make up their values, so that
literals reach a sensitive name through other names (``half = "..."``,
``token = half + rest``). A pair scores sensitivity of the target's name times
plausibility of the value; from SCORE on, the literals' contents are secrets of kind
``lex``, unless a base span covers them.

Nulls: a null text is empty and has no spans. Repeated rows are scanned each.
Extra columns are kept by ``redact`` and ignored by ``scan``.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from .common import arrow_map, table, text_column, texts, tune
from .lexer import ENOUGH_BITS, Value, assignments, literals

KINDS = ("assign", "access", "hex", "lex")
SCORE = 0.5
REDACTED = "[REDACTED]"

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile("AKIA[A-Z0-9]+")
_HEX = re.compile("[0-9a-f]{24,}")

#: How far each word of a name points to a secret.
SENSITIVE = {
    "password": 0.95, "passwd": 0.95, "pwd": 0.9, "pass": 0.7, "passphrase": 0.95, "secret": 0.95, "token": 0.9,
    "apikey": 0.95, "key": 0.6, "credential": 0.9, "credentials": 0.9, "auth": 0.6, "authorization": 0.7, "bearer": 0.8,
    "private": 0.5, "access": 0.4, "api": 0.3, "client": 0.1, "signing": 0.5, "encryption": 0.5, "session": 0.4,
    "cookie": 0.4, "salt": 0.5, "pin": 0.3, "dsn": 0.5, "webhook": 0.4, "license": 0.2,
}
#: Words that say the value is about a secret rather than one.
HARMLESS = {"count", "counts", "length", "size", "name", "type", "id", "file", "path", "url", "uri", "field", "column", "label", "expiry", "limit", "max", "min", "primary", "foreign", "sort", "public"}
_PLACEHOLDER = re.compile(r"(?is)^(?:x+|\*+|\.+|<.*>|\$\{.*\}|\$\(.*\)|%.*%|\{\{.*\}\}|change.?me.*|your.*|example.*|dummy.*|placeholder.*|none|null|true|false|todo|test|redacted|\[redacted\])$")

_DIGIT, _LETTER = re.compile("[0-9]"), re.compile("[A-Za-z]")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, in order."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def name_score(name: str) -> float:
    words = [w.lower() for w in _WORDS.findall(name)]
    pairs = {a + b for a, b in zip(words, words[1:], strict=False)}
    if words and words[-1] in HARMLESS:
        return 0.0
    rest = 1.0
    for word in {*words, *(pairs & SENSITIVE.keys())}:
        rest *= 1 - SENSITIVE.get(word, 0.0)
    return 1 - rest


def value_score(value: Value) -> float:
    """Plausibility of a literal: its entropy against 18 bits; placeholders, short values and prose have none."""
    if value.length < 6 or value.spaces > 3 or _PLACEHOLDER.match(value.ends()):
        return 0.0
    return min(1.0, value.bits() / ENOUGH_BITS)


def lexed_spans(text: str) -> list[tuple[int, int, int]]:
    if ":" not in text and "=" not in text:
        return []
    secret = []
    for name, value, parts, bare in assignments(text):
        sensitive = name_score(name)
        if not sensitive or sensitive * value_score(value) < SCORE:
            continue
        if bare:
            span = slice(*parts.spans[0])
            if not (_DIGIT.search(text, span.start, span.stop) and _LETTER.search(text, span.start, span.stop)):
                continue
        secret.append(parts)
    return sorted((a, 3, b) for a, b in literals(secret) if b - a >= 4)


def uncovered(spans: list[tuple[int, int, int]], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The spans that no single one of base covers; both in order."""
    out, k, reach = [], 0, -1
    for x in spans:
        while k < len(base) and base[k][0] <= x[0]:
            reach = max(reach, base[k][2])
            k += 1
        if reach < x[2]:
            out.append(x)
    return out


def all_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and base and lexed spans together."""
    base = base_spans(text)
    return base, sorted(base + uncovered(lexed_spans(text), base))


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    out, at = [], 0
    for a, _, b in spans:
        if b > at:
            out += [text[at:a], REDACTED] if a >= at else []
            at = b
    return "".join([*out, text[at:]])


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every document."""
    tune(docs.sparkSession)

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts, digests, spans = ([], [], []), [], []
            for text in texts(batch):
                base, both = all_spans(text)
                for k in range(3):
                    counts[k].append(sum(x[1] == k for x in base))
                digests.append(hashlib.sha256(written(base).encode()).hexdigest())
                spans.append(written(both))
            arrays = [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())]
            return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

        return each

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")


def redact(docs: DataFrame) -> DataFrame:
    """docs with every secret in text replaced by REDACTED, and n_chars, where there is one, as the new text has."""
    tune(docs.sparkSession)
    fields = docs.schema
    rows = docs.select(F.struct("*").alias("row"))

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            out, changed = [], []
            for text in text_column(batch).to_pylist():
                spans = all_spans(text)[1] if text else []
                changed.append(bool(spans))
                out.append(redacted(text, spans) if spans else None)
            return pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, pa.string()), pa.array(changed)], names=["row", "text", "changed"])

        return each

    schema = StructType([*rows.schema.fields, StructField("text", StringType()), StructField("changed", BooleanType())])
    done = arrow_map(rows, make, schema)
    columns = []
    for f in fields:
        own = F.col("row").getField(f.name)
        if f.name == "text":
            own = F.when(F.col("changed"), F.col("text")).otherwise(own)
        elif f.name == "n_chars":
            own = F.when(F.col("changed"), F.length("text").cast(f.dataType)).otherwise(own)
        columns.append(own.alias(f.name))
    return done.select(*columns)


def query(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
