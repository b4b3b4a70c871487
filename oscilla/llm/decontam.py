"""Benchmark decontamination with one Aho-Corasick automaton over the items' words.

Words are runs of characters other than ASCII non-alphanumerics, A-Z lowered. An
item's windows are its runs of ten consecutive words, or all its words if it has
fewer. Of every STRIDE consecutive places of an item one is the start of a kernel of
KERNEL words, so that each window holds a kernel. The automaton has the distinct kernels,
and the items of fewer than ten words, with a space on each side. A text is normalised
to words between single spaces and scanned once, so a match is always of whole words,
and overlapping matches are all seen. Around a kernel the few windows that may hold it
are looked up among the items' windows (sorted 64-bit hashes) and compared byte by byte.
Kernels take a tenth of the nodes that whole windows would take.

The automaton is in every task's memory, so its size is checked: items longer than
PIECE words are cut into pieces that share nine words, and pieces are dealt to shards of
at most SHARD_BYTES. One shard is the rule; its automaton is built once a worker process.
With more of them a task holds GROUP_BYTES of texts at a time and passes the shards over
them one after the other, so no text is written or read again. Beyond PASS_BYTES of
items, which is what goes to every worker, documents are scanned in several passes by way
of staged tables, marks and items being carried along.

Nulls: a null text has no words, a null item text no windows. Windows of an item
with null item_id mark words, but the item can't be named, so it isn't counted
in n_items. Repeated items with one item_id count once. Empty tables give no
hits. Extra columns are ignored by ``scan`` and kept by ``clean``.
"""

from __future__ import annotations

import hashlib
import re
from collections import OrderedDict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from .common import arrow_map, staged, table, texts, tune
from .hashing import mixed, prefixes, substrings

WINDOW = 10
KERNEL = 4
PIECE = 20_000
SHARD_BYTES = 2_000_000
PASS_BYTES = 64_000_000
GROUP_BYTES = 32_000_000
#: Of automatons that a worker process keeps.
CACHE_BYTES = 300_000_000

_LOWERED = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def normalised(text: str) -> bytes:
    """The words of a text with single spaces between."""
    return b" ".join(text.encode("utf-8", "surrogatepass").translate(_LOWERED).split())


class Index:
    """The automaton over pieces (item_id, words), and the windows that its kernels lead to."""

    def __init__(self, pieces: list[tuple[int | None, bytes]], width: int = WINDOW):
        self.width, kernel = width, min(KERNEL, width)
        self.stride = width - kernel + 1
        patterns: dict[bytes, int] = {}
        sizes: list[int] = []
        self.short: dict[int, set[int]] = {}  # items that are one pattern
        kernels: set[int] = set()

        def pattern(words: bytes, n: int) -> int:
            k = patterns.setdefault(words, len(patterns))
            if k == len(sizes):
                sizes.append(n)
            return k

        long: list[tuple[int | None, list[bytes]]] = []
        for item_id, words in pieces:
            parts = words.split()
            if len(parts) >= width:
                long.append((item_id, parts))
                for k in range(0, len(parts) - kernel + 1, self.stride):
                    kernels.add(pattern(b" ".join(parts[k : k + kernel]), kernel))
            elif parts:
                self.short.setdefault(pattern(words, len(parts)), set()).update(() if item_id is None else (item_id,))
        self.sizes = np.array(sizes, np.int64)
        self.kernel = np.zeros(len(sizes), bool)
        self.kernel[list(kernels)] = True
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for words, k in patterns.items():
            self.machine.add_word(f" {words.decode('latin-1')} ", k)
        patterns.clear()
        if sizes:
            self.machine.make_automaton()
        self._windows(long)
        self.size = int(1.25 * self.machine.get_stats()["total_size"]) + 3 * len(self.data) + 40 * len(self.hashes) if sizes else 0

    def _windows(self, long: list[tuple[int | None, list[bytes]]]) -> None:
        self.data = b" ".join(w for _, parts in long for w in parts)
        count = np.array([len(parts) for _, parts in long], np.int64)
        spaces = np.flatnonzero(np.frombuffer(self.data, np.uint8) == 32)
        begin, end = np.concatenate([[0], spaces + 1]), np.concatenate([spaces, [len(self.data)]])
        held = count - self.width + 1
        own = np.repeat(np.arange(len(long)), held)
        at = (np.cumsum(count) - count)[own] + np.arange(held.sum()) - (np.cumsum(held) - held)[own]
        first, last = begin[at], end[at + self.width - 1]
        found = mixed(substrings(prefixes(np.frombuffer(self.data, np.uint8)), first, last)) if len(at) else np.zeros(0, np.uint64)
        order = np.argsort(found, kind="stable")
        found = found[order]
        head = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]])) if len(at) else order
        self.hashes, self.first, self.last = found[head], first[order][head], last[order][head]
        self.from_, self.to = head, np.append(head[1:], len(found))
        ids = np.array([0 if i is None else i for i, _ in long], np.int64)
        named = np.array([i is not None for i, _ in long], bool)
        self.owner, self.named = ids[own[order]], named[own[order]]

    def find(self, words: bytes) -> tuple[list[tuple[int, int]], set[int]]:
        """Merged runs of hit words (from, to) of a normalised text, and the items found."""
        if not words or not len(self.sizes):
            return [], set()
        text = b" " + words + b" "
        hits = list(self.machine.iter(text.decode("latin-1")))
        if not hits:
            return [], set()
        data = np.frombuffer(text, np.uint8)
        spaces = np.flatnonzero(data == 32)
        ends, which = np.array(hits, np.int64).T
        first = np.searchsorted(spaces, ends) - self.sizes[which]
        runs, items = [], set()
        if self.short:
            for at, k in zip(first.tolist(), which.tolist(), strict=True):
                if k in self.short:
                    runs.append((at, at + int(self.sizes[k])))
                    items |= self.short[k]
        near = np.unique(first[self.kernel[which]])
        near = np.unique((near[:, None] - np.arange(self.stride)).ravel())
        near = near[(near >= 0) & (near + self.width < len(spaces))]
        if len(near):
            a, b = spaces[near] + 1, spaces[near + self.width]
            found = mixed(substrings(prefixes(data), a, b))
            place = np.minimum(np.searchsorted(self.hashes, found), len(self.hashes) - 1)
            for k in np.flatnonzero(self.hashes[place] == found).tolist():
                p = place[k]
                if text[a[k] : b[k]] == self.data[self.first[p] : self.last[p]]:
                    runs.append((int(near[k]), int(near[k]) + self.width))
                    rows = slice(self.from_[p], self.to[p])
                    items.update(self.owner[rows][self.named[rows]].tolist())
        return merged(runs), items


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def original_spans(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of hit words as (start, end) in code points of the original text."""
    if not runs:
        return []
    where = [m.span() for m in _WORD.finditer(re.sub("[A-Z]", lambda m: m[0].lower(), text))]
    return [(where[a][0], where[b - 1][1]) for a, b in runs]


def pieces(benchmark: DataFrame, width: int = WINDOW, piece: int = PIECE) -> DataFrame:
    """(item_id, words) of the distinct items, normalised; long ones in pieces that share width - 1 words."""

    def make():
        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for item_id, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                parts = normalised(text or "").split()
                cut = [b" ".join(parts[k : k + piece]) for k in range(0, max(1, len(parts) - width + 1), piece - width + 1)] if parts else []
                if cut:
                    yield pa.RecordBatch.from_arrays([pa.array([item_id] * len(cut), pa.int64()), pa.array(cut, pa.binary())], names=["item_id", "words"])

        return each

    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    return arrow_map(items, make, "item_id bigint, words binary").distinct()


def passes(items: DataFrame, shard: int, most: int) -> Iterator[list[list[tuple[int | None, bytes]]]]:
    """The pieces in passes of about most bytes, each as shards of at most shard bytes; a pass is collected by itself."""
    total = items.agg(F.coalesce(F.sum(F.octet_length("words")), F.lit(0))).first()[0]
    n = -(-total // most)
    for k in range(n):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "words"), F.lit(n)) == k).toArrow()
        out: list[list[tuple[int | None, bytes]]] = [[]]
        size = 0
        for row in zip(rows["item_id"].to_pylist(), rows["words"].to_pylist(), strict=True):
            if out[-1] and size + len(row[1]) > shard:
                out.append([])
                size = 0
            out[-1].append(row)
            size += len(row[1])
        yield out


def scan(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, shard: int = SHARD_BYTES, most: int = PASS_BYTES, keep: tuple[str, ...] = ("doc_id", "text")) -> DataFrame:
    """docs' columns in keep, n_words, runs (array of from, to: hit words), items (array of item ids)."""
    spark = docs.sparkSession
    tune(spark)
    kept = docs.select(*keep)
    numbers = ArrayType(LongType())
    schema = StructType([*kept.schema.fields, StructField("n_words", LongType()), StructField("runs", numbers), StructField("items", numbers)])
    state = kept.select("*", F.lit(0).cast("long").alias("n_words"), F.array().cast("array<bigint>").alias("runs"), F.array().cast("array<bigint>").alias("items"))
    blocks = passes(staged(pieces(benchmark, width), "decontam-items"), shard, most)
    block = next(blocks, [[]])
    while True:
        sent = spark.sparkContext.broadcast(block)
        state = state.mapInArrow(_scanner(sent, width, len(keep)), schema)
        block = next(blocks, None)
        if block is None:
            return state
        state = staged(state, "decontam")


_indexes: OrderedDict[tuple, Index] = OrderedDict()


def _index(sent, k: int, width: int) -> Index:
    """The index of shard k, kept by this process as long as CACHE_BYTES allow."""
    key = (sent._path if hasattr(sent, "_path") else None, getattr(sent, "_jbid", None), id(sent.value), k, width)
    found = _indexes.pop(key, None)
    if found is None:
        found = Index(sent.value[k], width)
        while _indexes and sum(x.size for x in _indexes.values()) + found.size > CACHE_BYTES:
            _indexes.popitem(last=False)
    _indexes[key] = found
    return found


def _scanner(sent, width: int, n_kept: int):
    def group(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = [[normalised(x) for x in texts(batch)] for batch in held]
        runs = [[list(zip(r[::2], r[1::2], strict=True)) for r in batch.column("runs").to_pylist()] for batch in held]
        items = [[set(x) for x in batch.column("items").to_pylist()] for batch in held]
        for k in range(len(sent.value)):
            index = _index(sent, k, width)
            for j in range(len(held)):
                for i, x in enumerate(words[j]):
                    new, ids = index.find(x)
                    if new:
                        runs[j][i] = merged(runs[j][i] + new)
                        items[j][i] |= ids
        for j, batch in enumerate(held):
            counts = pa.array([x.count(b" ") + 1 if x else 0 for x in words[j]], pa.int64())
            flat = pa.array([[x for pair in r for x in pair] for r in runs[j]], pa.list_(pa.int64()))
            owners = pa.array([sorted(x) for x in items[j]], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_kept], counts, flat, owners], names=[*batch.schema.names[:n_kept], "n_words", "runs", "items"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = GROUP_BYTES if len(sent.value) > 1 else 0
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= least:
                yield from group(held)
                held, size = [], 0
        if held:
            yield from group(held)

    return run


def located(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """doc_id, items, spans (start, end in code points of the original text) of the documents with hits."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            spans = []
            for text, runs in zip(texts(batch), batch.column("runs").to_pylist(), strict=True):
                found = original_spans(text, list(zip(runs[::2], runs[1::2], strict=True)))
                spans.append([{"start": a, "end": b} for a, b in found])
            made = pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("items"), made], names=["doc_id", "items", "spans"])

        return each

    hit = scan(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark, **settings).filter(F.size("runs") > 0)
    return arrow_map(hit.select("doc_id", "text", "runs", "items"), make, "doc_id bigint, items array<bigint>, spans array<struct<start: bigint, end: bigint>>")


def clean(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """The documents without any hit, with their own columns."""
    return scan(docs.select(F.struct("*").alias("row")), benchmark, keep=("row",), **settings).filter(F.size("runs") == 0).select("row.*")


def op9(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = scan(docs.select("doc_id", "text"), benchmark)
    hit = F.aggregate("runs", F.lit(0).cast("long"), lambda total, x: x - total)  # runs alternate from, to: to - (from - earlier)
    names = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        (F.size("runs") > 0).alias("contaminated"),
    )


def sha256_of_items(ids) -> str:
    return hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()


def query(spark, sf_dir: str) -> DataFrame:
    return op9(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)
), ks AS (
  SELECT DISTINCT k FROM bw
), p AS (
  SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k
), dw AS (
  SELECT rid, k, i, array_to_string(w[i:i + k - 1], ' ') AS win FROM p
), m AS (
  SELECT dw.rid, dw.k, dw.i, bw.item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.k = bw.k
), hit AS (
  SELECT rid, count(DISTINCT pos)::BIGINT AS n_hit FROM (SELECT DISTINCT rid, unnest(range(i, i + k)) AS pos FROM m) GROUP BY rid
), its AS (
  SELECT rid, count(*)::BIGINT AS n_items, string_agg(s, ',' ORDER BY s) AS names
  FROM (SELECT DISTINCT rid, item_id::VARCHAR AS s FROM m WHERE item_id IS NOT NULL) GROUP BY rid
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN its USING (rid)
"""
