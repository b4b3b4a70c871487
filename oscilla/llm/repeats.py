"""Removal of repeated byte strings, by parsing into phrases at rolling-hash triggers.

Every string of ``size`` bytes that starts at two or more places of the corpus is
found. As in prefix-free parsing, triggers of a rolling hash cut the texts in the
same way wherever the same bytes stand: the trigger of a window of ``size`` bytes is
the leftmost least hash of the 12-byte strings in its first REACH places. Windows
with one trigger follow each other; they and the phrase they cover are an anchor.

A window's trigger is told by its bytes alone, so windows can only be equal at the same
distance d from their triggers, and a phrase holds all bytes of its windows. Therefore
two suffixes of the corpus that begin in a phrase need never be followed into the next
one to a depth of ``size``: the parse only says how often a phrase occurs, and the order
of all suffixes comes from the dictionary of distinct phrases.
1. An anchor's core, the bytes after the trigger that all its windows share, must
   occur elsewhere, or none of its windows does. Cores are counted in one aggregate.
2. For anchors whose core occurs again, the whole phrase is compared: if it occurs
   again too, all windows of the anchor are repeated.
3. What is left are the ends of repeated passages. For the dictionary of these cores'
   phrases, once each, two suffix arrays are made: of what follows the triggers, and of
   what comes before them, read backwards. With the common prefixes of neighbours they
   give each phrase's class to any depth on either side, and windows at d are equal if
   both the classes to depth d before and to depth size - d after the trigger are. A
   core's phrases are in one task, or, if it has more than HOT of them, its windows are
   compared by an aggregate, so that no passage however common comes to one task.
Cores and phrases are told apart by 64 bits each, that is phrases by 128; windows by
their bytes, and those of cores with more than HOT phrases by 128 bits.

Texts that occur more than once as a whole are counted once, with a weight of two,
and removed as a whole. Texts are read again only where passages end in them or
bytes go.

Nulls: a null text is empty; texts shorter than ``size`` keep all. Repeated rows are
copies of each other. doc_id is only carried along. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, Staged, arrow_map, scratch, small, staged, table, texts, tune
from .hashing import mixed, prefixes, substrings
from .minhash import blocks

SIZE = 200
TRIGGER = 12
REACH = 150
HOT = 20_000
#: Hashes of texts that may be broadcast to filter the texts before they are shuffled: one column of numbers.
FILTER_ROWS = 2_000_000
#: List entries of a broadcast side, about 50 bytes each.
BROADCAST_ENTRIES = 50_000

_LOW = np.uint64(0xFFFFFFFF)


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each width consecutive values, by minima from both ends of blocks."""
    n = len(x) - width + 1
    whole = np.full(-(-len(x) // width) * width, 2**64 - 1, np.uint64)
    whole[: len(x)] = x
    grid = whole.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchors(raw: list[bytes], size: int = SIZE, reach: int = REACH) -> Iterator[tuple[np.ndarray, ...]]:
    """For each text: cores, phrases (hashes), first and last window of its anchors, 2 for runs of equal ones, and shapes.

    Where a text has a period, each anchor is like the one before; a run of them is given out as one.
    A shape is the trigger's distance from the first window and that of a single anchor's last window: a << 12 | b.
    """
    nothing = np.zeros(0, np.int64)
    for first, last in blocks(raw):
        part = raw[first:last]
        data = np.frombuffer(b"".join(part), np.uint8)
        if len(data) < size:
            yield from ((nothing,) * 6 for _ in part)
            continue
        sums = prefixes(data)
        at = np.arange(len(data) - TRIGGER + 1)
        values = mixed(substrings(sums, at, at + TRIGGER))
        least = sliding_least((values & ~_LOW) | at.astype(np.uint64), reach)
        trigger = (least & _LOW).astype(np.int64)
        bounds = np.cumsum([0, *map(len, part)])
        # windows of each text, all in one array of starts
        count = np.maximum(np.diff(bounds) - size + 1, 0)
        starts = np.repeat(bounds[:-1], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        own = trigger[starts]
        new = np.ones(len(starts), bool)
        new[1:] = (own[1:] != own[:-1]) | (starts[1:] != starts[:-1] + 1)
        heads = np.flatnonzero(new)
        tails = np.append(heads[1:], len(starts)) - 1
        lo, hi, a = starts[heads], starts[tails], own[heads]
        core = mixed(substrings(sums, a, a + size - reach + 1)).view(np.int64)
        shape = ((a - lo) * 1_000_003 + (hi - lo)).astype(np.uint64)
        phrase = mixed(mixed(substrings(sums, lo, hi + size)) + shape).view(np.int64)
        form = (a - lo) << 12 | (hi - lo)
        cut = np.searchsorted(lo, bounds)
        for k, (x, y) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
            c, p = core[x:y], phrase[x:y]
            fresh = np.ones(y - x, bool)
            fresh[1:] = (c[1:] != c[:-1]) | (p[1:] != p[:-1])
            begin = np.flatnonzero(fresh)
            end = np.append(begin[1:], y - x) - 1 if y > x else begin
            yield c[begin], p[begin], lo[x:y][begin] - bounds[k], hi[x:y][end] - bounds[k], 1 + (end > begin), form[x:y][begin]


def parsed(docs: DataFrame, size: int) -> DataFrame:
    """key, doc_id, h1, h2 (of the text), n_bytes, sha256 and the anchors of every row."""
    rows = docs.select(
        F.monotonically_increasing_id().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), *text_hashes(), "text"
    )

    def make():
        def lists(parts, kind):
            at = np.cumsum([0, *map(len, parts)]).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([np.zeros(0, np.int64), *parts]).astype(kind)))

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            raw = [t.encode("utf-8", "surrogatepass") for t in texts(batch)]
            found = list(zip(*anchors(raw, size), strict=True)) or [()] * 6
            made = [pa.array(list(map(len, raw)), pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in raw]), lists(found[0], np.int64), lists(found[1], np.int64), *(lists(found[k], np.int32) for k in (2, 3, 4, 5))]
            return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "doc_id", "h1", "h2")), *made], names=["key", "doc_id", "h1", "h2", "n_bytes", "sha256", "core", "phrase", "lo", "hi", "times", "shape"])

        return each

    return arrow_map(rows, make, "key bigint, doc_id bigint, h1 bigint, h2 bigint, n_bytes bigint, sha256 string, core array<bigint>, phrase array<bigint>, lo array<int>, hi array<int>, times array<int>, shape array<int>")


def text_hashes():
    text = F.coalesce("text", F.lit(""))
    return F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(11), text).alias("h2")


def texts_of(docs: DataFrame, wanted: DataFrame, lists: str) -> DataFrame:
    """wanted's columns (h1, h2, own, the doc_id, and an array lists among them) with the text.

    A text's copies have other numbers and stay out of the join. Texts that aren't
    wanted are filtered out before any shuffle if the wanted are at most FILTER_ROWS.
    """
    rows = docs.select(*text_hashes(), F.col("doc_id").cast("long").alias("own_"), F.coalesce("text", F.lit("")).alias("text"))
    n, entries = wanted.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size(lists)), F.lit(0))).first()
    if n <= BROADCAST_ROWS and entries <= BROADCAST_ENTRIES:
        wanted = F.broadcast(wanted)
    elif n <= FILTER_ROWS:
        rows = rows.join(F.broadcast(wanted.select("h1")), "h1", "left_semi")
    return rows.withColumnsRenamed({"h1": "h1_", "h2": "h2_"}).join(wanted, (F.col("h1") == F.col("h1_")) & (F.col("h2") == F.col("h2_")) & F.col("own").eqNullSafe(F.col("own_"))).drop("h1_", "h2_", "own_")


def phrase_bytes(rows: DataFrame, size: int) -> DataFrame:
    """(core, phrase, c, m, key, lo, at, data) for the phrases listed in rows (text, key, phrases); at: the trigger in data.

    Rows that repeat a doc_id with its text bring a key several times; a task takes it once.
    """

    def make():
        seen: set[int] = set()

        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            out: list[tuple] = []
            held = 0
            for text, key, wanted in zip(batch.column("text").to_pylist(), batch.column("key").to_pylist(), batch.column("phrases").to_pylist(), strict=True):
                if key in seen:
                    continue
                seen.add(key)
                raw = text.encode("utf-8", "surrogatepass")
                for w in wanted:
                    at, last = divmod(w["shape"], 1 << 12)
                    data = raw[w["lo"] : w["lo"] + last + size]
                    out.append((w["core"], w["phrase"], w["c"], w["m"], key, w["lo"], at, data))
                    held += len(data)
                if held > 4_000_000:
                    yield packed(out)
                    out, held = [], 0
            if out:
                yield packed(out)

        def packed(rows_):
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows_, strict=True), kinds, strict=True)], names=["core", "phrase", "c", "m", "key", "lo", "at", "data"])

        return each

    return arrow_map(rows.select("text", "key", "phrases"), make, "core bigint, phrase bigint, c bigint, m bigint, key bigint, lo int, at int, data binary")


class SuffixOrder:
    """Strings in byte order and the common prefix of each with the one before it, from which classes to any depth come."""

    def __init__(self, strings: list[bytes], depth: int):
        self.order = np.array(sorted(range(len(strings)), key=strings.__getitem__), np.int64)
        length = np.array([min(len(x), depth) for x in strings], np.int64)[self.order]
        grid = np.frombuffer(b"".join(strings[k][:depth].ljust(depth, b"\0") for k in self.order.tolist()), np.uint8).reshape(-1, depth)
        self.common = np.zeros(len(strings), np.int64)
        for k in range(1, len(strings), 4096):
            differ = grid[k : k + 4096] != grid[k - 1 : min(k + 4095, len(strings) - 1)]
            same = np.where(differ.any(1), differ.argmax(1), depth)
            self.common[k : k + 4096] = np.minimum(same, np.minimum(length[k : k + 4096], length[k - 1 : min(k + 4095, len(strings) - 1)]))

    def classes(self, depth: int) -> np.ndarray:
        """For each string its class: strings of one class have the first depth bytes in common."""
        out = np.empty(len(self.order), np.int64)
        new = self.common < depth
        out[self.order] = np.cumsum(new)
        return out


def repeated_windows(data: list[bytes], at: np.ndarray, weight: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the phrases data (trigger at), the windows that occur again: (phrase, start in it), of phrases of weight 1."""
    last = np.array(list(map(len, data)), np.int64) - size
    after = SuffixOrder([x[k:] for x, k in zip(data, at.tolist(), strict=True)], size)
    before = SuffixOrder([x[:k][::-1] for x, k in zip(data, at.tolist(), strict=True)], max(1, int(at.max(initial=0))))
    which, starts = [], []
    for d in range(int((at - last).min(initial=0)), int(at.max(initial=-1)) + 1):
        rows = np.flatnonzero((at - last <= d) & (d <= at))
        if len(rows) < 2:
            continue
        pair = before.classes(d)[rows] * (len(data) + 1) + after.classes(size - d)[rows]
        order = np.argsort(pair, kind="stable")
        group = np.empty(len(rows), np.int64)
        group[order] = np.cumsum(np.concatenate([[False], pair[order][1:] != pair[order][:-1]]))
        again = rows[(np.bincount(group, weight[rows])[group] >= 2) & (weight[rows] == 1)]
        which.append(again)
        starts.append(at[again] - d)
    nothing = np.zeros(0, np.int64)
    return np.concatenate([nothing, *which]), np.concatenate([nothing, *starts])


def runs_of(which: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which, first, last) of runs of consecutive starts."""
    order = np.lexsort((starts, which))
    which, starts = which[order], starts[order]
    new = np.ones(len(which), bool)
    new[1:] = (np.diff(starts) != 1) | (np.diff(which) != 0)
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(which)) - 1 if len(which) else heads
    return which[heads], starts[heads], starts[tails]


def window_hashes(core: np.ndarray, data: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of phrases, each with its core, and which phrase they are of."""
    joined = np.frombuffer(b"".join(data), np.uint8)
    length = np.array(list(map(len, data)), np.int64)
    begin = np.cumsum(length) - length
    count = length - size + 1
    which = np.repeat(np.arange(len(data)), count)
    starts = begin[which] + np.arange(count.sum()) - (np.cumsum(count) - count)[which]
    return mixed(substrings(prefixes(joined), starts, starts + size) ^ mixed(core.view(np.uint64))[which]), which


def ends_of_passages(phrases: DataFrame, size: int) -> DataFrame:
    """(key, start, end): runs of repeated windows in phrases that are there once; a core's phrases are in one task."""

    def matched(rows: pa.Table) -> pa.RecordBatch:
        core, phrase = rows["core"].to_numpy(), rows["phrase"].to_numpy()
        once = np.ones(len(core), bool)
        once[1:] = (core[1:] != core[:-1]) | (phrase[1:] != phrase[:-1])
        rows = rows.filter(pa.array(once))
        weight = np.minimum(rows["c"].to_numpy(), 2)
        which, first, last = runs_of(*repeated_windows(rows["data"].to_pylist(), rows["at"].to_numpy().astype(np.int64), weight, size))
        lo, key = rows["lo"].to_numpy()[which], rows["key"].to_numpy()[which]
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array((lo + first).astype(np.int64)), pa.array((lo + last + size).astype(np.int64))], names=["key", "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            core = batch.column("core")
            if not batch.num_rows or core[0] == core[-1]:
                continue
            rows = pa.Table.from_batches(held)
            cores = rows["core"].to_numpy()
            done = int(np.searchsorted(cores, cores[-1]))
            yield matched(rows.slice(0, done))
            held = rows.slice(done).to_batches()
        if held and (rows := pa.Table.from_batches(held)).num_rows:
            yield matched(rows)

    ordered = phrases.select("core", "phrase", "c", "key", "lo", "at", "data").repartition("core").sortWithinPartitions("core", "phrase")
    return ordered.mapInArrow(run, "key bigint, start bigint, end bigint")


def hot_ends(phrases: DataFrame, size: int) -> DataFrame:
    """The same for cores with very many phrases, by an aggregate over windows; a phrase's windows then are runs again."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            core = batch.column("core").to_numpy()
            hashes, which = window_hashes(core, batch.column("data").to_pylist(), size)
            inside = np.arange(len(which)) - np.searchsorted(which, np.arange(len(core)))[which]
            pick = lambda c: batch.column(c).to_numpy()[which]
            return pa.RecordBatch.from_arrays([pa.array(core[which]), pa.array(hashes.view(np.int64)), pa.array(pick("c")), pa.array(pick("key")), pa.array(pick("lo")), pa.array(pick("lo") + inside, pa.int64())], names=["core", "window", "c", "key", "lo", "start"])

        return each

    def joined():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            starts = batch.column("starts")
            which = np.repeat(np.arange(batch.num_rows), starts.value_lengths().to_numpy(zero_copy_only=False))
            which, first, last = runs_of(which, starts.flatten().to_numpy(zero_copy_only=False))
            key = batch.column("key").to_numpy(zero_copy_only=False)[which]
            return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(first, pa.int64()), pa.array(last + size, pa.int64())], names=["key", "start", "end"])

        return each

    once = phrases.dropDuplicates(["core", "phrase"])
    windows = arrow_map(once, make, "core bigint, window bigint, c bigint, key bigint, lo int, start bigint")
    again = staged(windows.groupBy("core", "window").agg(F.sum("c").alias("total")).filter("total > 1").select("core", "window"), "repeats-windows")
    found = windows.filter("c = 1").join(again, ["core", "window"]).groupBy("key", "lo").agg(F.collect_list("start").alias("starts"))  # at most REACH a phrase
    return arrow_map(found.select("key", "starts"), joined, "key bigint, start bigint, end bigint")


def removed_spans(docs: DataFrame, rows: DataFrame, copies: DataFrame, size: int) -> DataFrame:
    """(key, spans) of the texts that occur once as a whole and have repeated strings; spans may overlap."""
    kept = rows.join(small(copies), ["h1", "h2"], "left").filter(F.col("head").isNull() | (F.col("key") == F.col("head")))
    weight = F.when(F.col("head").isNull(), 1).otherwise(2).cast("long")
    each = kept.select("key", weight.alias("w"), F.explode(F.arrays_zip("core", "phrase", "lo", "hi", "times", "shape")).alias("x"))
    each = each.select("key", "w", "x.core", "x.phrase", "x.lo", "x.hi", "x.shape", F.greatest("w", "x.times").alias("c"))
    # written, so that the join has an exchange on either side and a common core's rows can be split
    cores = Staged(each.groupBy("core").agg(F.sum("c").alias("n")).filter("n > 1").select("core"), "repeats-cores")
    candidates = staged(each.join(cores.df, "core"), "repeats-candidates")
    cores.drop()
    phrases = candidates.groupBy("core", "phrase").agg(F.sum("c").alias("c"), F.min(F.struct("key", "lo", "shape")).alias("at"))
    phrases = staged(phrases.select("core", "phrase", "c", "at.*"), "repeats-phrases")
    open_ = Staged(phrases.groupBy("core").agg(F.count(F.lit(1)).alias("m"), F.min("c").alias("least")).filter("least = 1 and m > 1").select("core", "m"), "repeats-open")
    wanted = phrases.join(open_.df, "core").groupBy("key").agg(F.collect_list(F.struct("core", "phrase", "lo", "shape", "c", "m")).alias("phrases"))
    wanted = Staged(wanted.join(rows.select("key", "h1", "h2", F.col("doc_id").alias("own")), "key"), "repeats-wanted")
    open_.drop()
    data = staged(phrase_bytes(texts_of(docs, wanted.df, "phrases"), size), "repeats-data")
    wanted.drop()
    whole = candidates.filter("w = 1").drop("c").join(phrases.filter("c > 1").select("core", "phrase"), ["core", "phrase"])
    spans = whole.select("key", F.col("lo").cast("long").alias("start"), (F.col("hi") + size).cast("long").alias("end"))
    spans = spans.union(ends_of_passages(data.filter(F.col("m") <= HOT), size))
    hot = data.filter(F.col("m") > HOT)
    if not hot.isEmpty():
        spans = spans.union(hot_ends(hot, size))
    return spans.groupBy("key").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def cut(rows: DataFrame) -> DataFrame:
    """key, n_removed, n_spans, kept_sha256 of rows (key, spans, text)."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            removed, runs, digests = [], [], []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                raw, at, n, k, digest = text.encode("utf-8", "surrogatepass"), 0, 0, 0, hashlib.sha256()
                begin = end = -1
                for s in [*sorted((x["start"], x["end"]) for x in spans), (len(raw) + 1, len(raw) + 1)]:
                    if s[0] <= end:
                        end = max(end, s[1])
                        continue
                    if end >= 0:
                        digest.update(raw[at:begin])
                        at, n, k = end, n + end - begin, k + 1
                    begin, end = s
                digest.update(raw[at:])
                removed.append(n)
                runs.append(k)
                digests.append(digest.hexdigest())
            return pa.RecordBatch.from_arrays([batch.column("key"), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digests, pa.string())], names=["key", "n_removed", "n_spans", "kept"])

        return each

    return arrow_map(rows.select("key", "spans", "text"), make, "key bigint, n_removed bigint, n_spans bigint, kept string")


def found_repeats(docs: DataFrame, size: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """parsed rows, the texts that occur more than once as a whole, and the spans of the others; what led to them is removed."""
    tune(docs.sparkSession)
    with scratch(docs.sparkSession) as kept:
        rows = Staged(parsed(docs, size), "repeats-parsed")
        many = rows.df.filter(F.col("n_bytes") >= size).groupBy("h1", "h2").agg(F.min("key").alias("head"), F.count(F.lit(1)).alias("n")).filter("n > 1")
        copies = Staged(many.select("h1", "h2", "head"), "repeats-copies")
        spans = Staged(removed_spans(docs, rows.df, copies.df, size), "repeats-spans")
        kept += [rows, copies, spans]
    return rows.df, copies.df, spans.df


def repeated_spans(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, spans (start, end in bytes; they may overlap) of the documents with repeated strings."""
    rows, copies, spans = found_repeats(docs, size)
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
    out = rows.select("key", "doc_id", "h1", "h2", "n_bytes").join(small(copies), ["h1", "h2"], "left").join(spans, "key", "left")
    return out.select("doc_id", F.when(F.col("head").isNotNull(), whole).otherwise(F.col("spans")).alias("spans")).filter("spans is not null")


def without_repeats(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of docs (doc_id, text)."""
    rows, copies, spans = found_repeats(docs, size)
    changed = staged(cut(texts_of(docs, spans.join(rows.select("key", "h1", "h2", F.col("doc_id").alias("own")), "key"), "spans")), "repeats-cut")
    copy = F.col("head").isNotNull()
    out = rows.select("key", "doc_id", "h1", "h2", "n_bytes", "sha256").join(small(copies), ["h1", "h2"], "left").join(small(changed), "key", "left")
    return out.select(
        "doc_id",
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept", "sha256")).alias("kept_sha256"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), w AS (
  SELECT rid, i, md5(substr(h, 2 * i::BIGINT + 1, 400)) AS m FROM (SELECT rid, h, unnest(range(0, greatest(length(h) // 2 - 199, 0))) AS i FROM d)
), r AS (
  SELECT rid, i FROM w SEMI JOIN (SELECT m FROM w GROUP BY m HAVING count(*) > 1) t ON w.m = t.m
), g AS (
  SELECT rid, i, sum(fresh) OVER (PARTITION BY rid ORDER BY i) AS run
  FROM (SELECT rid, i, CASE WHEN i <= lag(i) OVER (PARTITION BY rid ORDER BY i) + 200 THEN 0 ELSE 1 END AS fresh FROM r)
), s AS (
  SELECT rid, run, min(i) AS a, max(i) + 200 AS b FROM g GROUP BY ALL
), k AS (
  SELECT rid, count(*)::BIGINT AS n_spans, sum(b - a)::BIGINT AS n_removed, max(b) AS done FROM s GROUP BY rid
), p AS (
  SELECT rid, string_agg(substr(h, (2 * before + 1)::BIGINT, (2 * (a - before))::BIGINT), '' ORDER BY a) AS ahead
  FROM (SELECT s.*, coalesce(lag(b) OVER (PARTITION BY s.rid ORDER BY a), 0) AS before, h FROM s JOIN d USING (rid)) GROUP BY rid
)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(ahead, '') || substr(h, (2 * coalesce(done, 0) + 1)::BIGINT))) AS kept_sha256
FROM d LEFT JOIN k USING (rid) LEFT JOIN p USING (rid)
"""
