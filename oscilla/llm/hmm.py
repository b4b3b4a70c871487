"""Language-model scores: a hidden Markov model over word classes, and a unigram base.

Tokens are a text's words, A-Z lowered, and one end. All training texts are
counted: partial counts in each task, summed by token. The CLASS_WORDS most
frequent tokens (of equal counts the first in byte order) are classes of their
own, every other word (unknown ones too) belongs to one of SUFFIXES classes by a checksum of its last bytes; within its
class a word has a share of its count plus 0.1, unknown words together 0.1. So
the model's probability of a text is the hidden Markov model's probability of
its classes, by the scaled forward recursion over the whole text, times the
words' shares, and it sums to one over all texts.

Baum-Welch starts from random emissions around the counts of all training texts
and makes passes over all of them, until one raises the log likelihood by no
more than SETTLED of it: every task adds up expected counts, these are summed by
class, and the new parameters, whose size is fixed, go to the driver. For
training, texts are cut into pieces of PIECE tokens, so that long ones don't hold
up the recursion; a piece is read together with the MARGIN tokens on either side of
it, which give it its context but are counted in their own piece, and only texts'
first tokens count as starts. Scoring doesn't cut.

Counts of the most frequent tokens go to all tasks: those from a least count on (to a
64th of its power of two), which is found by an aggregate so that they are at most
KNOWN_WORDS, and tokens of about equal counts are all in or all out. The others are
looked up by a join with the table of all counts, which both the
base score and the model's shares need, once for each token of a text.

Nulls: a null text is empty and is its end token alone; a null doc_id hashes as
the empty string. Repeated rows are texts each. An empty table, or one without
training texts, gives every token a probability of one within its class. Extra
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, staged, table, texts, tune

STATES = 8
CLASS_WORDS = 1 << 14
KNOWN_WORDS = 1 << 19
SUFFIXES = 128
LONGEST_KNOWN = 64
SETTLED = 5e-4
PIECE = 1024
MARGIN = 64
FLUSH = 400_000
GROUP_TOKENS = 3_000_000
BLOCK_TOKENS = 400_000
PRIOR = 20.0
END = b" "


def tokens(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def suffix_class(token: bytes) -> int:
    return zlib.crc32(token[-3:]) % SUFFIXES


def counted(docs: DataFrame) -> DataFrame:
    """(token, suffix, c) over the texts of docs, the end token among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flush() -> pa.RecordBatch:
            keys = list(counts)
            out = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(list(map(suffix_class, keys)), pa.int32()), pa.array(list(counts.values()), pa.int64())], names=["token", "suffix", "c"])
            counts.clear()
            return out

        for batch in batches:
            for text in texts(batch):
                counts.update(tokens(text))
            counts[END] += batch.num_rows
            if len(counts) > FLUSH:
                yield flush()
        if counts:
            yield flush()

    partial = docs.select("text").mapInArrow(run, "token string, suffix int, c bigint")
    return partial.filter("c > 0").groupBy("token").agg(F.max("suffix").alias("suffix"), F.sum("c").alias("c"))


class Vocabulary:
    """What scoring needs of the counts, of bounded size."""

    def __init__(self, counts: DataFrame):
        self.total, self.distinct = (x or 0 for x in counts.agg(F.sum("c"), F.count(F.lit(1))).first())
        rows = counts.filter(F.octet_length("token") <= LONGEST_KNOWN).withColumn("step", F.floor(F.log2("c") * 64).cast("int"))
        sizes = np.array(sorted(((r.step, r.n) for r in rows.groupBy("step").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)).reshape(-1, 2)
        fit = np.cumsum(sizes[:, 1]) <= KNOWN_WORDS
        least = int(sizes[fit, 0].min()) if fit.any() else None
        top = rows.filter(F.col("step") >= least if least is not None else F.lit(False)).select("token", "suffix", "c").toArrow()
        top = top.sort_by([("c", "descending"), ("token", "ascending")])
        self.words = [x.encode() for x in top["token"].to_pylist()]
        self.counts = top["c"].to_numpy().astype(float)
        self.suffix = top["suffix"].to_numpy().astype(np.int64)
        n = self.classes = min(CLASS_WORDS, len(self.words))
        mass = np.full(SUFFIXES, 0.1)
        for row in counts.groupBy("suffix").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("n")).collect():
            mass[row.suffix] += row.c + 0.1 * row.n
        mass -= np.bincount(self.suffix[:n], self.counts[:n] + 0.1, SUFFIXES)
        self.mass = np.maximum(mass, 0.1)
        prior = np.concatenate([self.counts[:n] + 0.1, self.mass])
        self.prior = prior / prior.sum()
        self.scale = self.total + 0.1 * (self.distinct + 1)


def encoder(vocabulary: Vocabulary):
    rank = {w: k for k, w in enumerate(vocabulary.words)}
    n = vocabulary.classes
    class_of = np.where(np.arange(len(rank)) < n, np.arange(len(rank)), n + vocabulary.suffix)
    log_count = np.log10(vocabulary.counts + 0.1)
    log_mass = np.log10(vocabulary.mass)
    find = rank.get

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, known, known_log, low_log, mass_log, ids, rare, often = [], [], [], [], [], [], [], []
        for text in texts(batch):
            words = [*tokens(text), END]
            ranks = np.fromiter(map(find, words, repeat(-1)), np.int64, len(words))
            there = ranks >= 0
            missing = Counter(words[k] for k in np.flatnonzero(~there).tolist())
            codes = class_of[ranks] if len(class_of) else np.zeros(len(words), np.int64)
            if missing:
                codes[~there] = [n + suffix_class(words[k]) for k in np.flatnonzero(~there).tolist()]
            found = ranks[there]
            sizes.append(len(words))
            known.append(len(found))
            logs = log_count[found]
            known_log.append(float(logs.sum()))
            low_log.append(float(logs[found >= n].sum()))
            mass_log.append(float(log_mass[codes[codes >= n] - n].sum()))
            ids.append(codes.astype(np.int32))
            rare.append(list(missing))
            often.append(list(missing.values()))
        at = np.cumsum([0, *map(len, ids)]).astype(np.int32)
        flat = pa.array(np.concatenate([np.zeros(0, np.int32), *ids]))
        made = [pa.array(sizes, pa.int64()), pa.array(known, pa.int64()), *(pa.array(x, pa.float64()) for x in (known_log, low_log, mass_log)), pa.ListArray.from_arrays(pa.array(at), flat), pa.array(rare, pa.list_(pa.string())), pa.array(often, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "doc_id", "held_out")), *made], names=["key", "doc_id", "held_out", "n_tokens", "known", "known_log", "low_log", "mass_log", "ids", "rare", "often"])

    return each


_ENCODED = "key bigint, doc_id bigint, held_out boolean, n_tokens bigint, known bigint, known_log double, low_log double, mass_log double, ids array<int>, rare array<string>, often array<bigint>"


class Model:
    def __init__(self, start: np.ndarray, moves: np.ndarray, emits: np.ndarray):
        self.start, self.moves, self.emits = start, moves, emits

    @classmethod
    def random(cls, prior: np.ndarray, states: int = STATES, seed: int = 3) -> Model:
        rng = np.random.default_rng(seed)
        emits = prior[:, None] * rng.gamma(1.0, 1.0, (len(prior), states))
        moves = np.full((states, states), 0.1 / max(1, states - 1)) + np.eye(states) * 0.9
        return cls(np.full(states, 1 / states), moves / moves.sum(1, keepdims=True), emits / emits.sum(0))

    @classmethod
    def of_counts(cls, start: np.ndarray, moves: np.ndarray, emits: np.ndarray, prior: np.ndarray) -> Model:
        start, moves = start + 0.1, moves + 0.1
        emits = emits + PRIOR * prior[:, None]
        return cls(start / start.sum(), moves / moves.sum(1, keepdims=True), emits / emits.sum(0))


class TimeMajor:
    """Sequences laid out step by step, longest first, so that a step is one slice."""

    def __init__(self, codes: np.ndarray, lengths: np.ndarray):
        order = np.argsort(-lengths, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        first = np.cumsum(lengths) - lengths
        steps = np.arange(len(codes)) - np.repeat(first, lengths)
        self.active = np.bincount(steps, minlength=int(lengths.max(initial=0)))
        self.at = np.concatenate([[0], np.cumsum(self.active)])
        self.place = self.at[steps] + np.repeat(rank, lengths)
        self.codes = np.empty(len(codes), codes.dtype)
        self.codes[self.place] = codes
        self.first = first


def forward(model: Model, laid: TimeMajor, keep: bool) -> tuple[np.ndarray | None, np.ndarray, np.ndarray]:
    """Scaled forward probabilities (if kept), the scales, and the emissions, all step by step; a row a state."""
    emitted = np.take(np.ascontiguousarray(model.emits.T), laid.codes, axis=1)
    scales = np.empty(len(laid.codes), emitted.dtype)
    alphas = np.empty_like(emitted) if keep else None
    moves = np.ascontiguousarray(model.moves.T)
    a = None
    for t, n in enumerate(laid.active.tolist()):
        here = slice(laid.at[t], laid.at[t] + n)
        a = (model.start[:, None] if t == 0 else moves @ a[:, :n]) * emitted[:, here]
        c = a.sum(0)
        scales[here] = c
        a /= c
        if keep:
            alphas[:, here] = a
    return alphas, scales, emitted


def expected(model: Model, laid: TimeMajor, start: np.ndarray, moves: np.ndarray, emits: np.ndarray, own: np.ndarray | None = None) -> float:
    """Adds the expected counts of the sequences to start, moves and emits; returns their log likelihood.

    own marks the tokens that count (null: all); a move counts with the token it leads to.
    """
    alphas, scales, emitted = forward(model, laid, True)
    emitted /= scales
    n0 = int(laid.active[0])
    counts = None
    if own is not None:
        counts = np.empty(len(own), emitted.dtype)
        counts[laid.place] = own
    gamma = alphas  # turned into posteriors in place, from the last step back
    pairs = np.zeros(model.moves.shape)
    b = emitted[:, :0]
    for t in range(len(laid.active) - 1, -1, -1):
        at, m = int(laid.at[t]), b.shape[1]
        now = emitted[:, at : at + int(laid.active[t])]
        if m:
            after = int(laid.at[t + 1])
            back = model.moves @ b
            pairs += alphas[:, at : at + m] @ (b if counts is None else b * counts[after : after + m]).T
            gamma[:, at : at + m] *= back
            now[:, :m] *= back
        b = now
    if counts is not None:
        gamma *= counts
    moves += pairs * model.moves
    start += gamma[:, :n0].sum(1, dtype=float)
    for k in range(emits.shape[1]):
        emits[:, k] += np.bincount(laid.codes, gamma[k], len(emits))
    logs = np.log(scales)
    return float((logs if counts is None else logs * counts).sum(dtype=float))


def pieces(lengths: np.ndarray, size: int, margin: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sequences of these lengths, one after the other, cut into pieces of at most size tokens with margin more on either side:
    where each begins, its length, and from and to which of its tokens it is no margin."""
    n = np.maximum(-(-lengths // size), 0)
    which = np.repeat(np.arange(len(lengths)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    own = k * size
    end = np.minimum(own + size, lengths[which])
    begin, stop = np.maximum(own - margin, 0), np.minimum(end + margin, lengths[which])
    first = (np.cumsum(lengths) - lengths)[which]
    return first + begin, stop - begin, own - begin, end - begin


def in_pieces(codes: np.ndarray, lengths: np.ndarray, size: int, margin: int) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """codes and lengths of the pieces, and which of their tokens count (null: all, as nothing was cut)."""
    if lengths.max(initial=0) <= size:
        return codes, lengths, None
    first, length, from_, to = pieces(lengths, size, margin)
    step = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    return codes[np.repeat(first, length) + step], length, (step >= np.repeat(from_, length)) & (step < np.repeat(to, length))


def laid_out(codes: np.ndarray, lengths: np.ndarray, limit: int = BLOCK_TOKENS, own: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, TimeMajor, np.ndarray | None]]:
    """The sequences in blocks of similar lengths: (their numbers, layout, own of the block's tokens)."""
    order = np.argsort(lengths, kind="stable")
    first = np.cumsum(lengths) - lengths
    total, begin = np.cumsum(lengths[order]), 0
    while begin < len(order):
        done = total[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(total, done + limit, "right")))
        chosen = order[begin:end]
        size = lengths[chosen]
        index = np.repeat(first[chosen], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        yield chosen, TimeMajor(codes[index], size), None if own is None or own[index].all() else own[index]
        begin = end


def in_groups(batches: Iterator[pa.RecordBatch], limit: int = GROUP_TOKENS) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Batches gathered until they hold limit tokens: (rows, codes, lengths)."""
    held, size = [], 0

    def out():
        rows = pa.Table.from_batches(held)
        ids = rows["ids"].combine_chunks()
        ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
        return rows, ids.flatten().to_numpy(zero_copy_only=False), ids.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += len(batch.column("ids").flatten())
        if size >= limit:
            yield out()
            held, size = [], 0
    if held:
        yield out()


def baum_welch(encoded: DataFrame, model: Model, prior: np.ndarray) -> tuple[Model, float]:
    """One pass over all rows of encoded (ids), in single precision: the new model, and the log likelihood under the old one."""
    states, rows = len(model.start), len(prior)
    sent = encoded.sparkSession.sparkContext.broadcast((model.start, model.moves, model.emits))
    names = [f"g{k}" for k in range(states)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*(x.astype(np.float32) for x in sent.value))
        start, moves, emits = np.zeros(states), np.zeros((states, states)), np.zeros((rows, states))
        reached = np.zeros(states)  # the log likelihood, in the first place
        for _, codes, lengths in in_groups(batches):
            codes, lengths, counted_ = in_pieces(codes, lengths, PIECE, MARGIN)
            for _, laid, part in laid_out(codes, lengths, own=counted_):
                reached[0] += expected(own, laid, start, moves, emits, part)
        table_ = np.vstack([emits, moves, start, reached])
        used = np.flatnonzero(table_.any(1))
        for k in range(0, len(used), 10_000):
            part = used[k : k + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), *(pa.array(table_[part, j].copy()) for j in range(states))], names=["id", *names])

    partial = encoded.select("ids").mapInArrow(run, "id bigint, " + ", ".join(f"{x} double" for x in names))
    got = partial.groupBy("id").agg(*(F.sum(x).alias(x) for x in names)).toArrow()
    sums = np.zeros((rows + states + 2, states))
    sums[got["id"].to_numpy()] = np.stack([got[x].to_numpy() for x in names], 1) if got.num_rows else 0
    return Model.of_counts(sums[-2], sums[rows : rows + states], sums[:rows], prior), float(sums[-1, 0])


def trained(encoded: DataFrame, prior: np.ndarray) -> Model:
    """Passes over all rows of encoded, from random emissions around prior until the likelihood settles."""
    model, before = Model.random(prior), -np.inf
    while True:
        model, now = baum_welch(encoded, model, prior)
        if not now - before > SETTLED * abs(now):
            return model
        before = now


def likelihoods(encoded: DataFrame, model: Model) -> DataFrame:
    """encoded's columns without ids, rare and often, with path: the log10 probability of the classes."""
    sent = encoded.sparkSession.sparkContext.broadcast((model.start, model.moves, model.emits))
    kept = ["key", "doc_id", "held_out", "n_tokens", "known", "known_log", "low_log", "mass_log"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*sent.value)
        for rows, codes, lengths in in_groups(batches):
            path = np.zeros(len(lengths))
            for chosen, laid, _ in laid_out(codes, lengths):
                _, scales, _ = forward(own, laid, False)
                path[chosen] = np.add.reduceat(np.log10(scales)[laid.place], laid.first)
            yield from rows.select(kept).append_column("path", pa.array(path)).to_batches(max_chunksize=10_000)

    schema = ", ".join(x for x in _ENCODED.split(", ") if x.split()[0] in kept)
    return encoded.select(*kept, "ids").mapInArrow(run, schema + ", path double")


def scored(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    tune(spark)
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 10 == 0
    rows = docs.select(F.monotonically_increasing_id().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), "text")
    counts = staged(counted(rows.filter("not held_out")), "hmm-counts")
    vocabulary = Vocabulary(counts)
    sent = spark.sparkContext.broadcast(vocabulary)
    encoded = staged(arrow_map(rows, lambda: encoder(sent.value), _ENCODED), "hmm-encoded")
    model = trained(encoded.filter("not held_out"), vocabulary.prior)
    rare = encoded.select("key", F.explode(F.arrays_zip("rare", "often")).alias("x")).select("key", F.col("x.rare").alias("token"), F.col("x.often").alias("times"))
    looked_up = rare.join(counts.select("token", "c"), "token", "left")
    c = F.coalesce("c", F.lit(0))
    by_text = looked_up.groupBy("key").agg(F.sum(F.col("times") * F.log10(c + 0.1)).alias("rare_log"), F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("rare_known"))
    out = likelihoods(encoded, model).join(by_text, "key", "left")
    rare_log = F.coalesce("rare_log", F.lit(0.0))
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(int(vocabulary.total)).cast("long").alias("train_tokens"),
        (F.col("known_log") + rare_log - F.col("n_tokens") * float(np.log10(vocabulary.scale))).alias("base_score"),
        (F.col("path") + F.col("low_log") + rare_log - F.col("mass_log")).alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"))
