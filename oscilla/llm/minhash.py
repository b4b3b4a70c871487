"""Near duplicates: b-bit MinHash signatures and a multi-index Hamming join.

A document's set is that of its distinct runs of WIDTH words (all its words if
it has fewer; none without words). Its signature has COMPONENTS minima of as many
random hash functions over the set, BITS bits of each. Two documents of Jaccard
similarity J differ in a component with a chance of about 1 - J; at J = 0.8, of
36 components more than ERRORS = 17 differ about once in a hundred thousand
pairs, and less often above. The join finds all pairs with at most ERRORS
differing components: the signature is split into CHUNKS chunks, by pigeonhole
one of them has at most ERRORS // CHUNKS = 1 error, and so the pair agrees in one
of the chunk's variants that leave out one component. Every variant is a key.

Documents with equal sets are one class from the start. Classes that share a key
are not paired all with all: each is first paired with the hub of its key (a
star), the member that shares most keys with most others, the pairs are confirmed
on the full sets, and components are formed. Then the members outside their key's largest
component are paired with HUBS of its members, which links most of those that belong to it.
Only where a key still spans several components are its members paired across
these: those outside its largest component with all. A key's low bits say which variant
it is, so a pair is given out under the first of the keys it shares only. Of keys with more than
SPLIT members outside, these pairs would grow with the square of the members; there, pairs are those
that share one of their rarest shingles, which all similar sets do (``by_rarest``). Texts of more
than LONG shingles have many of these, so their keys are divided instead: of a pair with at most ERRORS
errors, some chunk other than the key's own has at most ERRORS // (CHUNKS - 1) = 2, so the pair agrees in
one of the variants of another chunk that leave out two components, which together with the
key is a key again. Sketches of the sets' parities rule out for certain most pairs that
are not similar, before the others are confirmed. Pairs within a component can't change
it, so no link between components is lost.
Sets are only made for classes that are in a pair.

Nulls: a null text has no words; it links with nothing, like any text without
words. A null doc_id can't be a component: its row links with nothing, its
component_id is null, and it is kept. Rows that repeat a doc_id are one
document with the links of all of them. Extra columns are ignored, and kept by
``distinct_documents``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, Staged, arrow_map, classes_of_names, connected_components, named_components, scratch, small, staged, table, texts, tune
from .hashing import mixed, prefixes, substrings

COMPONENTS = 36
BITS = 16
CHUNKS = 9
ERRORS = 17
SKETCH = 16
BLOCK_BYTES = 150_000
#: Members outside its largest component from which a key's pairs are found by their rarest shingles.
SPLIT = 16
#: Shingles from which texts of such a key are found by a second chunk instead.
LONG = 20_000
#: Members of a key's largest component with which those outside it are paired first.
HUBS = 8
#: Ids that may be broadcast to filter texts before they are shuffled.
FILTER_ROWS = 2_000_000

_RNG = np.random.default_rng(4)
_FACTORS = _RNG.integers(0, 2**63, COMPONENTS, dtype=np.uint64)[:, None] * np.uint64(2) + np.uint64(1)
_TERMS = _RNG.integers(0, 2**64, COMPONENTS, dtype=np.uint64)[:, None]
_PLACES = _RNG.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def blocks(raw: list[bytes], limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about limit bytes together."""
    first, size = 0, 0
    for k, x in enumerate(raw):
        size += len(x)
        if size >= limit:
            yield first, k + 1
            first, size = k + 1, 0
    if first < len(raw):
        yield first, len(raw)


def distinct(x: np.ndarray) -> np.ndarray:
    """The sorted distinct numbers; by a sort, as np.unique's hash table is slower."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])]


def shingle_sets(raw: list[bytes], width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text (lower-case bytes)."""
    for first, last in blocks(raw):
        data = np.frombuffer(b" ".join([*raw[first:last], b""]), np.uint8)
        inside = np.concatenate([[False], ~((data == 32) | ((data >= 9) & (data <= 13))), [False]])
        turns = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = turns[::2], turns[1::2]
        words = mixed(substrings(prefixes(data), starts, ends))
        bounds = np.searchsorted(starts, np.cumsum([0, *(len(x) + 1 for x in raw[first:last])]))
        n = max(0, len(words) - width + 1)
        runs = np.zeros(n, np.uint64)
        for k in range(width):
            runs += words[k : k + n] * _PLACES[k]
        runs = mixed(runs)
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if b - a >= width:
                yield distinct(runs[a : b - width + 1])
            elif b > a:
                yield mixed(np.array([(words[a:b] * _PLACES[: b - a]).sum(dtype=np.uint64)], np.uint64) + np.uint64(b - a))
            else:
                yield np.zeros(0, np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """COMPONENTS minima over a set that isn't empty, BITS bits of each."""
    least = np.full((COMPONENTS, 1), 2**64 - 1, np.uint64)
    for k in range(0, len(shingles), 20_000):
        least = np.minimum(least, (shingles[None, k : k + 20_000] * _FACTORS + _TERMS).min(1, keepdims=True))
    return (mixed(least[:, 0]) & np.uint64((1 << BITS) - 1)).astype(np.uint16)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """SKETCH words of parities: each shingle turns one bit over.

    Two sketches differ in no more bits than their sets in elements, so pairs whose
    sketches differ in more than similar sets can are ruled out for certain.
    """
    odd = np.bincount((mixed(shingles) >> np.uint64(33)).astype(np.int64) % (64 * SKETCH), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def lowered(batch: pa.RecordBatch) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass").lower() for t in texts(batch)]


def described(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, high and low (128 bits of the set), signature of every row."""
    tune(docs.sparkSession)

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            sizes, high, low, signs = [], [], [], []
            for s in shingle_sets(lowered(batch), width):
                digest = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                sizes.append(len(s))
                high.append(int.from_bytes(digest[:8], signed=True))
                low.append(int.from_bytes(digest[8:], signed=True))
                signs.append(signature(s).tobytes() if len(s) else None)
            made = [pa.array(sizes, pa.int64()), pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array(signs, pa.binary())]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), *made], names=["doc_id", "n_shingles", "high", "low", "signature"])

        return each

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, "doc_id bigint, n_shingles bigint, high bigint, low bigint, signature binary")


def variants(parts: np.ndarray, chunk: int, left_out: tuple[int, ...]) -> np.ndarray:
    """The key of a chunk of signatures (rows, CHUNKS, components a chunk) without some of its components."""
    each = parts.shape[2]
    total = np.full(len(parts), chunk * 1000 + sum((x + 1) * (each + 1) ** k for k, x in enumerate(left_out)), np.uint64)
    for k in range(each):
        if k not in left_out:
            total = mixed(total * _PLACES[k] + parts[:, chunk, k])
    return total


def chunks_of(signatures: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(signatures.to_pylist()), np.uint16).reshape(-1, CHUNKS, COMPONENTS // CHUNKS).astype(np.uint64)


def keyed(classes: DataFrame) -> DataFrame:
    """(key, id): the variants of all chunks of every class's signature."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, parts = batch.column("id").to_numpy(zero_copy_only=False), chunks_of(batch.column("signature"))
            each = COMPONENTS // CHUNKS
            keys = [(variants(parts, c, (x,)) << np.uint64(6) | np.uint64(c * each + x)).view(np.int64) for c in range(CHUNKS) for x in range(each)]
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.tile(ids, len(keys)))], names=["key", "id"])

        return each

    return arrow_map(classes.select("id", "signature"), make, "key bigint, id bigint")


#: Which two components a divided key leaves out.
PAIRS_LEFT_OUT = tuple((x, y) for x in range(COMPONENTS // CHUNKS) for y in range(x + 1, COMPONENTS // CHUNKS))


def divided(members: DataFrame) -> DataFrame:
    """(key, id, component): members (key, id, component, signature) by their key and the variants of every other chunk.

    The low bits of a key are the number of the variant, above them the chunk of the first key.
    """

    def make():
        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            parts = chunks_of(batch.column("signature"))
            key = batch.column("key").to_numpy(zero_copy_only=False).view(np.uint64)
            salt, own = mixed(key), (key & np.uint64(63)) // np.uint64(COMPONENTS // CHUNKS)
            for c in range(CHUNKS):
                rest = np.flatnonzero(own != c)
                out = batch.take(pa.array(rest))
                for v, pair in enumerate(PAIRS_LEFT_OUT):
                    made = mixed(variants(parts[rest], c, pair) ^ salt[rest]) << np.uint64(10)
                    made |= own[rest] << np.uint64(6) | np.uint64(c * len(PAIRS_LEFT_OUT) + v)
                    yield pa.RecordBatch.from_arrays([pa.array(made.view(np.int64)), out.column("id"), out.column("component")], names=["key", "id", "component"])

        return each

    return arrow_map(members.select("key", "id", "component", "signature"), make, "key bigint, id bigint, component bigint")


def is_first(key: np.ndarray, apart: np.ndarray, second: bool) -> np.ndarray:
    """Which pairs share no earlier key than this one. apart: (pairs, CHUNKS), the XOR of the two signatures."""
    each, rows, chunks = COMPONENTS // CHUNKS, np.arange(len(key)), np.arange(CHUNKS)
    lanes = apart.view(np.uint16).reshape(len(key), CHUNKS, each) != 0
    errors = lanes.sum(2)
    place, variants_ = key & 63, len(PAIRS_LEFT_OUT) if second else each
    chunk, variant = np.minimum(place // variants_, CHUNKS - 1), place % variants_
    own, at_first = errors[rows, chunk], lanes[rows, chunk, 0]
    earlier = (chunk[:, None] <= chunks) | (errors >= (3 if second else 2))
    if not second:
        return earlier.all(1) & ((variant == 0) | (own > 0))
    earlier |= ((key >> 6) & 15)[:, None] == chunks
    # two errors tell the variant; of one, it is left out together with the first component, or the second if it is the first itself
    canonical = (own == 2) | ((own == 1) & (variant < each - 1) & (~at_first | (variant == 0))) | ((own == 0) & (variant == 0))
    return earlier.all(1) & canonical


def first_shared(key: Column, apart: list[Column], second: bool) -> Column:
    """Whether a pair shares no earlier key than this one. apart: per chunk, the XOR of the two signatures' components.

    An Arrow function: as an expression it outgrows what the JVM compiles well.
    """

    def first(key: pa.Array, *apart: pa.Array) -> pa.Array:
        columns = [x.to_numpy(zero_copy_only=False) for x in apart]
        return pa.array(is_first(key.to_numpy(zero_copy_only=False), np.stack(columns, 1), second), pa.bool_())

    return F.arrow_udf(first, "boolean")(key, *apart)


def early_chunks(key: Column, apart: list[Column], second: bool) -> Column:
    """The part of first_shared that says most, in the JVM: no earlier key in the chunks of apart, the first few."""

    def count(x: Column) -> Column:
        lanes = [x.bitwiseAND(F.lit(0xFFFF << (16 * k))) != 0 for k in range(3)]
        return sum(lane.cast("int") for lane in [*lanes, F.shiftrightunsigned(x, 48) != 0])

    place, variants_ = key.bitwiseAND(F.lit(63)), len(PAIRS_LEFT_OUT) if second else COMPONENTS // CHUNKS
    own = F.shiftright(key, 6).bitwiseAND(F.lit(15))
    tests = [(place < variants_ * (c + 1)) | (count(x) >= (3 if second else 2)) | ((own == c) if second else F.lit(False)) for c, x in enumerate(apart)]
    return reduce(lambda a, b: a & b, tests)


def sets_of(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(id, shingles, n, x0 ...: the sketch, s0 ...: the signature) for the wanted classes (id, name, high, low, signature), from the documents' texts."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if BROADCAST_ROWS < wanted.count() <= FILTER_ROWS:
        rows = rows.join(F.broadcast(wanted.select("name")), F.col("doc_id") == F.col("name"), "left_semi")
    rows = rows.join(small(wanted), F.col("doc_id") == F.col("name"))
    names = [*(f"x{k}" for k in range(SKETCH)), *(f"s{k}" for k in range(CHUNKS))]

    def digest(s: np.ndarray) -> tuple[int, int]:
        d = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
        return int.from_bytes(d[:8], signed=True), int.from_bytes(d[8:], signed=True)

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = list(shingle_sets(lowered(batch), width))
            own = [digest(s) == x for s, x in zip(sets, zip(batch.column("high").to_pylist(), batch.column("low").to_pylist(), strict=True), strict=True)]
            flat = np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)
            at = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            signs = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.int64).reshape(-1, CHUNKS)
            bits = np.hstack([np.array([sketch(s) for s in sets], np.int64).reshape(-1, SKETCH), signs])
            made = [batch.column("id"), pa.ListArray.from_arrays(pa.array(at), pa.array(flat)), pa.array(np.diff(at).astype(np.int64)), *(pa.array(bits[:, k].copy()) for k in range(len(names)))]
            return pa.RecordBatch.from_arrays(made, names=["id", "shingles", "n", *names]).filter(pa.array(own, pa.bool_()))

        return each

    schema = "id bigint, shingles array<bigint>, n bigint, " + ", ".join(f"{x} bigint" for x in names)
    return arrow_map(rows.select("id", "high", "low", "signature", "text"), make, schema).dropDuplicates(["id"])


def outside(members: DataFrame) -> DataFrame:
    """members (key, id, component) of keys with several components, with main, their largest, and rest, the members outside it."""
    sizes = members.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    keys = sizes.groupBy("key").agg(F.max(F.struct("n", "component")).alias("m"), F.sum("n").alias("all"))
    keys = keys.select("key", F.col("m.component").alias("main"), (F.col("all") - F.col("m.n")).alias("rest")).filter("rest > 0")
    return members.join(staged(keys, "minhash-torn-keys"), "key")


def opened(members: DataFrame, components: DataFrame) -> DataFrame:
    """The members (key, id) of keys that span several components (id, component), as ``outside`` gives them; staged."""
    placed = members.select("key", "id").join(small(components), "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    torn = staged(placed.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x < y").select("key"), "minhash-torn")
    return staged(outside(placed.join(torn, "key")), "minhash-open")


def near_main(open_: DataFrame, hubs: int = HUBS) -> DataFrame:
    """Pairs (a, b) of the members outside their key's largest component and a few of that component's members.

    These have the least of as many hashes of their ids, so the keys of a group choose the same ones mostly.
    """
    least = [F.min(F.struct(F.xxhash64(F.lit(k), "id").alias("h"), "id"))["id"] for k in range(hubs)]
    chosen = open_.filter("component = main").groupBy("key").agg(F.array_distinct(F.array(*least)).alias("hubs"))
    pairs = open_.filter("component <> main").join(staged(chosen, "minhash-main-hubs"), "key").select("id", F.explode("hubs").alias("hub"))
    return pairs.select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()


def sketches_allow(percent: int) -> Column:
    """Whether sets of na and nb elements with sketches x0 ... and y0 ... may be similar.

    Of similar sets, at most (100 - percent) / (100 + percent) of the elements that both
    have in sum are in one of them only.
    """
    apart = sum(F.bit_count(F.col(f"x{k}").bitwiseXOR(F.col(f"y{k}"))) for k in range(SKETCH))
    return apart * (100 + percent) <= (F.col("na") + F.col("nb")) * (100 - percent)


def possible(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, ...) that their sketches don't rule out."""
    left = sets.select(F.col("id").alias("a"), F.col("n").alias("na"), *(f"x{k}" for k in range(SKETCH)))
    right = sets.select(F.col("id").alias("b"), F.col("n").alias("nb"), *(F.col(f"x{k}").alias(f"y{k}") for k in range(SKETCH)))
    return pairs.join(left, "a").join(right, "b").filter(sketches_allow(percent)).select(*pairs.columns)


def rarest(ids: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(key, id, component, n, least, most): each id's (id, component) rarest shingles by which it may be found.

    A set's shingles are put in order: those of one component only, which no pair across
    components shares, then by how many of the sets have them. The first one that
    two sets share can't stand later in either than leaves enough for similar sets: from a
    place on there is none, and before it only sets of least to most elements come into question.
    """
    held = staged(ids.join(sets.select("id", "n", "shingles"), "id"), "minhash-hot-sets")
    each = held.select("id", "component", "n", F.explode("shingles").alias("key"))
    counted = each.groupBy("key").agg(F.count(F.lit(1)).alias("sets"), F.min("component").alias("x"), F.max("component").alias("y"))
    counted = staged(counted.filter("x < y").select("key", "sets"), "minhash-shared-shingles")
    ordered = each.join(counted, "key").groupBy("id", "component", "n").agg(F.sort_array(F.collect_list(F.struct("sets", "key"))).alias("order"))
    ordered = ordered.withColumn("least", F.expr(f"(n * {percent} + 99) div 100")).withColumn("before", F.col("n") - F.size("order"))
    enough = F.expr(f"({percent} * (n + least) + {99 + percent}) div {100 + percent}")
    taken = F.greatest(F.col("n") - enough + 1 - F.col("before"), F.lit(0)).cast("int")
    rows = ordered.select("id", "component", "n", "least", "before", F.posexplode(F.slice("order", F.lit(1), taken)).alias("at", "shingle"))
    most = F.expr(f"least(n * 100 div {percent}, (n - before - at) * {100 + percent} div {percent} - n)")
    return rows.select("shingle.key", "id", "component", "n", "least", most.alias("most"))


def by_rarest(ids: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, ca, cb): pairs of ids (id, component) in different components that share one of their rarest shingles and aren't ruled out by size; a < b, each once.

    Only members outside a shingle's largest component are paired, with those of fitting sizes.
    """
    rows = staged(outside(staged(rarest(ids, sets, percent), "minhash-rarest")), "minhash-rarest-open")
    step = lambda x: F.floor(F.log(x) * 20)
    left = rows.filter("component <> main").select("key", F.col("id").alias("a"), F.col("component").alias("ca"), F.col("n").alias("na"), F.col("least").alias("la"), F.col("most").alias("ma"), F.explode(F.sequence(step("least"), step("most"))).alias("step"))
    right = rows.select("key", F.col("id").alias("b"), F.col("component").alias("cb"), (F.col("component") == F.col("main")).alias("in_main"), F.col("n").alias("nb"), F.col("least").alias("lb"), F.col("most").alias("mb"), step("n").alias("step"))
    fit = F.col("nb").between(F.col("la"), F.col("ma")) & F.col("na").between(F.col("lb"), F.col("mb"))
    found = left.join(right, ["key", "step"]).filter((F.col("ca") != F.col("cb")) & fit & (F.col("in_main") | (F.col("a") < F.col("b"))))
    return ascending(found).distinct()


def ascending(pairs: DataFrame, *more: str | Column) -> DataFrame:
    """Pairs (a, b, ca, cb) turned so that a < b."""
    turn = F.col("a") > F.col("b")
    pick = lambda x, y, name: F.when(turn, F.col(y)).otherwise(F.col(x)).alias(name)
    return pairs.select(pick("a", "b", "a"), pick("b", "a", "b"), pick("ca", "cb", "ca"), pick("cb", "ca", "cb"), *more)


def across_components(open_: DataFrame, sets: DataFrame, percent: int, second: bool = False) -> DataFrame:
    """(a, b, ca, cb): pairs of a key in different components that their sketches don't rule out; a < b, each once.

    open_: key (divided ones: second), id, component, main. Only members outside the key's
    main component are paired, with all, so a large component costs a row a member for
    each of them.
    """
    names, signs = [f"x{k}" for k in range(SKETCH)], [f"s{k}" for k in range(CHUNKS)]
    rows = staged(open_.join(sets.select("id", "n", *names, *signs), "id"), "minhash-sketched")
    left = rows.filter("component <> main").select("key", F.col("id").alias("a"), F.col("component").alias("ca"), F.col("n").alias("na"), *names, *signs)
    other = [F.col(x).alias(f"{'y' if x[0] == 'x' else 't'}{x[1:]}") for x in (*names, *signs)]
    right = rows.select(F.col("key").alias("k"), F.col("id").alias("b"), F.col("component").alias("cb"), (F.col("component") == F.col("main")).alias("in_main"), F.col("n").alias("nb"), *other)
    apart_ = [F.col(x).bitwiseXOR(F.col(f"t{x[1:]}")) for x in signs]
    differ = [x.alias(f"d{k}") for k, x in enumerate(apart_)]
    once = (F.col("in_main") | (F.col("a") < F.col("b"))) & early_chunks(F.col("key"), apart_[:3], second)
    found = left.join(right, (F.col("key") == F.col("k")) & (F.col("ca") != F.col("cb")) & sketches_allow(percent) & once)
    found = ascending(found, "key", *differ)
    return found.filter(first_shared(F.col("key"), [F.col(f"d{k}") for k in range(CHUNKS)], second)).select("a", "b", "ca", "cb")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb")).cast("long")
    union = F.size("sa") + F.size("sb") - both
    close = F.least(F.size("sa"), F.size("sb")) * 100 >= F.greatest(F.size("sa"), F.size("sb")) * percent
    return pairs.join(right, "b").join(left, "a").filter(close).filter(both * 100 >= union * percent).select("a", "b")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, split: int = SPLIT, long: int = LONG) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs (doc_id, text)."""
    with scratch(docs.sparkSession) as kept:
        rows, found = linked_classes(docs, width, percent, split, long)
        kept += [rows, found]
    by = small(found.df.withColumnsRenamed({"high": "h", "low": "l"}))
    out = rows.df.join(by, (F.col("high") == F.col("h")) & (F.col("low") == F.col("l")) & F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def linked_classes(docs: DataFrame, width: int, percent: int, split: int, long: int) -> tuple[Staged, Staged]:
    """The rows as described, and (high, low, component) of the classes with more than one row or a link."""
    described_ = Staged(described(docs, width), "minhash-rows")
    rows = described_.df
    named = rows.filter("n_shingles > 0 and doc_id is not null")
    classes = named.groupBy("high", "low").agg(F.min("doc_id").alias("name"), F.min_by("signature", "doc_id").alias("signature"), F.count(F.lit(1)).alias("n"))
    classes = staged(classes.withColumn("id", F.monotonically_increasing_id()), "minhash-classes")  # fixed by being written
    keys = keyed(classes)
    counted = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("x"), F.max("id").alias("y")).filter("x < y")
    shared = staged(counted.select("key", "n"), "minhash-keys")
    members = staged(keys.join(shared, "key"), "minhash-members")
    # the hub of a key is the member that shares most keys with most others: of copies, the least altered
    weights = members.groupBy("id").agg(F.sum("n").alias("weight"))
    members = staged(members.select("key", "id").join(weights, "id"), "minhash-weighted")
    hubs = staged(members.groupBy("key").agg(F.max(F.struct("weight", "id")).alias("m")).select("key", F.col("m.id").alias("hub")), "minhash-hubs")
    stars = members.join(hubs, "key").filter("id <> hub")
    pairs = staged(stars.select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct(), "minhash-pairs")
    named_classes = classes.select("id", "name", "high", "low", "signature")
    wanted = staged(members.select("id").distinct().join(named_classes, "id"), "minhash-wanted")
    sets = staged(sets_of(docs, wanted, width), "minhash-sets")
    links = staged(confirmed(staged(possible(pairs, sets, percent), "minhash-possible"), sets, percent), "minhash-links")
    links = links.union(classes_of_names(named, classes, "doc_id", ["high", "low"]))
    links = staged(links, "minhash-first-links")
    first = connected_components(links)
    # a second star: members outside their key's largest component with a few others of that
    again = staged(near_main(opened(members, first)).join(pairs, ["a", "b"], "left_anti"), "minhash-second-pairs")
    if not again.isEmpty():
        pairs = pairs.union(again)
        first = connected_components(links.union(confirmed(staged(possible(again, sets, percent), "minhash-possible"), sets, percent)))
    final = first
    # keys that still span several components: pairs across them
    open_ = opened(members, first)
    hot = open_.filter(F.col("rest") > split).select("key", "id", "component").join(sets.select("id", F.col("n").alias("size")), "id")
    hot = staged(hot, "minhash-hot")
    apart = across_components(open_.filter(F.col("rest") <= split), sets, percent)
    if not hot.isEmpty():
        # two similar sets are both in the one part or both in the other, or in both
        short = hot.filter(F.col("size") * percent <= long * 100).select("id", "component").distinct()
        apart = apart.union(possible(staged(by_rarest(short, sets, percent), "minhash-rare-pairs"), sets, percent))
        large = hot.filter(F.col("size") > long).drop("size").join(classes.select("id", "signature"), "id")
        if not large.isEmpty():
            apart = apart.union(across_components(outside(staged(divided(large), "minhash-divided")), sets, percent, second=True))
    across = staged(apart.join(pairs, ["a", "b"], "left_anti"), "minhash-across")
    if not across.isEmpty():
        more = confirmed(across.select("a", "b"), sets, percent).join(across, ["a", "b"]).select(F.col("ca").alias("a"), F.col("cb").alias("b"))
        merged = connected_components(more).select(F.col("id").alias("old"), F.col("component").alias("new"))
        alone = merged.join(first.select(F.col("id").alias("old")), "old", "left_anti")
        known = first.unionByName(alone.select(F.col("old").alias("id"), F.col("old").alias("component")))
        final = known.join(small(merged), F.col("component") == F.col("old"), "left").select("id", F.coalesce("new", "component").alias("component"))
    linked = named_components(classes.select("id", "name", "high", "low"), final).select("id", "high", "low", "component")
    alone = classes.filter("n > 1").join(final, "id", "left_anti").select("high", "low", F.col("name").alias("component"))
    return described_, Staged(linked.select("high", "low", "component").union(alone), "minhash-found")


def distinct_documents(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component, the one with the smallest doc_id, with docs' own columns.

    Rows are told apart by a number of their own, so rows that repeat a doc_id, or have
    none, are compared like any others; a null doc_id is the largest. Rows without words
    all stay.
    """
    spark = docs.sparkSession
    with scratch(spark) as kept:
        rows = Staged(docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("number")), "minhash-numbered")
        own = rows.df.select(F.col("number").alias("doc_id"), F.col("row.text").alias("text"))
        found = near_duplicates(own, width, percent)
        names = rows.df.select(F.col("number").alias("doc_id"), F.col("row.doc_id").alias("name"))
        many = staged(found.filter("doc_id <> component_id").select("component_id").distinct(), "minhash-many")
        members = staged(found.join(small(many), "component_id", "left_semi").select("doc_id", "component_id").join(names, "doc_id"), "minhash-members")
        first = members.groupBy("component_id").agg(F.min(F.struct(F.col("name").isNull().alias("none"), "name", "doc_id")).alias("first"))
        drop = Staged(members.join(first.select("component_id", "first.doc_id").withColumnRenamed("doc_id", "kept"), "component_id").filter("doc_id <> kept").select(F.col("doc_id").alias("dropped")), "minhash-drop")
        kept += [rows, drop]
    return rows.df.join(small(drop.df), F.col("number") == F.col("dropped"), "left_anti").select("row.*")


def op7(docs: DataFrame) -> DataFrame:
    found = near_duplicates(docs.select("doc_id", "text"), width=4, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT rid, doc_id, array_to_string(w[i:i + 3], ' ') AS s FROM (SELECT rid, doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (
  SELECT rid, count(*)::BIGINT AS n FROM s GROUP BY rid
), p AS (
  SELECT a.rid AS ra, b.rid AS rb, a.doc_id AS a, b.doc_id AS b, count(*) AS shared
  FROM s a JOIN s b ON a.s = b.s AND a.rid < b.rid WHERE a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL GROUP BY ALL
), l AS (
  SELECT a, b FROM p JOIN n x ON x.rid = ra JOIN n y ON y.rid = rb WHERE 100 * shared >= 80 * (x.n + y.n - shared)
), e AS (
  SELECT a, b FROM l UNION SELECT b, a FROM l
), reach AS (
  SELECT DISTINCT doc_id AS id, doc_id AS other FROM d WHERE doc_id IS NOT NULL
  UNION SELECT e.a, reach.other FROM reach JOIN e ON e.b = reach.id
), k AS (
  SELECT id, min(other) AS component_id FROM reach GROUP BY id
)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, coalesce(d.doc_id = component_id, true) AS kept
FROM d LEFT JOIN n USING (rid) LEFT JOIN k ON d.doc_id = k.id
"""
