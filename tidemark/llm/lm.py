"""Operator 6: language-model scores from a log-frequency Bloom filter.

Counts of words and word pairs over all training documents are exact, and all of them go
into the filter, pairs seen once too.  Each n-gram goes in once for every level up to
1 + floor(log2(count)); probing levels until one is missing gives its count back, to a
factor of two and never too small a level: a level stands for counts from least_of() to most_of().

Keys are cut into ranges by their upper bits, so many that the n-grams of a range come from
RANGE_TOKENS tokens of text in the mean; each range has its own bits, BITS_EACH for a level.
The filter so grows with the corpus and what a task holds of it doesn't, and no process needs
it whole.  Texts are read once and become units of UNIT_TOKENS tokens.  A unit sends its
distinct keys to the ranges, block by block (BLOCK_RANGES ranges at most), and gets their
levels back; corpora of every size take this way.

score: sum over tokens of log10 p, p = w * c(h,t) / c(h) + (1 - w) * (c(t) + 1) / (N + V + 1),
w = WEIGHT * c(h) / (c(h) + 4), all counts from the filter, h the token before (or the start).
What is divided is the least count of its level, what divides the most, so the p of all tokens
after one, known and unknown, add up to 1 at most (but for false hits), and no p exceeds 1.
base_score takes exact counts: the HEAD most frequent words come by broadcast, all others
through a join.

Cases: null or empty text is the end token alone; without training documents N = V = 0 and
every p is 1; rows without an id are scored and learned from like others (they are not held
out); repeated rows are scored, and learned from, each on its own; other columns are not read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import discard, saved

#: Tokens of training text that a range of keys stands for in the mean, and that a unit of documents has (but for longer documents).
RANGE_TOKENS = 1 << 19
UNIT_TOKENS = 1 << 20
#: Blocks of ranges that units ask: FEW_BLOCKS (or one a range) until a block would have more than BLOCK_RANGES ranges.
FEW_BLOCKS = 64
BLOCK_RANGES = 32
#: Keys that a task gathers before it sends their counts on.
GATHERED = 1 << 21
BITS_EACH = 10
PROBES = 3
HEAD = 1 << 20
WEIGHT = 0.7
#: The filter knows n-grams by the upper 56 bits of their hashes (base_score knows words by all 64).
KEY = ~np.uint64(0xFF)
CODEC = pa.Codec("zstd", compression_level=1)
END, START = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)


def tokens(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes (words of the lower-cased text, an end after each row), first token of each row."""
    rows = len(first) - 1
    out = np.empty(len(hashes) + rows, np.uint64)
    out[np.arange(len(hashes)) + K.rows_of(first)] = hashes
    first = first + np.arange(rows + 1)
    out[first[1:] - 1] = END
    return out, first


def before(token: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The token before each; START at the first of a row."""
    out = np.empty_like(token)
    out[1:] = token[:-1]
    out[first[:-1]] = START
    return out


def pair(before: np.ndarray, token: np.ndarray) -> np.ndarray:
    return K.mix(before * np.uint64(0xD6E8FEB86659FD93) + K.mix(token)) & KEY


#: Fewer integers are sent as they are: a compressed frame would take more room and time.
FRAME = 64


def packed(values: np.ndarray) -> bytes:
    """Integers by planes of bytes, compressed; keys in order as their differences."""
    if len(values) < FRAME:
        return len(values).to_bytes(8, "little") + values.tobytes()
    if values.dtype == np.uint64:
        values = np.diff(values, prepend=np.uint64(0))
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T)
    return len(values).to_bytes(8, "little") + CODEC.compress(planes, asbytes=True)


def unpacked(raw: pa.BinaryScalar, kind: type) -> np.ndarray:
    """What packed() was given, of that type."""
    raw, size = raw.as_buffer(), np.dtype(kind).itemsize
    n = int.from_bytes(raw[:8], "little")
    if n < FRAME:
        return np.frombuffer(raw[8:], kind)
    planes = np.frombuffer(CODEC.decompress(raw[8:], n * size), np.uint8).reshape(size, n)
    values = np.ascontiguousarray(planes.T).reshape(-1).view(kind)
    return np.cumsum(values, dtype=np.uint64) if kind == np.uint64 else values


def blobs(values: np.ndarray, cut: np.ndarray) -> pa.Array:
    """values[cut[0]:cut[1]], values[cut[1]:cut[2]], … packed."""
    return pa.array([packed(values[a:b]) for a, b in zip(cut, cut[1:])], pa.binary())


def upper(key: np.ndarray, parts: int) -> np.ndarray:
    """Which of so many (a power of two) equal ranges of keys a key is in."""
    return (key >> np.uint64(64 - (parts.bit_length() - 1))).astype(np.int64) if parts > 1 else np.zeros(len(key), np.int64)


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their counts."""
    key, back = np.unique(np.concatenate(keys), return_inverse=True)
    return key, np.bincount(back, np.concatenate(counts), len(key)).astype(np.int64)


UNITS = "unit long, id array<long>, held_out array<boolean>, n_tokens array<long>, words binary, at binary"


def units(rows: DataFrame) -> DataFrame:
    """UNITS rows of documents (id, held_out, text): distinct words of a unit, and which of them each token is."""

    def made(task: int, seen: int, parts: list) -> pa.RecordBatch:
        words, at = np.unique(np.concatenate([x[2] for x in parts]), return_inverse=True)
        n = np.concatenate([x[3] for x in parts])
        whole = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
        ids, held = (pa.concat_arrays([x[i] for x in parts]) for i in (0, 1))
        binary = [pa.array([packed(x)], pa.binary()) for x in (words, at.astype(np.uint32))]
        return pa.RecordBatch.from_arrays([pa.array([(task << 40) + seen]), whole(ids), whole(held), whole(pa.array(n)), *binary], [x.split()[0] for x in UNITS.split(", ")])

    def run(batches):
        task, seen, size, parts = TaskContext.get().partitionId(), 0, 0, []
        for batch in batches:
            ids, held, text = batch.columns
            for row, hashes, first in K.hashed_words(text):
                token, first = tokens(hashes, first)
                if parts and size + len(token) > UNIT_TOKENS:
                    yield made(task, seen, parts)
                    seen, size, parts = seen + sum(len(x[3]) for x in parts), 0, []
                parts.append((ids.slice(row, len(first) - 1), held.slice(row, len(first) - 1), token, np.diff(first)))
                size += len(token)
        if parts:
            yield made(task, seen, parts)

    return rows.mapInArrow(run, UNITS)


def opened(batches) -> Iterator[tuple]:
    """(unit, ids, held_out, first token of each document, words, place of each token in words) for each row of UNITS."""
    for batch in batches:
        unit, ids, held, n, words, at = batch.columns
        for i in range(batch.num_rows):
            first = np.concatenate(([0], np.cumsum(n[i].values.to_numpy())))
            yield unit[i].as_py(), ids[i].values, held[i].values, first, unpacked(words[i], np.uint64), unpacked(at[i], np.uint32)


COUNTS = "range int, n_words byte, key binary, n binary"


def ngram_counts(made: DataFrame, ranges: int) -> DataFrame:
    """COUNTS rows of the training documents of UNITS rows: keys of words (1) and pairs (2) with their counts, to be summed."""

    def run(batches):
        held = {1: ([], []), 2: ([], [])}

        def flushed():
            for size, (keys, counts) in held.items():
                if keys:
                    key, n = summed(keys, counts)
                    cut = np.searchsorted(upper(key, ranges), np.arange(ranges + 1))
                    some = np.flatnonzero(np.diff(cut))
                    cut = np.append(cut[some], len(key))
                    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(np.full(len(some), size, np.int8)), blobs(key, cut), blobs(n.astype(np.uint32), cut)], [x.split()[0] for x in COUNTS.split(", ")])
                    keys.clear()
                    counts.clear()

        for _, _, out, first, words, at in opened(batches):
            learn = np.repeat(out.fill_null(True).to_numpy(zero_copy_only=False) == 0, np.diff(first))
            token = words[at]
            for size, key in ((1, token[learn]), (2, pair(before(token, first), token)[learn])):
                key, n = np.unique(key, return_counts=True)
                held[size][0].append(key)
                held[size][1].append(n)
            if sum(len(k) for keys, _ in held.values() for k in keys) >= GATHERED:
                yield from flushed()
        yield from flushed()

    return made.mapInArrow(run, COUNTS)


def places(key: np.ndarray, level: int, probe: int, bits: np.ndarray) -> np.ndarray:
    """A place below bits (under 2^32) for each key."""
    h = K.mix(key + np.uint64((level * PROBES + probe + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
    return (h >> np.uint64(32)) * bits >> np.uint64(32)


def least_of(level: np.ndarray) -> np.ndarray:
    """The least count that a level stands for; 0 for level 0."""
    return np.where(level > 0, np.exp2(level - 1.0), 0.0)


def most_of(level: np.ndarray) -> np.ndarray:
    """The largest count that a level stands for; 0 for level 0."""
    return np.exp2(np.asarray(level, float)) - 1


def range_bits(key: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The bits of a range with these n-grams, BITS_EACH for each level."""
    top = np.floor(np.log2(n) + 1e-9).astype(np.int64) + 1
    size = max(64, -(-int(top.sum()) * BITS_EACH // 8) * 8)
    bits = np.zeros(size, bool)
    for level in range(1, int(top.max(initial=0)) + 1):
        mine = key[top >= level]
        for j in range(PROBES):
            bits[places(mine, level, j, np.uint64(size))] = True
    return np.packbits(bits, bitorder="little")


class Ranges:
    """Some of the ranges of a filter, for probing."""

    def __init__(self, ranges: int, found: dict[int, np.ndarray]):
        self.ranges, self.low = ranges, min(found, default=0)
        self.size = np.zeros(max(found, default=0) - self.low + 1, np.uint64)
        for r, raw in found.items():
            self.size[r - self.low] = 8 * len(raw)
        self.base = np.concatenate(([0], np.cumsum(self.size)[:-1])).astype(np.uint64)
        self.raw = np.concatenate([found[r] for r in sorted(found)] or [np.zeros(0, np.uint8)])

    def levels(self, key: np.ndarray) -> np.ndarray:
        """The level of each n-gram, 0 for none: the last before the first that is missing."""
        out, at = np.zeros(len(key), np.int64), upper(key, self.ranges) - self.low
        live = np.flatnonzero((at >= 0) & (at < len(self.size)))
        live = live[self.size[at[live]] > 0]
        level = 0
        while len(live):
            level += 1
            for j in range(PROBES):
                place = self.base[at[live]] + places(key[live], level, j, self.size[at[live]])
                live = live[(self.raw[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1]
            out[live] = level
        return out


BUILT = "range int, bits binary, key array<long>, n array<long>"


def build(counts: DataFrame) -> DataFrame:
    """BUILT rows from COUNTS rows: the bits of each range, and its words with their counts."""
    spark = counts.sparkSession

    def run(batches):
        stream = ((r, size, k, n) for b in batches for r, size, k, n in zip(b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2), b.column(3)))
        for r, group in itertools.groupby(stream, key=lambda x: int(x[0])):
            parts: dict[int, tuple[list, list]] = {1: ([], []), 2: ([], [])}
            for _, size, k, n in group:
                parts[int(size)][0].append(unpacked(k, np.uint64))
                parts[int(size)][1].append(unpacked(n, np.uint32))
            none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
            (words, many), (pairs, often) = (summed(*parts[size]) if parts[size][0] else none for size in (1, 2))
            bits = range_bits(np.concatenate((words & KEY, pairs)), np.concatenate((many, often)))
            arrays = [pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), pa.array(x)) for x in (words.view(np.int64), many)]
            yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([bits.tobytes()], pa.binary()), *arrays], [x.split()[0] for x in BUILT.split(", ")])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return counts.repartition(parts, "range").sortWithinPartitions("range").mapInArrow(run, BUILT)


class Filter:
    """The filter of counted n-grams (key, n_words, n), held here as a whole: to look into a small one."""

    def __init__(self, ngrams: DataFrame, ranges: int = 16):
        def run(batches):
            for b in batches:
                for k, size, n in zip(b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy(), b.column(2).to_numpy()):
                    r = upper(np.array([k], np.uint64), ranges).astype(np.int32)
                    values = [pa.array([packed(x)], pa.binary()) for x in (np.array([k], np.uint64), np.array([n], np.uint32))]
                    yield pa.RecordBatch.from_arrays([pa.array(r), pa.array([size], pa.int8()), *values], [x.split()[0] for x in COUNTS.split(", ")])

        made = build(ngrams.select("key", "n_words", "n").mapInArrow(run, COUNTS)).select("range", "bits").toLocalIterator()
        self.held = Ranges(ranges, {r: np.frombuffer(bits, np.uint8) for r, bits in made})

    def levels(self, key: np.ndarray) -> np.ndarray:
        return self.held.levels(key & KEY)


def asked(words: np.ndarray, at: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys that a unit needs, in order, and the key of each token's pair."""
    token = words[at]
    both = pair(before(token, first), token)
    return np.unique(np.concatenate((words & KEY, both))), both


def answers(made: DataFrame, built: DataFrame, ranges: int) -> DataFrame:
    """(unit, block, levels): the levels of the keys of each unit, by blocks of keys in order."""
    blocks = max(min(ranges, FEW_BLOCKS), ranges // BLOCK_RANGES)
    names = ["block", "kind", "unit", "raw"]

    def ask(batches):
        for unit, _, _, first, words, at in opened(batches):
            key, _ = asked(words, at, first)
            cut = np.searchsorted(upper(key, blocks), np.arange(blocks + 1))
            some = np.flatnonzero(np.diff(cut))
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(np.ones(len(some), np.int8)), pa.array(np.full(len(some), unit)), blobs(key, np.append(cut[some], len(key)))], names)

    def answer(batches):
        now, found, held = None, {}, None
        for batch in batches:
            for block, kind, unit, raw in zip(batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy(), batch.column(3)):
                if block != now:
                    now, found, held = block, {}, None
                if kind == 0:
                    found[int(unit)] = np.frombuffer(raw.as_buffer(), np.uint8).copy()
                    continue
                if held is None:
                    held, found = Ranges(ranges, found), {}
                levels = held.levels(unpacked(raw, np.uint64)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([pa.array([unit]), pa.array([block], pa.int32()), pa.array([packed(levels)], pa.binary())], ["unit", "block", "levels"])

    questions = made.mapInArrow(ask, "block int, kind byte, unit long, raw binary")
    bits = built.select(F.floor(F.col("range") / (ranges // blocks)).cast("int").alias("block"), F.lit(0).cast("byte").alias("kind"), F.col("range").cast("long").alias("unit"), F.col("bits").alias("raw"))
    parts = max(int(made.sparkSession.conf.get("spark.sql.shuffle.partitions")), blocks // 4)
    met = bits.unionByName(questions).repartition(parts, "block").sortWithinPartitions("block", "kind")
    return met.mapInArrow(answer, "unit long, block int, levels binary")


SCHEMA = "uid long, id long, held_out boolean, n_tokens long, base double, known long, score double, rare array<long>"


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score; learned from those not held out."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), held_out.alias("held_out"), F.col(text_col).alias("text"))
    made = saved(units(rows), "lm-units")
    sums = lambda c: F.coalesce(F.sum(c), F.lit(0))
    n_docs, all_tokens = made.agg(sums(F.size(F.filter("held_out", lambda h: ~h))), sums(F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, b: a + b))).first()
    ranges = 1
    while ranges * RANGE_TOKENS < all_tokens:
        ranges *= 2
    built = saved(build(ngram_counts(made, ranges)), "lm-filter")
    words = built.select(F.explode(F.arrays_zip("key", "n")).alias("w")).select("w.key", "w.n")
    known, total = words.agg(F.count("*"), sums("n")).first()
    # the most frequent words, HEAD at most: those above a count that few enough reach
    fine = F.floor(F.log2("n") * 16).cast("int")
    steps, head = words.groupBy(fine.alias("step")).count().orderBy(F.desc("step")).collect(), 0
    low = None
    for step in steps:
        head += step["count"]
        if head > HEAD:
            break
        low = step["step"]
    top = words.where(fine >= low).select("key", "n").toArrow() if low is not None else pa.table({"key": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
    keys = top["key"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    shared = spark.sparkContext.broadcast((keys[order], np.log10(top["n"].to_numpy()[order] + 1.0)))

    def run(batches):
        head_keys, head_logs = shared.value
        batches = (b for whole in batches for b in (whole.slice(i, 1) for i in range(whole.num_rows)))
        for batch in batches:
            unit, ids, held, first, distinct, at = next(opened([batch.select(range(6))]))
            key, both = asked(distinct, at, first)
            level = np.concatenate([unpacked(x, np.uint8) for x in batch.column(6)[0].values.field("levels")])
            n = len(first) - 1
            owner = K.rows_of(first)
            place = np.minimum(np.searchsorted(head_keys, distinct), max(len(head_keys) - 1, 0))
            found = head_keys[place] == distinct if len(head_keys) else np.zeros(len(distinct), bool)
            logs = np.where(found, head_logs[place], 0.0) if len(head_keys) else np.zeros(len(distinct))
            base = np.bincount(owner, logs[at], n)
            have = found[at]
            mine = level[np.searchsorted(key, distinct & KEY)][at]
            c, h = np.minimum(least_of(mine), total), np.empty(len(at))
            h[1:] = most_of(mine[:-1])
            h[first[:-1]] = n_docs
            seen = np.minimum(least_of(level[np.searchsorted(key, both)]), h)
            w = WEIGHT * h / (h + 4)
            p = w * seen / np.maximum(h, 1) + (1 - w) * (c + 1) / (total + known + 1)
            lists = np.concatenate(([0], np.cumsum(~have)))[first]
            rare = pa.ListArray.from_arrays(pa.array(lists.astype(np.int32)), pa.array(distinct[at][~have].view(np.int64)))
            columns = [pa.array(unit + np.arange(n)), ids, held, pa.array(np.diff(first)), pa.array(base), pa.array(np.bincount(owner, have, n).astype(np.int64)), pa.array(np.bincount(owner, np.log10(p), n)), rare]
            yield pa.RecordBatch.from_arrays(columns, ["uid", "id", "held_out", "n_tokens", "base", "known", "score", "rare"])

    told = answers(made, built, ranges).groupBy("unit").agg(F.sort_array(F.collect_list(F.struct("block", "levels"))).alias("told"))
    scored = saved(made.join(told, "unit").select(made.columns + ["told"]).mapInArrow(run, SCHEMA), "lm-scores")
    discard(made)
    each = scored.select("uid", F.explode("rare").alias("key")).groupBy("uid", "key").agg(F.count("*").alias("times"))
    rare = each.join(words.select("key", "n"), "key").groupBy("uid").agg(F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more"), F.sum("times").alias("more_known"))
    base = F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * F.lit(float(np.log10(total + known + 1)))
    return scored.join(rare, "uid", "left").select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"), base.alias("base_score"), "score"
    )
