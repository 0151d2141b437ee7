"""Operator 10: near-duplicates by HyperMinHash.

A document's set holds its distinct shingles of so many words.  Its sketch has one register
for each of REGISTERS buckets: the leading zeros and MANTISSA following bits of the least
hash in the bucket.  Bands of registers (empty ones borrow from the next bucket that has
something) bring candidates together; the Jaccard estimate, corrected for registers that
agree by chance, drops hopeless pairs; the rest are confirmed on the full sets.  Bands are as
long as they can be with under MISSED of pairs at the threshold sharing none, so that
unrelated documents seldom meet.

Equal sets are one class.  No group is expanded into its pairs:

1. All members of a band bucket are held against its least id.
2. Members of buckets that still have several components are held against another pivot of
   each bucket, by one pair at most for a member and a foreign component.
3. What is open then is settled on full sets.  A shingle that no other open document has
   can't be shared; documents with too many of those are out (two aggregations of shingles).
   The others meet where they share one of their rarest shingles, of which two sets of the
   similarity have one in common: as pairs, or, where more than CROWD documents have a shingle
   among their rarest, in blocks that give out a forest of links.

Each step's links are contracted to the components known before it.  So no link between
different components is lost for the size of its bucket; a pair that shares no band, or whose
estimate lies SLACK deviations low against the only pivot, can be (about one in a million of
pairs at the threshold).

Cases: null text, or text without words, has an empty set, linked with nothing; with fewer
words than a shingle the whole sequence is the one shingle; repeated rows are one document
and each get its row; rows of one id with different texts are one document too, linked by
what any of its texts is linked with; a row without an id is counted, linked with nothing
and kept (its component is null); other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from . import kernels as K
from .common import Bitmap, discard, saved

REGISTERS = 256
MANTISSA = 10
#: Share of pairs exactly at the threshold that may share no band.
MISSED = 1e-5
#: Standard deviations that an estimate may lie below the threshold.
SLACK = 5.0
#: Members, and shingles, of a side of a block in the last step (one larger set is a side of its own).
BLOCK = 1024
BLOCK_SHINGLES = 1 << 18
#: Sets that have a shingle among their rarest; those of a shingle that more have meet in blocks, not in pairs.
CROWD = 256


def band_size(share: float) -> int:
    """Registers of a band for this similarity."""
    most = 1
    for r in range(2, 33):
        if REGISTERS // r * math.log1p(-(share**r)) <= math.log(MISSED):
            most = r
    return most


def shingle_sets(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all rows of word hashes, with their rows (in no order)."""
    gram, ok = K.grams(hashes, first, k)
    owner, n = K.rows_of(first), np.diff(first)
    short = np.flatnonzero((n > 0) & (n < k))
    whole = np.zeros(len(short), np.uint64)
    for j in range(k - 1):
        has = n[short] > j
        whole[has] = K.mix(whole[has] + hashes[first[short[has]] + j] + np.uint64(j + 1))
    rows = np.concatenate((owner[ok], short))
    values = np.concatenate((gram[ok], whole))
    _, once = np.unique(values ^ K.mix(rows.astype(np.uint64)), return_index=True)
    return values[once], rows[once]


def sketch(values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Registers (n by REGISTERS, uint16); 0: empty, else 1 + leading zeros * 2**MANTISSA + mantissa."""
    bits = REGISTERS.bit_length() - 1
    h = K.mix(values + np.uint64(0x632BE59BD9B4E019))
    least = np.full(n * REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, rows * REGISTERS + (h >> np.uint64(64 - bits)).astype(np.int64), h << np.uint64(bits) >> np.uint64(bits))
    full = np.flatnonzero(least != np.iinfo(np.uint64).max)
    least = least[full]
    width = 64 - bits
    top = np.zeros(len(least), np.int64)  # number of significant bits
    rest = least.copy()
    for s in (32, 16, 8, 4, 2, 1):
        big = rest >> np.uint64(s) > 0
        top[big] += s
        rest[big] >>= np.uint64(s)
    top += rest > 0
    down = np.maximum(top - 1 - MANTISSA, 0).astype(np.uint64)
    mantissa = (least >> down) & np.uint64((1 << MANTISSA) - 1)
    out = np.zeros(n * REGISTERS, np.uint16)
    out[full] = (1 + np.minimum(width - top, 50) * (1 << MANTISSA) + mantissa.astype(np.int64)).astype(np.uint16)
    return out.reshape(n, REGISTERS)


def band_keys(registers: np.ndarray, band: int) -> np.ndarray:
    """One key for each row and band; rows must have some register."""
    m = registers.shape[1]
    place = np.where(registers > 0, np.arange(m), 2 * m)
    place = np.minimum.accumulate(place[:, ::-1], axis=1)[:, ::-1]
    place = np.where(place < m, place, place[:, :1])  # past the last: the first of all
    full = np.take_along_axis(registers, np.minimum(place, m - 1), axis=1)[:, : m // band * band].astype(np.uint64)
    out = np.zeros((len(registers), m // band), np.uint64)
    for j in range(band):
        out = K.mix(out + full[:, j::band] + np.uint64(j + 1))
    return K.mix(out ^ K.mix(np.arange(m // band, dtype=np.uint64) + np.uint64(77)))


def estimate(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard estimate of each pair of sketches, corrected for chance agreement; registers it rests on."""
    used = (x > 0) | (y > 0)
    n = used.sum(axis=-1)
    same = ((x == y) & used).sum(axis=-1)
    edge = 2.0 ** -np.arange(0, 40)
    low, high = np.append(edge[1:], 0), edge
    cell = lambda size: np.exp(-np.outer(size / REGISTERS, low)) - np.exp(-np.outer(size / REGISTERS, high))
    chance = (cell(nx) * cell(ny)).sum(axis=1) / (1 << MANTISSA)
    some = np.maximum(n, 1)
    return (same / some - chance) / (1 - chance), n


def passes(x, y, nx, ny, share: float) -> np.ndarray:
    """Whether a pair can have the similarity: by estimate, with SLACK, and by sizes."""
    got, n = estimate(x, y, nx, ny)
    room = SLACK * np.sqrt(share * (1 - share) / np.maximum(n, 1))
    return (got >= share - room) & (np.minimum(nx, ny) >= share * np.maximum(nx, ny) - 1e-9)


def _registers(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def _row_sums(values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, np.uint64)
    np.add.at(out, rows, values)
    return out


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """(id, n, a, b, registers): size and 128-bit hash of the set, and its sketch (null for an empty set).  docs: (id, text)."""

    def run(batches):
        for batch in batches:
            for row, hashes, first in K.hashed_words(batch.column(1)):
                n = len(first) - 1
                values, rows = shingle_sets(hashes, first, k)
                size = np.bincount(rows, minlength=n)
                a, b = _row_sums(K.mix(values), rows, n), _row_sums(K.mix(values ^ np.uint64(0x9FB21C651E98DF25)), rows, n)
                raw = pa.array([r.tobytes() if s else None for r, s in zip(sketch(values, rows, n), size)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, n), pa.array(size), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), raw], ["id", "n", "a", "b", "registers"])

    return docs.mapInArrow(run, "id long, n long, a long, b long, registers binary")


def bands(reps: DataFrame, band: int, maybe: Bitmap | None = None) -> DataFrame:
    """(key, id): the band buckets of each class; with maybe, those whose keys it doesn't rule out."""

    def run(batches):
        for whole in batches:
            for i in range(0, len(whole), 2048):
                batch = whole.slice(i, 2048)
                keys = band_keys(_registers(batch.column(1)), band)
                ids = np.repeat(batch.column(0).to_numpy(), keys.shape[1])
                keys = keys.reshape(-1)
                keep = maybe.maybe(keys) if maybe else slice(None)
                yield pa.RecordBatch.from_arrays([pa.array(keys[keep].view(np.int64)), pa.array(ids[keep])], ["key", "id"])

    return reps.select("id", "registers").mapInArrow(run, "key long, id long")


def shared_buckets(reps: DataFrame, band: int) -> DataFrame:
    """(key, id) of the band buckets of two classes or more."""
    several = saved(bands(reps, band).groupBy("key").agg(F.count("*").alias("k")).where("k > 1").select("key"), "band-keys")
    maybe = Bitmap(several, "key")
    out = saved(bands(reps, band, maybe).join(several, "key", "left_semi"), "buckets")
    maybe.close()
    return out


def sifted(rows: DataFrame, wanted: Bitmap, *columns: str, others: bool = False) -> DataFrame:
    """The rows that the prefilter lets through by these columns, or the others; nothing is shuffled."""
    places = [rows.columns.index(c) for c in columns]

    def run(batches):
        for batch in batches:
            mask = wanted.maybe(*(batch.column(i).to_numpy() for i in places))
            yield batch.filter(pa.array(~mask if others else mask))

    return rows.mapInArrow(run, rows.schema)


def full_sets(docs: DataFrame, ids: DataFrame, repeated: DataFrame, k: int) -> DataFrame:
    """(id, s, n, set) of the documents with these ids, and of few others: their sets as sorted hashes; s tells sets of one id apart.

    docs: (id, text); repeated: the ids of several rows.  Sets are written where they are made;
    only those of repeated ids are shuffled, so that each is there once.
    """
    wanted = Bitmap(ids, "id")

    def run(batches):
        for batch in batches:
            batch = batch.filter(pa.array(wanted.maybe(batch.column(0).to_numpy())))
            for row, hashes, first in K.hashed_words(batch.column(1)):
                n = len(first) - 1
                values, rows = shingle_sets(hashes, first, k)
                values = values[np.lexsort((values, rows))]
                size = np.bincount(rows, minlength=n)
                own = K.mix(_row_sums(K.mix(values), np.sort(rows), n) ^ K.mix(batch.column(0).slice(row, n).to_numpy().view(np.uint64)))
                raw, cut = values.tobytes(), np.concatenate(([0], np.cumsum(8 * size))).tolist()
                sets = pa.array([raw[x:y] for x, y in zip(cut, cut[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, n), pa.array(own.view(np.int64)), pa.array(size), sets], ["id", "s", "n", "set"]).filter(pa.array(size > 0))

    made = saved(docs.mapInArrow(run, "id long, s long, n long, set binary"), "candidate-sets")
    wanted.close()
    if repeated.isEmpty():
        return made
    several = Bitmap(repeated, "id")
    once = sifted(made, several, "id").groupBy("id", "s").agg(F.first("n").alias("n"), F.first("set").alias("set"))
    out = saved(sifted(made, several, "id", others=True).unionByName(once), "candidate-sets")
    several.close()
    discard(made)
    return out


def _flat(column: pa.Array, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the sets one after another, and their rows."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64), np.repeat(np.arange(len(n)), n)


def _confirm(at_least: int, of: int):
    """(u, v) of rows whose sets reach the similarity at_least / of."""

    def run(batches):
        for whole in batches:
            for i in range(0, len(whole), 256):
                batch = whole.slice(i, 256)
                nx, ny = batch.column(2).to_numpy(), batch.column(3).to_numpy()
                (x, rx), (y, ry) = _flat(batch.column(4), nx), _flat(batch.column(5), ny)
                _, common, _ = np.intersect1d(x ^ K.mix(rx.astype(np.uint64)), y ^ K.mix(ry.astype(np.uint64)), assume_unique=True, return_indices=True)
                inter = np.bincount(rx[common], minlength=len(batch))
                yield batch.select([0, 1]).filter(pa.array((of * inter >= at_least * (nx + ny - inter)) & (inter > 0)))

    return run


def _promising(share: float):
    def run(batches):
        for whole in batches:
            for i in range(0, len(whole), 4096):
                batch = whole.slice(i, 4096)
                id_, pivot, u, v, nu, nv, x, y = batch.columns
                ok = passes(_registers(x), _registers(y), nu.to_numpy().astype(float), nv.to_numpy().astype(float), share)
                yield pa.RecordBatch.from_arrays([id_, pivot, u, v], ["id", "pivot", "u", "v"]).filter(pa.array(ok))

    return run


def links(pairs: DataFrame, reps: DataFrame, sets: DataFrame, at_least: int, of: int) -> DataFrame:
    """(u, v) of those rows (id, pivot, u, v) whose sets reach the similarity.  Only sketches and sets that a pair needs are shuffled."""
    used = []

    def beside(pairs: DataFrame, table: DataFrame, what: str) -> DataFrame:
        for end in ("pivot", "id"):
            used.append(Bitmap(pairs, end))
        for end, wanted in zip(("pivot", "id"), used[-2:]):
            table_of = sifted(table.select("id", "n", what), wanted, "id")
            pairs = pairs.join(table_of.select(F.col("id").alias(end), F.col("n").alias(f"n_{end}"), F.col(what).alias(f"{what}_{end}")), end)
        return pairs

    pairs = saved(pairs.select("id", "pivot", "u", "v"), "pairs")
    if pairs.isEmpty():
        return pairs.select("u", "v")
    seen = beside(pairs, reps, "registers").select("id", "pivot", "u", "v", "n_id", "n_pivot", "registers_id", "registers_pivot")
    likely = saved(seen.mapInArrow(_promising(at_least / of), "id long, pivot long, u long, v long"), "pairs")
    seen = beside(likely, sets, "set").select("u", "v", "n_id", "n_pivot", "set_id", "set_pivot")
    found = saved(seen.mapInArrow(_confirm(at_least, of), "u long, v long").distinct(), "links")
    for wanted in used:
        wanted.close()
    discard(pairs, likely)
    return found


def _shingles(batches):
    for batch in batches:
        s, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        values, rows = _flat(batch.column(2), n)
        yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(s[rows])], ["shingle", "s"])


def hopeful(sets: DataFrame, at_least: int, of: int) -> DataFrame:
    """Those of the sets, and few others, whose shingles found in another of them too are enough for the similarity."""
    alone = sets.select("s", "n", "set").mapInArrow(_shingles, "shingle long, s long").groupBy("shingle").agg(F.count("*").alias("k"), F.min("s").alias("s")).where("k = 1")
    alone = alone.groupBy("s").agg(F.count("*").alias("alone"))
    left = sets.select("s", "n").join(alone, "s", "left").where(of * (F.col("n") - F.coalesce("alone", F.lit(0))) >= at_least * F.col("n"))
    wanted = Bitmap(saved(left.select("s"), "hopeful"), "s")
    out = saved(sifted(sets, wanted, "s"), "open-sets")
    wanted.close()
    return out


def _meet(at_least: int, of: int):
    """Lists of (stray, component, n, set): links of strays and others that join components, as a forest."""

    def run(batches):
        for batch in batches:
            lists = batch.column(0)
            rows, cut = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            stray, comps, sizes, sets = (rows.field(i) for i in range(4))
            stray, comps, sizes = stray.to_numpy(zero_copy_only=False), comps.to_numpy(), sizes.to_numpy()
            us, vs = [], []
            for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist()):
                who = stray[lo:hi]
                if who.all() or not who.any():
                    continue
                n = sizes[lo:hi]
                names, root = np.unique(comps[lo:hi], return_inverse=True)
                values, _ = _flat(sets.slice(lo, hi - lo), n)
                distinct, number = np.unique(values, return_inverse=True)
                first = np.concatenate(([0], np.cumsum(n)))
                mine, others = np.flatnonzero(who), np.flatnonzero(~who)
                flat, starts = np.concatenate([number[first[j] : first[j + 1]] for j in others]), np.concatenate(([0], np.cumsum(n[others])[:-1]))
                mark = np.zeros(len(distinct), bool)
                for i in mine.tolist():
                    can = (root[others] != root[i]) & (of * np.minimum(n[others], n[i]) >= at_least * np.maximum(n[others], n[i]))
                    if not can.any():
                        continue
                    own = number[first[i] : first[i + 1]]
                    mark[own] = True
                    inter = np.add.reduceat(mark[flat], starts, dtype=np.int64)
                    mark[own] = False
                    hits = can & (of * inter >= at_least * (n[others] + n[i] - inter)) & (inter > 0)
                    for j in others[hits].tolist():
                        if (old := root[j]) != root[i]:
                            us.append(names[root[i]])
                            vs.append(names[old])
                            root[root == old] = root[i]
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    return run


def met(members: DataFrame, at_least: int, of: int) -> DataFrame:
    """(u, v): components linked by members (key, id, component, n, set) of one bucket, held against each other in blocks."""
    stray = F.col("component") != F.col("main")
    parts = lambda n, size: F.greatest(F.ceil(n / BLOCK), F.ceil(size / BLOCK_SHINGLES), F.lit(1))
    main = members.groupBy("key", "component").agg(F.count("*").alias("k"), F.sum("n").alias("size")).groupBy("key").agg(
        F.max_by("component", F.struct("k", "component")).alias("main"), F.max_by("k", F.struct("k", "component")).alias("k0"), F.max_by("size", F.struct("k", "component")).alias("size0"), F.sum("k").alias("k"), F.sum("size").alias("size")
    )
    main = main.where("k > k0").select("key", "main", parts(F.col("k") - F.col("k0"), F.col("size") - F.col("size0")).alias("ps"), parts(F.col("k"), F.col("size")).alias("qs"))
    each = members.join(main, "key")
    part = lambda many: F.pmod(F.xxhash64("id"), F.col(many))
    dealt = lambda many: F.explode(F.sequence(F.lit(0).cast("long"), F.col(many) - 1))
    one = ["key", "p", "q", "stray", "component", "n", "set"]
    strays = each.where(stray).withColumn("p", part("ps")).withColumn("q", dealt("qs")).withColumn("stray", F.lit(True)).select(one)
    others = each.withColumn("q", part("qs")).withColumn("p", dealt("ps")).withColumn("stray", F.lit(False)).select(one)
    blocks = strays.unionByName(others).groupBy("key", "p", "q").agg(F.collect_list(F.struct("stray", "component", "n", "set")).alias("members"))
    return blocks.select("members").mapInArrow(_meet(at_least, of), "u long, v long").distinct()


def prefixes(sets: DataFrame, at_least: int, of: int) -> DataFrame:
    """(key, id, n): for each set its rarest shingles, so many that two sets that reach the similarity have one of them in common.

    Of n shingles at_least * n / of must be common at least, so all but that many, and one more,
    suffice; shingles are ranked by how many of the sets have them, those in no other set left out.
    """
    each = saved(sets.select("s", "n", "set").mapInArrow(_shingles, "shingle long, s long"), "open-shingles")
    known = each.groupBy("shingle").agg(F.count("*").alias("k")).where("k > 1")
    ranked = each.join(known, "shingle").groupBy("s").agg(F.sort_array(F.collect_list(F.struct("k", "shingle"))).alias("all"))  # a set's own shingles
    room = F.col("n") - F.ceil(F.col("n") * at_least / of).cast("long") + 1 - (F.col("n") - F.size("all"))  # those left out are the rarest
    cut = ranked.join(sets.select("s", "id", "n"), "s").select("id", "n", F.slice("all", F.lit(1), F.greatest(room, F.lit(0)).cast("int")).alias("first"))
    return cut.select("id", "n", F.explode("first.shingle").alias("key")).distinct()


def open_links(sets: DataFrame, comps: DataFrame, reps: DataFrame, at_least: int, of: int) -> DataFrame:
    """(u, v): components linked by sets (id, s, n, set) that are left after the pivots.

    Sets meet where they share one of their rarest shingles (prefixes), as pairs of ids that
    sketches thin out before any set moves.  A shingle that is among the rarest of more than
    CROWD sets has its sets meet in blocks.
    """
    placed = saved(prefixes(sets, at_least, of).join(comps, "id"), "prefixes")
    keys = saved(placed.groupBy("key").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.count("*").alias("k")).where("c0 < c1").select("key", "k"), "prefix-keys")
    few = placed.join(keys.where(F.col("k") <= CROWD).select("key"), "key")
    a, b = (few.select("key", *(F.col(c).alias(f"{c}_{x}") for c in ("id", "n", "component"))) for x in "ab")
    fits = of * F.least("n_a", "n_b") >= at_least * F.greatest("n_a", "n_b")
    pairs = a.join(b, "key").where((F.col("id_a") < F.col("id_b")) & (F.col("component_a") != F.col("component_b")) & fits)
    pairs = pairs.groupBy(F.col("id_b").alias("id"), F.col("id_a").alias("pivot")).agg(F.first("component_b").alias("u"), F.first("component_a").alias("v"))
    crowded = placed.join(keys.where(F.col("k") > CROWD).select("key"), "key").select("key", "id", "component")
    return links(pairs, reps, sets, at_least, of).unionByName(met(crowded.join(sets.select("id", "n", "set"), "id"), at_least, of))


def mixed(placed: DataFrame, more_than: int) -> DataFrame:
    """Rows (key, id, component) of buckets with several components and more than so many members."""
    keys = placed.groupBy("key").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.count("*").alias("k")).where((F.col("c0") < F.col("c1")) & (F.col("k") > more_than)).select("key")
    return saved(placed.join(keys, "key", "left_semi"), "open-buckets")


def contracted(comps: DataFrame, found: DataFrame) -> DataFrame:
    """comps (id, component) after links (u, v) between components."""
    if found.isEmpty():
        return comps
    joined = connected_components(found).select(F.col("node").alias("component"), F.col("component").alias("now"))
    return saved(comps.join(joined, "component", "left").select("id", F.coalesce("now", "component").alias("component")), "components")


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, at_least: int = 80, of: int = 100) -> DataFrame:
    """Per document: id, n_shingles, component_id, kept (it is the smallest id of its component)."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sketched = saved(sketches(rows, k), "sketches")
    classes = sketched.where("n > 0 and id is not null").groupBy("a", "b").agg(F.min(F.struct("id", "n", "registers")).alias("least"))
    classes = saved(classes.select("a", "b", "least.*"), "classes")
    placed = saved(sketched.select("id", "n", "a", "b").join(classes.select("a", "b", F.col("id").alias("class")), ["a", "b"], "left").select("id", "n", F.when(F.col("id").isNotNull(), F.col("class")).alias("class")), "placed")

    discard(sketched)
    buckets = shared_buckets(classes, band_size(at_least / of))
    ids = saved(buckets.select("id").distinct(), "candidates")
    reps = saved(classes.select("id", "n", "registers").join(ids, "id", "left_semi"), "candidate-sketches")
    discard(classes)
    repeated = saved(placed.where("class is not null").groupBy("id").agg(F.count("*").alias("k")).where("k > 1").select("id"), "repeated")
    sets = full_sets(rows.where("id is not null"), ids, repeated, k)

    # classes that share an id are one document
    several_texts = placed.where("class is not null").groupBy("id").agg(F.min("class").alias("u"), F.max("class").alias("v")).where("u < v").select("id")
    found = placed.join(several_texts, "id").select(F.col("id").alias("u"), F.col("class").alias("v"))

    comps, now = None, buckets.withColumn("component", F.col("id"))
    for turn in range(2):
        order = F.col("id") if turn == 0 else F.xxhash64("id", "key")
        pivots = now.groupBy("key").agg(F.min_by(F.struct("id", "component"), order).alias("pivot"))
        pairs = now.join(pivots, "key").where(F.col("component") != F.col("pivot.component")).select("id", F.col("component").alias("u"), F.col("pivot.component").alias("v"), F.col("pivot.id").alias("pivot"))
        pairs = pairs.groupBy("id", "u", "v").agg(F.min("pivot").alias("pivot"))
        more = links(pairs, reps, sets, at_least, of)
        more = saved(more.unionByName(found) if turn == 0 else more, "links")
        if turn == 0:
            every = ids.union(found.select("u")).union(found.select("v")).distinct()
            comps = every.select("id", F.col("id").alias("component"))
        comps = contracted(comps, more)
        now = mixed(buckets.join(comps, "id").select("key", "id", "component"), 2)
    still = saved(now.select("id").distinct(), "open-ids")
    wanted = Bitmap(still, "id")
    near = saved(sifted(sets, wanted, "id"), "near-sets")
    wanted.close()
    discard(sets)
    open_sets = hopeful(near, at_least, of)
    discard(near)
    comps = contracted(comps, saved(open_links(open_sets, comps, reps, at_least, of), "links"))
    discard(reps, open_sets, buckets)

    out = placed.join(comps.select(F.col("id").alias("class"), "component"), "class", "left")
    component = F.when(F.col("class").isNotNull(), F.coalesce("component", "class")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))
