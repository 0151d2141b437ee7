"""Operator 2: removing repeated word passages by compacting a De Bruijn graph.

An edge of the graph is a window of WINDOW words.  Consecutive windows with the same least
ANCHOR-gram (their anchor) form a segment; equal windows lie in segments of equal anchor, so
anchors seen in one document alone need no further look.

1. ``shared_anchors``: anchors found in two documents or more, by one aggregation.
2. ``segments``: a second scan gives the segments at shared anchors, with the segment that
   follows and the one that precedes in the text.
3. ``paths``: equal segments become one edge of the compacted graph, at its source (least
   document and place); a Spark join of edges with their only successors finds nonbranching
   paths, and the occurrences of a path's first edge stand for the whole path.
4. ``lone_windows``: where segments of equal anchor differ, their windows are compared one by
   one in a third scan; each repeated one is a path of its own.
5. ``verify``: words at the coordinates of each span are held against those at its source.

Nothing is broadcast but fixed-size bit maps, which leave out what surely doesn't matter.
Texts longer than a slice are read in pieces cut between words, so a task's arrays have the
size of a slice (and of the longest word) however long a text is.

Cases: null or short texts lose nothing; a document that repeats itself loses nothing for
that; rows without an id lose nothing and are nobody's source; repeated rows are treated
alike; rows of one id with different texts are one document, each row with its own spans;
other columns are passed by.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .common import Bitmap, saved

WINDOW = 13
ANCHOR = 5


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _ints(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.int32))


def _batch(columns, schema: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in schema.split(", ")])


class _Windows:
    """The windows that start in the own bytes of a piece, and their segments: first window, windows, row, anchor and content hash."""

    def __init__(self, data, at, own, window, anchor):
        start, end, self.first = K.words(data, at)
        hashes = K.word_hashes(data, start, end)
        self.gram, ok = K.grams(hashes, self.first, window)
        places = np.flatnonzero(ok & (start < own))
        self.begin = self.size = self.rows = np.zeros(0, np.int64)
        self.anchors = self.content = np.zeros(0, np.uint64)
        if len(places):
            anchors, _ = K.grams(hashes, self.first, anchor, seed=1)
            place = K.minimizers(anchors, window - anchor + 1)
            new = np.ones(len(places), bool)
            new[1:] = (place[places[1:]] != place[places[:-1]]) | (places[1:] != places[:-1] + 1)
            head = np.flatnonzero(new)
            self.size = np.diff(np.append(head, len(places)))
            inside = np.arange(len(places)) - np.repeat(head, self.size)
            self.content = K.mix(np.add.reduceat(self.gram[places] * K.powers(int(self.size.max()), 2)[inside], head) ^ self.size.astype(np.uint64))
            self.begin = places[head]
            self.rows, self.anchors = np.searchsorted(self.first, self.begin, side="right") - 1, anchors[place[self.begin]]


def shared_anchors(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """(anchor): found in two documents or more.  docs: (id, copy, text)."""
    schema = "anchor long, low long, high long"

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for row, _, data, at, own in K.word_pieces(batch.column(2), window - 1):
                w = _Windows(data, at, own, window, anchor)
                order = np.argsort(w.anchors, kind="stable")
                key, owner = w.anchors[order], ids[row + w.rows][order]
                head = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
                low, high = (np.minimum.reduceat(owner, head), np.maximum.reduceat(owner, head)) if len(key) else (owner, owner)
                yield _batch([_signed(key[head]), pa.array(low), pa.array(high)], schema)

    return docs.mapInArrow(run, schema).groupBy("anchor").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low < high").select("anchor")


def segments(docs: DataFrame, maybe: Bitmap, window: int, anchor: int) -> DataFrame:
    """(edge, anchor, id, copy, start, n, next, before) of segments at shared anchors; next and before: edges beside it, 0 for none."""
    schema = "edge long, anchor long, id long, copy long, start int, n int, next long, before long"

    def run(batches):
        zero = np.zeros(1, np.uint64)
        for batch in batches:
            ids, copies = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for row, base, data, at, own in K.word_pieces(batch.column(2), window - 1):
                w = _Windows(data, at, own, window, anchor)
                keep = maybe.maybe(w.anchors)
                begin, size, rows, anchors, content = (x[keep] for x in (w.begin, w.size, w.rows, w.anchors, w.content))
                beside = (begin[1:] == begin[:-1] + size[:-1]) & (rows[1:] == rows[:-1])
                following = np.concatenate((np.where(beside, content[1:], 0), zero)) if len(begin) else content
                before = np.concatenate((zero, np.where(beside, content[:-1], 0))) if len(begin) else content
                yield _batch([_signed(content), _signed(anchors), pa.array(ids[row + rows]), pa.array(copies[row + rows]), _ints(base + begin - w.first[rows]), _ints(size), _signed(following), _signed(before)], schema)

    return docs.mapInArrow(run, schema)


def edges(found: DataFrame) -> DataFrame:
    """One row for each edge of the compacted graph: its source, its last document and its only neighbours (null: none or several)."""
    each = found.groupBy("edge").agg(
        F.min(F.struct("id", "copy", "start")).alias("source"), F.max("id").alias("last"), F.min("anchor").alias("anchor"), F.min("n").alias("n"),
        F.min("next").alias("n0"), F.max("next").alias("n1"), F.min("before").alias("b0"), F.max("before").alias("b1"),
    )
    only = lambda a, b: F.when((F.col(a) == F.col(b)) & (F.col(a) != 0), F.col(a))
    source = [F.col(f"source.{a}").alias(b) for a, b in (("id", "src"), ("copy", "src_copy"), ("start", "src_start"))]
    return each.select("edge", "anchor", "n", "last", *source, only("n0", "n1").alias("next"), only("b0", "b1").alias("before"))


def paths(edge_table: DataFrame) -> DataFrame:
    """Nonbranching paths of repeated edges: (head, src, src_copy, src_start, windows)."""
    repeated = edge_table.where("last > src")
    ahead = repeated.where("next is not null").select(F.col("edge").alias("p_edge"), F.col("next").alias("p_next"))
    linked = repeated.join(ahead, (F.col("edge") == F.col("p_next")) & (F.col("before") == F.col("p_edge")), "left").withColumn("breaks", F.col("p_edge").isNull().cast("int"))
    by = Window.partitionBy("src", "src_copy").orderBy("src_start")
    numbered = linked.withColumn("path", F.sum("breaks").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("src", "src_copy", "path").agg(F.min_by("edge", "src_start").alias("head"), F.min("src_start").alias("src_start"), F.sum("n").alias("windows")).drop("path")


#: A span of words, and the place in a smaller document that has the same words.
SPAN = "id long, copy long, start int, size int, src long, src_copy long, src_start int"
_NAMES = [x.split()[0] for x in SPAN.split(", ")]


def lone_windows(docs: DataFrame, edge_table: DataFrame, window: int, anchor: int) -> DataFrame:
    """SPAN rows: windows in the source segments of differing edges of one anchor that a smaller document has too."""
    several = edge_table.groupBy("anchor").agg(F.count("*").alias("k")).where("k > 1").select("anchor")
    maybe = Bitmap(edge_table.join(several, "anchor", "left_semi"), "edge", "src")
    schema = "window long, id long, copy long, start int"

    def run(batches):
        for batch in batches:
            ids, copies = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for row, base, data, at, own in K.word_pieces(batch.column(2), window - 1):
                w = _Windows(data, at, own, window, anchor)
                keep = maybe.maybe(w.content, ids[row + w.rows])
                places = K.spread(w.begin[keep], w.size[keep])
                rows = np.repeat(w.rows[keep], w.size[keep])
                yield _batch([_signed(w.gram[places]), pa.array(ids[row + rows]), pa.array(copies[row + rows]), _ints(base + places - w.first[rows])], schema)

    found = docs.mapInArrow(run, schema)
    firsts = found.groupBy("window").agg(F.min(F.struct("id", "copy", "start")).alias("f"), F.max("id").alias("high")).where("f.id < high")
    firsts = firsts.select("window", F.col("f.id").alias("src"), F.col("f.copy").alias("src_copy"), F.col("f.start").alias("src_start"))
    out = saved(found.join(firsts, "window").where("id > src").select("id", "copy", "start", F.lit(window).alias("size"), "src", "src_copy", "src_start"), "lone-windows")
    maybe.close()
    return out


def repeated_spans(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """SPAN rows: what a smaller document has too, by hashes."""
    maybe = Bitmap(saved(shared_anchors(docs, window, anchor), "anchors"), "anchor")
    found = segments(docs, maybe, window, anchor)
    edge_table = saved(edges(found), "edges")
    ways = saved(paths(edge_table), "paths")
    whole = found.select("edge", "id", "copy", "start").join(ways, F.col("edge") == F.col("head")).where("id > src")
    whole = saved(whole.withColumn("size", (F.col("windows") + window - 1).cast("int")).select(_NAMES), "long-spans")
    maybe.close()
    return whole.unionByName(lone_windows(docs, edge_table, window, anchor))


def _spans_by_piece(batch: pa.RecordBatch):
    """(row, words of it before the piece, its words in this piece, the piece's words, its first word there, its spans as an array of starts and sizes, the spans)."""
    ids, texts, spans = (batch.column(batch.schema.get_field_index(c)) for c in ("id", "text", "spans"))
    for row, base, data, at, own in K.word_pieces(texts):
        start, end, first = K.words(data, at)
        raw, off = K.joined(data, start, end)
        for r in range(len(at) - 1):
            yield row + r, base, int(first[r + 1] - first[r]), raw, off, int(first[r]), spans[row + r].values


def _parts(values: pa.StructArray, base: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the spans that reach into words base:base+n: their numbers, and their first and last word there, counted from base."""
    if values is None or not len(values):
        return (np.zeros(0, np.int64),) * 3
    start, size = values.field("start").to_numpy().astype(np.int64), values.field("size").to_numpy().astype(np.int64)
    low, high = np.maximum(start, base) - base, np.minimum(start + size, base + n) - base
    mine = np.flatnonzero(low < high)
    return mine, low[mine], high[mine]


DIGEST = f"{SPAN}, digest binary"


def _digests(batches):
    """DIGEST rows: a digest of the words of each span."""
    for batch in batches:
        held: dict[tuple[int, int], object] = {}
        for row, base, n, raw, off, first, values in _spans_by_piece(batch):
            for k, a, b in zip(*(x.tolist() for x in _parts(values, base, n))):
                if (row, k) not in held:
                    held[row, k] = hashlib.blake2b(digest_size=16)
                held[row, k].update(raw[off[first + a] : off[first + b]])
        for i in range(0, len(keys := list(held)), 65536):
            ids, copies, spans = (batch.column(batch.schema.get_field_index(c)) for c in ("id", "copy", "spans"))
            part = keys[i : i + 65536]
            rows = pa.array([r for r, _ in part], pa.int64())
            flat, at = spans.flatten(), spans.offsets.to_numpy()
            which = flat.take(pa.array([int(at[r] - at[0]) + k for r, k in part], pa.int64()))
            yield _batch([ids.take(rows), copies.take(rows), *(which.field(c) for c in _NAMES[2:]), pa.array([held[k].digest() for k in part], pa.binary())], DIGEST)


def verify(work: DataFrame) -> DataFrame:
    """(id, copy, start, src, src_copy, src_start) of spans whose words are not those at their source.  work: (id, copy, text, spans)."""
    each = work.mapInArrow(_digests, DIGEST)
    home = "id = src and copy = src_copy and start = src_start"
    at_source = each.where(home).select("src", "src_copy", "src_start", "size", F.col("digest").alias("_digest")).distinct()
    copies = each.where(f"not ({home})").distinct()
    return copies.join(at_source, ["src", "src_copy", "src_start", "size"]).where("digest <> _digest").select("id", "copy", "start", "src", "src_copy", "src_start")


SCHEMA = "id long, n_words long, n_removed long, kept string"


def _remove(batches):
    """Without the words of the spans; kept words joined by one space."""
    for batch in batches:
        n_rows = batch.num_rows
        many, removed, kept = np.zeros(n_rows, np.int64), np.zeros(n_rows, np.int64), [[] for _ in range(n_rows)]
        for row, base, n, raw, off, first, values in _spans_by_piece(batch):
            _, low, high = _parts(values, base, n)
            step = np.zeros(n + 1, np.int64)
            np.add.at(step, low, 1)
            np.add.at(step, high, -1)
            gone = np.cumsum(step[:-1]) > 0
            many[row] += n
            removed[row] += int(gone.sum())
            mine = raw[off[first] : off[first + n]]
            kept[row].append((mine[~np.repeat(gone, np.diff(off[first : first + n + 1]))] if gone.any() else mine).tobytes())
        yield _batch([batch.column(0), pa.array(many), pa.array(removed), pa.array([b"".join(x)[:-1] for x in kept], pa.binary()).cast(pa.string())], SCHEMA)


def _whole(docs: DataFrame) -> DataFrame:
    """SCHEMA rows of documents that lose nothing, without Python."""
    kept = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " "))
    n = F.when(F.col("kept") == "", 0).otherwise(F.char_length("kept") - F.char_length(F.replace("kept", F.lit(" "), F.lit(""))) + 1)
    return docs.select("id", kept.alias("kept")).select("id", n.cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), "kept")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """Per document: id, n_words, n_removed, and kept, its words without the repeated ones, joined by one space."""
    every = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("copy"), F.col(text_col).alias("text"))
    rows = every.where("id is not null")
    spans = repeated_spans(rows, window, anchor)
    # each source carries its own span too, so that verify() meets its words
    home = [F.col("src").alias("id"), F.col("src_copy").alias("copy"), F.col("src_start").alias("start"), "size", "src", "src_copy", "src_start"]
    lists = spans.unionByName(spans.select(home)).distinct().groupBy("id", "copy").agg(F.collect_list(F.struct(_NAMES[2:])).alias("spans"))
    lists = saved(lists, "span-lists")
    maybe = Bitmap(lists, "id", "copy")

    def split(hit: bool) -> DataFrame:
        def run(batches):
            for batch in batches:
                mask = maybe.maybe(batch.column(0).to_numpy(), batch.column(1).to_numpy())
                yield batch.filter(pa.array(mask if hit else ~mask))

        return rows.mapInArrow(run, rows.schema)

    work = saved(split(True).join(lists, ["id", "copy"], "left").select("id", "copy", "text", "spans"), "span-texts")
    wrong = saved(verify(work.where("spans is not null")), "wrong-spans")
    mine = F.filter("spans", lambda s: (s["src"] != F.col("id")) | (s["src_copy"] != F.col("copy")) | (s["src_start"] != s["start"]))
    some = work.select("id", "copy", "text", mine.alias("spans"))
    if not wrong.isEmpty():
        key = ["start", "src", "src_copy", "src_start"]
        bad = wrong.groupBy("id", "copy").agg(F.collect_set(F.struct(key)).alias("bad"))
        good = F.filter("spans", lambda s: ~F.coalesce(F.array_contains("bad", F.struct(*(s[c].alias(c) for c in key))), F.lit(False)))
        some = some.join(bad, ["id", "copy"], "left").select("id", "copy", "text", good.alias("spans"))
    out = _whole(split(False)).unionByName(_whole(every.where("id is null"))).unionByName(some.mapInArrow(_remove, SCHEMA))
    return out.withColumnRenamed("id", id_col)
