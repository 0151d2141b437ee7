"""Operator 5: removing repeated byte strings by distributed prefix doubling over blocks of suffixes.

Every byte position whose next THRESHOLD bytes lie in its text is a suffix to be ranked.
Suffixes are ranked in blocks: a run of positions with the same anchor (the least
GRAM-gram of the first THRESHOLD bytes), cut at fixed offsets from it.  All suffixes of a
block share a core; its rank is the least place of an equal core.  Rounds go over shorter
and shorter blocks (STEPS positions at most), whose cores are longer and longer.  In each,
Spark groups (core, span) pairs, where the span is all bytes of a block's strings:

* a core found once: no string of the block is repeated; the block is out;
* a span found twice: all its strings are repeated; all its blocks are settled;
* else the block is cut, and the cores grow, until blocks are single positions and the core
  is the whole string of THRESHOLD bytes.

So ranks are refined at growing lengths until unique or past the threshold, as in plain
prefix doubling, but a row stands for up to some hundred positions that agree so far.
Ranking all positions one by one would shuffle some 50 times the input.

Spans are known by hashes up to here; before anything is removed the bytes themselves are
digested, and a run of positions whose digest no other has stays.

Bit maps of fixed size leave out what surely doesn't matter; nothing else is broadcast.
Texts longer than a slice are read in pieces that overlap by THRESHOLD - 1 bytes, so a task's
arrays have the size of a slice however long a text is.

Cases: null text is empty; texts of less than THRESHOLD bytes stay whole; equal rows count
as different places, so each of them loses what the other has; rows of one id are told apart
by a hash of their text; rows without an id stay whole and match nothing; other columns are
passed by.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import Bitmap, discard, saved

THRESHOLD = 400
GRAM = 40
#: Positions of a block at most, round by round; the first takes all positions of an anchor.
STEPS = (512, 32, 4, 1)


class Blocks:
    """The blocks of a piece: first position (one of its own bytes), number of positions, row; and the hashes of their cores and spans."""

    def __init__(self, data: np.ndarray, at: np.ndarray, own: int, threshold: int, gram: int):
        self.threshold, self.gram, self.at, n = threshold, gram, at, len(data)
        self.sums = K.prefix_sums(data)
        self.places = np.zeros(0, np.int64)
        if n < threshold:
            return
        keys = K.sliding_hashes(self.sums, gram)
        anchor = K.minimizers(keys, threshold - gram + 1)
        room = np.repeat(at[1:], np.diff(at))[: n - threshold + 1]
        self.places = np.flatnonzero((np.arange(threshold, n + 1) <= room)[:own])
        self.anchor = anchor[self.places]

    def cut(self, step: int):
        places, anchor = self.places, self.anchor if len(self.places) else self.places
        if not len(places):
            return places, places, places, places.view(np.uint64), places.view(np.uint64)
        part = (anchor - places) // step
        new = np.ones(len(places), bool)
        new[1:] = (part[1:] != part[:-1]) | (anchor[1:] != anchor[:-1]) | (places[1:] != places[:-1] + 1)
        head = np.flatnonzero(new)
        size = np.diff(np.append(head, len(places)))
        start, a, low = places[head], anchor[head], part[head] * step
        high = np.minimum(low + step - 1, self.threshold - 1)
        # the core lies in all strings of the whole block; with the widest blocks it may be no more than the anchor
        end = np.maximum(a - high + self.threshold, a + 1)
        core = K.range_hashes(self.sums, a - low, np.maximum(end, a - low + 1)) if step < self.threshold else K.range_hashes(self.sums, a, a + self.gram)
        core = K.mix(core ^ K.mix(low.astype(np.uint64)))
        span = K.mix(K.range_hashes(self.sums, start, start + size + self.threshold - 1) ^ K.mix((a - start).astype(np.uint64)))
        return start, size, np.searchsorted(self.at, start, side="right") - 1, core, span


ROWS = "core long, span long, id long, copy long, start long, n int"


def _blocks(docs: DataFrame, threshold: int, gram: int, step: int, parent: int = 0, chosen: Bitmap | None = None, ids_with: Bitmap | None = None, cores: Bitmap | None = None, spans: Bitmap | None = None) -> DataFrame:
    """The blocks of one round as ROWS; with chosen, those inside chosen blocks of the round before; with cores or spans, those of such cores or spans.  docs: (id, copy, text)."""

    def run(batches):
        for batch in batches:
            if ids_with is not None:
                batch = batch.filter(pa.array(ids_with.maybe(batch.column(0).to_numpy(), batch.column(1).to_numpy())))
            ids, copies = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for row, base, data, at, own in K.pieces(batch.column(2), threshold - 1):
                blocks = Blocks(data, at, own, threshold, gram)
                if chosen is not None:
                    start, size, rows, _, _ = blocks.cut(parent)
                    keep = np.repeat(chosen.maybe(ids[row + rows], copies[row + rows], base + start - at[rows]), size)
                    blocks.places = blocks.places[keep]
                    blocks.anchor = blocks.anchor[keep] if len(keep) else keep
                start, size, rows, core, span = blocks.cut(step)
                for wanted in (cores, spans):
                    if wanted is None:
                        continue
                    keep = wanted.maybe(core if wanted is cores else span)
                    start, size, rows, core, span = start[keep], size[keep], rows[keep], core[keep], span[keep]
                columns = [pa.array(core.view(np.int64)), pa.array(span.view(np.int64)), pa.array(ids[row + rows]), pa.array(copies[row + rows]), pa.array(base + start - at[rows]), pa.array(size.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["core", "span", "id", "copy", "start", "n"])

    return docs.mapInArrow(run, ROWS)


def repeated_strings(docs: DataFrame, threshold: int = THRESHOLD, gram: int = GRAM, steps=STEPS) -> DataFrame:
    """(span, id, copy, start, n): runs of positions whose string is found elsewhere too, and the hash of their bytes.  docs: (id, copy, text)."""
    settled, chosen, ids_with, several, before = None, None, None, None, 0
    for step in steps:
        last = step == steps[-1]
        if before == 0:  # texts are read again rather than their many blocks written
            several = Bitmap(saved(_blocks(docs, threshold, gram, step).groupBy("core").agg(F.count("*").alias("k")).where("k > 1").select("core"), "suffix-several"), "core")
        rows = _blocks(docs, threshold, gram, step, before, chosen, ids_with, several)
        if last:  # nothing is cut finer after this: counts are enough
            twice = saved(rows.groupBy("span").agg(F.count("*").alias("k")).where("k > 1").select("span"), "suffix-twice")
        else:
            spans = rows.groupBy("span").agg(F.count("*").alias("k"), F.min("core").alias("core"), F.min(F.struct("id", "copy", "start")).alias("rank"))
            spans = saved(spans, "suffix-ranks")
            twice = spans.where("k > 1").select("span")
        hits = Bitmap(twice, "span")
        more = _blocks(docs, threshold, gram, step, before, chosen, ids_with, several, hits)
        more = saved(more.select("span", "id", "copy", "start", "n").join(twice, "span", "left_semi"), "suffix-settled")
        settled = more if settled is None else settled.unionByName(more)
        for used in (hits, several, chosen, ids_with):
            if used is not None:
                used.close()
        several = None
        if last:
            break
        # written by itself, so that a core of many spans can be split in the join
        cores = saved(spans.groupBy("core").agg(F.count("*").alias("spans")).where("spans > 1").select("core"), "suffix-cores")
        open_ = saved(spans.join(cores, "core", "left_semi").select("rank.*"), "suffix-open")
        discard(spans, cores)
        chosen, ids_with, before = Bitmap(open_, "id", "copy", "start"), Bitmap(open_.select("id", "copy").distinct(), "id", "copy"), step
    return settled


def _digests(threshold: int):
    """(span, digest, id, copy, start, n) of each run of positions of documents (id, copy, text, spans)."""

    def run(batches):
        for batch in batches:
            ids, copies, texts, spans = batch.columns
            for row, data, at in K.slices(texts):
                mine = spans.slice(row, len(at) - 1)
                flat, owner = mine.flatten(), np.repeat(np.arange(len(mine)), np.diff(mine.offsets.to_numpy()))
                begin = at[owner] + flat.field("start").to_numpy()
                end = begin + flat.field("n").to_numpy() + threshold - 1
                raw = b"".join(hashlib.blake2b(data[a:b], digest_size=8).digest() for a, b in zip(begin.tolist(), end.tolist()))
                raw = pa.array(np.frombuffer(raw, np.int64))
                where = pa.array(row + owner)
                yield pa.RecordBatch.from_arrays([flat.field("span"), raw, ids.take(where), copies.take(where), flat.field("start"), flat.field("n")], ["span", "digest", "id", "copy", "start", "n"])

    return run


def unlike(work: DataFrame, threshold: int) -> DataFrame:
    """(id, copy, start, n) of runs of positions whose bytes no other run of their span has.  work: (id, copy, text, spans)."""
    each = work.mapInArrow(_digests(threshold), "span long, digest long, id long, copy long, start long, n int")
    alone = saved(each.groupBy("span", "digest").agg(F.count("*").alias("k")).where("k = 1").drop("k"), "suffix-alone")
    if alone.isEmpty():
        return each.limit(0).select("id", "copy", "start", "n")
    return each.join(alone, ["span", "digest"], "left_semi").select("id", "copy", "start", "n")


SCHEMA = "id long, n_bytes long, n_removed long, n_spans long, kept binary"


def _merged(start: np.ndarray, end: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs that the ranges of each row make up."""
    order = np.lexsort((start, row))
    start, end, row = start[order], np.maximum.accumulate(end[order]), row[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] > end[:-1]) | (row[1:] != row[:-1])
    last = np.append(new[1:], True)[: len(new)]  # no ranges, no runs
    return start[new], end[last], row[new]


def _remove(threshold: int):
    """Without the bytes of the spans."""

    def run(batches):
        for batch in batches:
            ids, texts, spans = batch.columns
            for row, data, at in K.slices(texts):
                mine = spans.slice(row, len(at) - 1).fill_null([])
                flat, owner = mine.flatten(), np.repeat(np.arange(len(mine)), np.diff(mine.offsets.to_numpy()))
                begin = at[owner] + flat.field("start").to_numpy()
                low, high, owner = _merged(begin, begin + flat.field("n").to_numpy() + threshold - 1, owner)
                n, kept, cut = np.diff(at), [], np.searchsorted(owner, np.arange(len(at)))
                for r, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
                    edges = [a, *np.stack([low[cut[r] : cut[r + 1]], high[cut[r] : cut[r + 1]]], axis=1).ravel().tolist(), b]
                    kept.append(b"".join(data[x:y].tobytes() for x, y in zip(edges[::2], edges[1::2])))
                removed = np.bincount(owner, high - low, len(n)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([ids.slice(row, len(n)), pa.array(n), pa.array(removed), pa.array(np.diff(cut)), pa.array(kept, pa.binary())], ["id", "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def _whole(docs: DataFrame) -> DataFrame:
    """SCHEMA rows of documents that lose nothing, without Python."""
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return docs.select("id", F.octet_length(raw).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), raw.alias("kept"))


def remove_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD, gram: int = GRAM, steps=STEPS) -> DataFrame:
    """Per document: id, n_bytes, n_removed, n_spans, and kept, its bytes without the repeated strings."""
    every = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("copy"), F.col(text_col).alias("text"))
    rows = every.where("id is not null")
    settled = repeated_strings(rows, threshold, gram, steps)
    lists = saved(settled.groupBy("id", "copy").agg(F.collect_set(F.struct("start", "n", "span")).alias("spans")), "suffix-lists")
    maybe = Bitmap(lists, "id", "copy")

    def split(hit):
        def run(batches):
            for batch in batches:
                mask = maybe.maybe(batch.column(0).to_numpy(), batch.column(1).to_numpy())
                yield batch.filter(pa.array(mask if hit else ~mask))

        return rows.mapInArrow(run, rows.schema)

    work = saved(split(True).join(lists, ["id", "copy"], "left"), "suffix-texts")
    wrong = saved(unlike(work.where("spans is not null").select("id", "copy", "text", "spans"), threshold), "suffix-wrong")
    some = work.select("id", "copy", "text", "spans")
    if not wrong.isEmpty():
        bad = wrong.groupBy("id", "copy").agg(F.collect_set(F.struct("start", "n")).alias("bad"))
        good = F.filter("spans", lambda s: ~F.coalesce(F.array_contains("bad", F.struct(s["start"].alias("start"), s["n"].alias("n"))), F.lit(False)))
        some = some.join(bad, ["id", "copy"], "left").select("id", "copy", "text", good.alias("spans"))
    out = _whole(split(False)).unionByName(_whole(every.where("id is null"))).unionByName(some.select("id", "text", "spans").mapInArrow(_remove(threshold), SCHEMA))
    return out.withColumnRenamed("id", id_col)
