"""Operator 3: benchmark decontamination by CGK embedding and bit-sampling LSH.

Words are runs of ASCII letters, digits and non-ASCII bytes, A-Z in lower case; each character
of a script written without blanks (Chinese, Japanese, Thai and their neighbours) is a word.
The CGK random walk reads a sequence of words: at each step it puts out the word it stands on
and goes on by one or not, by a random bit of that word and step.  Two sequences of small edit
distance walk together for long stretches, so their outputs differ in few places.  An LSH
table keeps SAMPLED places of the walk; WALKS * TABLES of them (for short items twice as many)
give every pair many chances.

Document windows start at every STRIDE-th word (for the shortest items at every word); a walk
is as long as a window of the items' size class, three quarters of the item, and items are
embedded from every offset that leaves room for it.  So each copy of an item is met by several
windows that start at the very word of an embedded offset; an unchanged copy always is.  What
a table brings up is checked by the exact edit distance of the whole item to the best fitting
run of words of the document (substitutions, insertions and deletions of words): EDITS of the
item's words at most.

Items of equal words are one; their ids are joined to the matches.  Items go out in blocks of
at most BLOCK_WORDS words, each block against all documents.

Cases: null or empty texts have no match; items without a word match nothing; equal items
each have their rows; rows without an id are left out, since a match couldn't name them;
equal document rows, and rows of one id, are reported once; texts longer than a slice are
read in pieces that overlap by twice the longest item; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import saved

STRIDE = 4
WALKS = 2
TABLES = 4
SAMPLED = 4
#: Classes of so many words at most, whose items have few windows without an edit, get twice the tables.
SHORT = 12
#: Share of an item's words that may be edited.
EDITS = 0.2
BLOCK_WORDS = 2_000_000
_INK = np.zeros(256, bool)
_INK[48:58] = _INK[65:91] = _INK[97:123] = _INK[128:] = True
#: Bytes of a character of a script without blanks, by its first byte: U+3000 to U+9FFF and U+20000 on; and with _THAI by its first two.
_SOLO = np.zeros(256, np.int64)
_SOLO[0xE3:0xEA], _SOLO[0xF0] = 3, 4
#: Thai and Lao, Tibetan and Myanmar, Khmer: first bytes E0 B8-BB, E0 BC-BF, E1 80-82, E1 9E-9F.
_THAI = np.zeros(1 << 16, bool)
_THAI[0xE0B8:0xE0C0] = _THAI[0xE180:0xE183] = _THAI[0xE19E:0xE1A0] = True


def item_words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all rows and the first word of each."""
    start, end = item_places(data, at)
    return K.word_hashes(K.LOWER[data], start, end), np.searchsorted(start, at)


def item_places(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word."""
    size = _SOLO[data]
    if len(data) > 1 and data.max(initial=0) >= 0xE0:
        lead = np.flatnonzero((data[:-1] == 0xE0) | (data[:-1] == 0xE1))
        size[lead[_THAI[data[lead].astype(np.int64) << 8 | data[lead + 1]]]] = 3
    solo = np.flatnonzero(size)
    edges = at[at <= len(data)]
    if len(solo):
        edges = np.unique(np.concatenate((edges, solo, np.minimum(solo + size[solo], len(data)))))
    return K.runs(_INK[data], edges)


def size_class(n: int) -> int:
    """Window length for an item of n words: the largest of 1, 2, 3, 5, 8, 12, 18, … that leaves STRIDE offsets at least."""
    most, size = max(1, min(n - STRIDE + 1, n * 3 // 4)), 1
    while (bigger := max(size + 1, size * 3 // 2)) <= most:
        size = bigger
    return size


def plan(classes: list[int], seed: int = 5) -> list[tuple[int, int, int, tuple[int, ...]]]:
    """(class, walk, table, sampled steps)."""
    out = []
    for c in classes:
        for w in range(WALKS):
            for t in range(TABLES * (2 if c <= SHORT else 1)):
                rng = np.random.default_rng((seed, c, w, t))
                # a step of each part of the walk; every other table keeps to its first half, where less has drifted
                far = 2 * c if t % 2 == 0 and c >= SAMPLED else c
                edges = np.linspace(0, far, min(SAMPLED, far) + 1).astype(int)
                out.append((c, w, t, tuple(int(rng.integers(a, b)) for a, b in zip(edges, edges[1:]))))
    return out


def signatures(words: np.ndarray, starts: np.ndarray, tables) -> Iterator[tuple[int, np.ndarray]]:
    """(number of the table, its key for each start).  words must go on beyond the last start by the longest walk."""
    for walk in range(WALKS):
        mine = [(i, c, steps) for i, (c, w, _, steps) in enumerate(tables) if w == walk]
        if not mine:
            continue
        keys = {i: np.full(len(starts), np.uint64(i + 1)) for i, _, _ in mine}
        at = starts.copy()
        for step in range(max(s[-1] for _, _, s in mine) + 1):
            here = words[at]
            for i, _, steps in mine:
                if step in steps:
                    keys[i] = keys[i] * np.uint64(0xD6E8FEB86659FD93) + here
            at += ((here >> np.uint64((step * 11 + walk * 23) % 64)) & np.uint64(1)).astype(np.int64)
        for i, _, _ in mine:
            yield i, K.mix(keys[i])


class Items:
    """A block of items of different words, with their LSH tables."""

    def __init__(self, ids: list[int], texts: list[str]):
        raw = [t.encode() for t in texts]
        data = np.frombuffer(b"".join(raw), np.uint8)
        words, first = item_words(data, np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64))
        self.ids, self.words, self.first = np.array(ids, np.int64), words, first
        sizes = np.diff(first)
        classes = [size_class(int(n)) if n else 0 for n in sizes]
        self.tables = plan(sorted(set(classes) - {0}))
        #: steps of the longest walk; words of the longest item
        self.longest, self.most = max([2 * c for c in classes], default=0), int(sizes.max(initial=0))
        #: items too short to leave STRIDE offsets, all of class 1
        self.short = bool(((sizes > 0) & (sizes < STRIDE)).any())
        keys, item, offset = [], [], []
        for i, c in enumerate(classes):
            if c:
                offsets = np.arange(int(sizes[i]) - c + 1)
                # beyond the item's end the walk reads what never is a word
                own = np.concatenate((words[first[i] : first[i + 1]], np.zeros(self.longest + 1, np.uint64)))
                chosen = [(n, t) for n, t in enumerate(self.tables) if t[0] == c]
                for at, key in signatures(own, offsets, [t for _, t in chosen]):
                    keys.append(self._numbered(key, chosen[at][0]))
                    item.append(np.full(len(offsets), i))
                    offset.append(offsets)
        self.keys = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        order = np.argsort(self.keys, kind="stable")
        self.keys, self.item, self.offset = self.keys[order], np.concatenate(item or [[]])[order].astype(np.int64), np.concatenate(offset or [[]])[order].astype(np.int64)
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.keys >> np.uint64(44)).astype(np.int64)] = True

    @staticmethod
    def _numbered(key: np.ndarray, table: int) -> np.ndarray:
        return K.mix(key ^ K.mix(np.array([table + 1], np.uint64)))

    def candidates(self, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, place of its first word) that the tables bring up in rows of words; a place may lie before the row."""
        n = np.diff(first)
        strided = K.spread(np.zeros(len(n), np.int64), -(-n // STRIDE)) * STRIDE + np.repeat(first[:-1], -(-n // STRIDE))
        words = np.concatenate((words, np.zeros(self.longest + 1, np.uint64)))
        items, places = [], []
        by_class: dict[int, list[tuple[int, tuple]]] = {}
        for number, t in enumerate(self.tables):
            by_class.setdefault(t[0], []).append((number, t))
        for c, group in by_class.items():
            starts = np.arange(first[-1]) if c == 1 and self.short else strided
            for at, key in signatures(words, starts, [t for _, t in group]):
                key = self._numbered(key, group[at][0])
                some = np.flatnonzero(self.seen[(key >> np.uint64(44)).astype(np.int64)])
                low = np.searchsorted(self.keys, key[some])
                many = np.searchsorted(self.keys, key[some], side="right") - low
                hit = K.spread(low, many)
                items.append(self.item[hit])
                places.append(np.repeat(starts[some], many) - self.offset[hit])
        return np.concatenate(items or [np.zeros(0, np.int64)]), np.concatenate(places or [np.zeros(0, np.int64)])


def edit_distance(item: np.ndarray, words: np.ndarray) -> tuple[int, int]:
    """Least edit distance of item to a run of words, and where the first such run ends."""
    place = np.arange(len(words) + 1)
    row = np.zeros(len(words) + 1, np.int64)
    for i, w in enumerate(item, 1):
        new = row + 1
        np.minimum(new[1:], row[:-1] + (words != w), out=new[1:])
        new[0] = i
        row = np.minimum.accumulate(new - place) + place
    end = int(row.argmin())
    return int(row[end]), end


#: Pairs of an item and a place that a row may have before its items are looked through for those that it can't hold.
FEW = 16


def possible(block: Items, items: np.ndarray, words: np.ndarray, share: float) -> np.ndarray:
    """Which of the items have as many of their words among these as an edited item must keep."""
    first, size = block.first[items], np.diff(block.first)[items]
    held = np.isin(block.words[K.spread(first, size)], words)
    return np.add.reduceat(held, np.cumsum(size) - size, dtype=np.int64) >= size - (share * size).astype(np.int64)


def _chosen(block: Items, item: np.ndarray, place: np.ndarray, words: np.ndarray, first: np.ndarray, share: float) -> list[tuple[int, int, int]]:
    """Distinct (row, item, place) that are worth an edit distance."""
    if not len(item):
        return []
    # a place belongs to the row that holds most of it
    owner = np.clip(np.searchsorted(first, place + np.diff(block.first)[item] // 2, side="right") - 1, 0, len(first) - 2)
    order = np.lexsort((place, item, owner))
    owner, item, place = owner[order], item[order], place[order]
    new = np.append(True, (owner[1:] != owner[:-1]) | (item[1:] != item[:-1]) | (place[1:] != place[:-1]))
    owner, item, place = owner[new], item[new], place[new]
    cut = np.append(np.flatnonzero(np.append(True, owner[1:] != owner[:-1])), len(owner))
    keep = np.ones(len(owner), bool)
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
        if b - a > FEW:  # such as a beginning that many items share
            some, back = np.unique(item[a:b], return_inverse=True)
            keep[a:b] = possible(block, some, words[first[owner[a]] : first[owner[a] + 1]], share)[back]
    return np.stack([owner, item, place])[:, keep].T.tolist()


SCHEMA = "doc_id long, item_id long, item_words int, edits int, start int, size int"
_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def _best_matches(block: Items, texts: pa.Array, share: float) -> dict[tuple[int, int], tuple[int, int, int]]:
    """By row and item: edits, start and size of the best run of words."""
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    last, base = -1, 0  # words of a long row before the piece
    for row, before, data, at, own in K.word_pieces(texts, 2 * block.most + 8, gap=~_INK):
        words, first = item_words(data, at)
        base = 0 if row != last or not before else base
        last = row
        item, place = block.candidates(words, first)
        for r, i, p in _chosen(block, item, place, words, first, share):
            mine = block.words[block.first[i] : block.first[i + 1]]
            most, had, low, high = int(share * len(mine)), best.get((row + r, i)), int(first[r]), int(first[r + 1])
            if had and had[0] == 0:
                continue
            a, b = max(p, low), min(p + len(mine), high)
            if b - a == len(mine) and (words[a:b] == mine).all():
                best[row + r, i] = (0, base + a - low, len(mine))
                continue
            a, b = max(p - most - 2, low), min(p + len(mine) + most + 2, high)
            if b - a < len(mine) - most:
                continue
            edits, end = edit_distance(mine, words[a:b])
            if edits <= most and (not had or edits < had[0]):
                back, start = edit_distance(mine[::-1], words[a : a + end][::-1])
                best[row + r, i] = (edits, base + a + end - start - low, start)
        base += int((item_places(data, at)[0] < own).sum()) if len(at) == 2 else 0
    return best


def matches(docs: DataFrame, items: Items, share: float = EDITS) -> DataFrame:
    """SCHEMA rows: items found in documents.  docs: (id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches):
        block = shared.value
        for batch in batches:
            best = _best_matches(block, batch.column(1), share)
            of, which = pa.array([r for r, _ in best], pa.int64()), np.array([i for _, i in best], np.int64)
            words = np.diff(block.first)[which].astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(of), pa.array(block.ids[which]), pa.array(words), *(pa.array([x[k] for x in best.values()], pa.int32()) for k in range(3))], _NAMES)

    found = saved(docs.mapInArrow(run, SCHEMA), "matches")
    shared.destroy()
    return found


def item_classes(items: DataFrame) -> DataFrame:
    """(item_id, words_key, text) of items (item_id, text) that have words; the key is a hash of their sequence of words."""

    def run(batches):
        for batch in batches:
            for row, data, at in K.slices(batch.column(1)):
                words, first = item_words(data, at)
                place = np.arange(len(words)) - np.repeat(first[:-1], np.diff(first))
                some = np.flatnonzero(np.diff(first))
                key = np.add.reduceat(K.mix(words * K.powers(len(words) + 1, 3)[place]), first[some]) if len(some) else np.zeros(0, np.uint64)
                at = pa.array(row + some)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array(K.mix(key).view(np.int64)), batch.column(1).take(at)], ["item_id", "words_key", "text"])

    return items.mapInArrow(run, "item_id long, words_key long, text string")


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", share: float = EDITS) -> DataFrame:
    """One row for each document and item that it holds: edits, and the start and size of the best run of words."""
    rows = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    items = benchmark.where(F.col(item_col).isNotNull() & F.col("text").isNotNull()).select(F.col(item_col).cast("long").alias("item_id"), "text")
    alike = saved(item_classes(items), "items")
    found, ids, texts, size = None, [], [], 0

    def take():
        nonlocal found, ids, texts, size
        if ids:
            more = matches(rows, Items(ids, texts), share)
            found = more if found is None else found.unionByName(more)
        ids, texts, size = [], [], 0

    for r in alike.groupBy("words_key").agg(F.min("text")).toLocalIterator():
        if size + len(r[1]) // 2 > BLOCK_WORDS:
            take()
        ids.append(r[0])
        texts.append(r[1])
        size += len(r[1]) // 2
    take()
    if found is None:
        return docs.sparkSession.createDataFrame([], SCHEMA).withColumnRenamed("doc_id", id_col)
    found = found.withColumnRenamed("item_id", "words_key").join(alike.select("words_key", "item_id").distinct(), "words_key")
    best = F.min(F.struct("edits", "start", "size", "item_words")).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select(F.col("doc_id").alias(id_col), "item_id", "best.item_words", "best.edits", "best.start", "best.size")
