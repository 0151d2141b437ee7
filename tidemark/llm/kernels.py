"""Array kernels over the texts of one Arrow batch.

Everything here works on whole texts as UTF-8 bytes, a bounded slice of documents at a
time.  Null texts count as empty ones.  No kernel knows of Spark: operators call them
from ``mapInArrow`` and let Spark partition, shuffle and join what they return.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one slice holds; pieces() and word_pieces() cut longer documents, slices() leaves them whole.
SLICE_BYTES = 1 << 18
#: Rows that one slice holds at most.
SLICE_ROWS = 1 << 12

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int, seed: int = 0) -> np.ndarray:
    """n odd multipliers, the same for every caller with the same seed."""
    return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed * 1_000_003)) * _STEP) | np.uint64(1)


def slices(texts: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets of the rows in these bytes), by whole rows."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    if texts.null_count:
        texts = texts.fill_null("" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    if not len(texts):
        return
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, at, data = texts.buffers()
    at = np.frombuffer(at, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        to = min(max(row + 1, int(np.searchsorted(at, at[row] + limit, side="right")) - 1), row + SLICE_ROWS)
        yield row, data[at[row] : at[to]], at[row : to + 1] - at[row]
        row = to


def pieces(texts: pa.Array, overlap: int, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, int]]:
    """As slices(), but longer rows in pieces: (first row, bytes of it before the piece, bytes, offsets, own bytes).

    A piece stands for its own bytes; up to ``overlap`` bytes of the next follow them.  The
    cuts are at multiples of ``limit``, so they don't depend on what other rows there are.
    """
    for row, data, at in slices(texts, limit):
        for base in range(0, len(data), limit) if len(data) > limit else (0,):
            part = data[base : base + limit + overlap] if len(data) > limit else data
            yield row, base, part, np.array([0, len(part)]) if len(data) > limit else at, min(limit, len(data) - base)


def word_pieces(texts: pa.Array, overlap: int = 0, limit: int = SLICE_BYTES, gap: np.ndarray = _SPACE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, int]]:
    """As pieces(), cut between words: (first row, words of it before the piece, bytes, offsets, own bytes); ``overlap`` counts words.

    A word, a run of bytes that are no gap, is never cut, however long it is.
    """
    for row, data, at in slices(texts, limit):
        if len(data) <= limit:
            yield row, 0, data, at, len(data)
            continue
        base = pos = 0
        while pos < len(data):
            cut = _next_gap(data, pos + limit, gap)
            end, n = cut, 0
            while end < len(data) and n < overlap:  # overlap words beyond the cut
                end = _next_gap(data, end + 16 * (overlap - n), gap)
                n = _count(data[cut:end], gap)
            yield row, base, data[pos:end], np.array([0, end - pos]), cut - pos
            base += _count(data[pos:cut], gap)
            pos = cut


def _next_gap(data: np.ndarray, at: int, gap: np.ndarray) -> int:
    """The first place from ``at`` on that is a gap, or the end."""
    while at < len(data):
        found = np.flatnonzero(gap[data[at : at + 4096]])
        if len(found):
            return at + int(found[0])
        at += 4096
    return len(data)


def _count(data: np.ndarray, gap: np.ndarray) -> int:
    """Words in these bytes, which begin and end between words."""
    ink = ~gap[data]
    return int(ink[:1].sum() + (ink[1:] & ~ink[:-1]).sum())


def joined(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of each word and a space after each; where each word begins in them (one more at the end)."""
    size = end - start + 1
    out = np.append(data, np.uint8(32))[spread(start, size)]
    at = np.concatenate(([0], np.cumsum(size)))
    out[at[1:] - 1] = 32
    return out, at


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word ``[^\\x20\\x09-\\x0D]+``, and the index of each row's first word (one more at the end)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    ink = ~_SPACE[data]
    first = np.empty(len(data) + 1, bool)
    first[0] = first[-1] = True
    np.not_equal(ink[1:], ink[:-1], out=first[1:-1])
    first[at[at <= len(data)]] = True
    cut = np.flatnonzero(first)
    keep = ink[cut[:-1]]
    start, end = cut[:-1][keep], cut[1:][keep]
    return start, end, np.searchsorted(start, at)


_M = 0x2545F4914F6CDD1D
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of _M and of its inverse, up to the n-th at least (those for a slice are kept for the life of the worker)."""
    size = max(n, SLICE_BYTES + 4096)
    if 0 in _tables and len(_tables[0][0]) >= size:
        return _tables[0]
    made = tuple(np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, m, np.uint64)))) for m in (_M, pow(_M, -1, 1 << 64)))
    if size <= 4 * SLICE_BYTES:
        _tables[0] = made
    return made


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Polynomial prefix hash: range_hashes() gets the hash of any byte range from it in one step."""
    out = np.zeros(len(data) + 1, np.uint64)
    values = _BYTE[data]
    values *= _power_tables(len(data) + 1)[0][: len(data)]
    np.cumsum(values, out=out[1:])
    return out


def range_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of the bytes start:end of each range; equal bytes give equal hashes wherever they stand."""
    out = sums[end] - sums[start]
    out *= _power_tables(len(sums))[1][start]
    out += (end - start).astype(np.uint64) * _STEP + np.uint64(seed)
    return mix(out)


def sliding_hashes(sums: np.ndarray, size: int) -> np.ndarray:
    """Hash of the bytes i:i+size for every i (of range_hashes, but for the part that tells sizes apart)."""
    out = sums[size:] - sums[:-size]
    out *= _power_tables(len(sums))[1][: len(out)]
    return mix(out)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each word."""
    return range_hashes(prefix_sums(data), start, end)


def hashed_words(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, hashes of the words with A-Z in lower case, index of each row's first word), slice by slice.

    Of a text longer than a slice no more than 8 bytes a word are held at once.
    """
    for row, data, at in slices(texts):
        parts = []
        for part in [(data, at)] if len(data) <= SLICE_BYTES else (x[2:4] for x in word_pieces(pa.array([data.tobytes()], pa.large_binary()))):
            low = LOWER[part[0]]
            start, end, first = words(low, part[1])
            parts.append(word_hashes(low, start, end))
        yield row, parts[0] if len(parts) == 1 else np.concatenate(parts), first if len(data) <= SLICE_BYTES else np.array([0, sum(map(len, parts))])


def grams(hashes: np.ndarray, first: np.ndarray, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of k words that starts at a word, and whether it lies inside one row."""
    n = len(hashes)
    ok = np.zeros(n, bool)
    if n < k or n == 0:
        return np.zeros(n, np.uint64), ok
    out = np.zeros(n, np.uint64)
    for j, p in enumerate(powers(k, seed)):
        out[: n - j] += hashes[j:] * p
    room = np.repeat(first[1:], np.diff(first)) - np.arange(n)
    np.greater_equal(room, k, out=ok)
    return mix(out), ok


def rows_of(first: np.ndarray) -> np.ndarray:
    """The row (within the slice) of each word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, … for size[0] values, then the same for the next."""
    if not len(start):
        return np.zeros(0, np.int64)
    return np.arange(int(size.sum())) + np.repeat(start - np.concatenate(([0], np.cumsum(size)[:-1])), size)


def minimizers(keys: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` keys the place of its least key, leftmost of equal ones (windows past the end: cut there).

    The keys' upper bits are compared: the lower ones give room to the place.
    """
    n = len(keys)
    bits = np.uint64(max(1, int(n).bit_length()))
    least = (keys >> bits << bits) | np.arange(n, dtype=np.uint64)
    done = 1
    while done < width:  # least holds the minimum over `done` keys
        by = min(done, width - done)
        np.minimum(least[: n - by], least[by:], out=least[: n - by]) if by < n else None
        done += by
    return (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)


def covered(first: np.ndarray, rows: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Which items of the rows (row r's begin at first[r]) lie in a span; spans are given by row, start in it and size."""
    n = int(first[-1])
    step = np.zeros(n + 1, np.int64)
    starts = np.minimum(first[rows] + starts, first[rows + 1])
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + sizes, first[rows + 1]), -1)
    return np.cumsum(step[:-1]) > 0


def runs(mask: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each maximal run of True that stays inside a row."""
    if not len(mask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(len(mask) + 1, bool)
    edge[0] = edge[-1] = True
    np.not_equal(mask[1:], mask[:-1], out=edge[1:-1])
    edge[first] = True
    cut = np.flatnonzero(edge)
    keep = mask[cut[:-1]]
    return cut[:-1][keep], cut[1:][keep]
