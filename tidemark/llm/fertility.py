"""Operator 9: quality rules on tokeniser fertility.

A public vocabulary with byte fallback encodes every distinct word of a batch once; each
document gets its characters per token, its share of byte-fallback tokens and the entropy
of its tokens.  Each language (documents without one: their main script) has bands for the
three, from quartiles over all its documents (exact on a grid of GRID, so they don't depend on
the order of work); a document outside a band is rejected, and so is one that fails the base
rules.  Texts longer than a slice are read in pieces, of which word and line hashes are kept.

Cases: null or empty text has no words and fails the base rules; a group of documents that
all agree has a band of the least width; rows without an id are judged too; repeated rows
are judged alike; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .common import saved

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: A band reaches so many interquartile ranges beyond the quartiles; a range is taken as this wide at least.
REACH = 4.0
LEAST = {"chars_per_token": 0.15, "fallback": 0.01, "entropy": 0.25}
MIN_WORDS = 50
#: Bands that are broadcast at most (some MB); more of them are joined by a shuffle.
MAX_BANDS = 20_000
SLICE = 2 << 20
#: Steps of the grid on which quartiles are taken.
GRID = {"chars_per_token": 0.002, "fallback": 0.0002, "entropy": 0.002}
_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_SCRIPTS = ["latin", "greek", "cyrillic", "hebrew_arabic", "indic", "east_asian", "other"]


def letter_counts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Letters of each row and script, by lead bytes."""
    lead = np.full(256, -1)
    lead[65:91] = lead[97:123] = 0
    lead[0xC3:0xCA] = 0
    lead[0xCE:0xD0], lead[0xD0:0xD4], lead[0xD6:0xDC], lead[0xE0], lead[0xE3:0xEE], lead[0xE1:0xE3], lead[0xF0:0xF8] = 1, 2, 3, 4, 5, 6, 6
    kind = lead[data]
    rows = np.repeat(np.arange(len(at) - 1), np.diff(at))
    return np.bincount(rows[kind >= 0] * len(_SCRIPTS) + kind[kind >= 0], minlength=(len(at) - 1) * len(_SCRIPTS)).reshape(-1, len(_SCRIPTS))


def _per_row(mask_or_values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(mask_or_values, dtype=np.int64)))
    return total[at[1:]] - total[at[:-1]]


def base_counts(data: np.ndarray, at: np.ndarray):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each row; and the words and their hashes."""
    n = len(at) - 1
    start, end, first = K.words(data, at)
    sums = K.prefix_sums(data)
    hashes = K.range_hashes(sums, start, end)
    word_chars = _per_row(_chars(data, start, end), first)
    symbols = _per_row(_SYMBOL[data], at)
    lines, row = line_hashes(data, at, start, end, sums)
    key = lines ^ K.mix(row.astype(np.uint64))
    _, once = np.unique(key, return_index=True)
    dup = np.bincount(row, minlength=n) - np.bincount(row[once], minlength=n)
    return (np.diff(first), word_chars, symbols, dup, repeated_words(hashes, first)), (start, end, first, hashes)


def _chars(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Code points of each word."""
    chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    return chars[end] - chars[start]


def line_hashes(data: np.ndarray, at: np.ndarray, start: np.ndarray, end: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each line that has a word."""
    lines, line_end = K.runs(data != 10, at[at <= len(data)])
    if len(lines):
        inked = np.searchsorted(start, line_end) > np.searchsorted(end, lines, side="right")
        lines, line_end = lines[inked], line_end[inked]
    return K.range_hashes(sums, lines, line_end), np.searchsorted(at, lines, side="right") - 1


def repeated_words(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Words of each row in 3-word windows that the row has twice or more."""
    gram, ok = K.grams(hashes, first, 3)
    owner = K.rows_of(first)
    places = np.flatnonzero(ok)
    _, back, many = np.unique(gram[places] ^ K.mix(owner[places].astype(np.uint64)), return_inverse=True, return_counts=True)
    again = np.zeros(len(hashes) + 3, bool)
    twice = places[many[back] > 1] if len(places) else places
    for j in range(3):
        again[twice + j] = True
    return _per_row(again[: len(hashes)], first)


def long_row(model, text: pa.Array) -> tuple[tuple, tuple, int]:
    """The base counts, token measures and script of one text of any length, by pieces."""
    words, chars, symbols, uses, letters = [], 0, 0, np.zeros(model.get_piece_size(), np.int64), np.zeros(len(_SCRIPTS), np.int64)
    for _, _, data, at, _ in K.word_pieces(text, limit=SLICE):
        start, end, first = K.words(data, at)
        hashes = K.word_hashes(data, start, end)
        words.append(hashes)
        chars, symbols = chars + int(_chars(data, start, end).sum()), symbols + int(_SYMBOL[data].sum())
        size, flat, begin, back = encoded(model, data, start, end, hashes)
        many = np.bincount(back, minlength=len(size))
        uses += np.bincount(flat, np.repeat(many, size), len(uses)).astype(np.int64)
        letters += letter_counts(data, at)[0]
    lines = []
    for _, _, data, at, _ in K.word_pieces(text, limit=SLICE, gap=np.arange(256) == 10):
        start, end, _ = K.words(data, at)
        lines.append(line_hashes(data, at, start, end, K.prefix_sums(data))[0])
    words, lines = np.concatenate(words), np.concatenate(lines)
    total, some = int(uses.sum()), uses[uses > 0]
    entropy = np.log2(max(total, 1)) - (some * np.log2(some)).sum() / max(total, 1)
    base = (len(words), chars, symbols, len(lines) - len(np.unique(lines)), int(repeated_words(words, np.array([0, len(words)]))[0]))
    return base, (total, int(uses[byte_pieces(model)].sum()), float(entropy)), int(letters.argmax())


def byte_pieces(model) -> np.ndarray:
    return np.array([model.is_byte(i) for i in range(model.get_piece_size())])


def encoded(model, data: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each distinct word encoded once: numbers of tokens, all tokens, where each word's begin; and the distinct word of each word."""
    _, at, back = np.unique(hashes, return_index=True, return_inverse=True)
    raw = data.tobytes()
    texts = [raw[s:e].decode("utf-8", "replace") for s, e in zip(start[at], end[at])]
    ids = model.encode(texts, num_threads=1) if texts else []
    size = np.fromiter((len(x) for x in ids), np.int64, len(ids))
    flat = np.fromiter((t for x in ids for t in x), np.int64, int(size.sum()))
    return size, flat, np.concatenate(([0], np.cumsum(size)[:-1])) if len(size) else size, back


def token_stats(model, data: np.ndarray, start, end, first, hashes):
    """n_tokens, byte-fallback tokens and token entropy (bits) of each row; each distinct word is encoded once."""
    n = len(first) - 1
    size, flat, begin, back = encoded(model, data, start, end, hashes)
    word_fall = np.concatenate(([0], np.cumsum(byte_pieces(model)[flat])))[np.stack([begin, begin + size])] if len(size) else np.zeros((2, 0), int)
    tokens = _per_row(size[back], first)
    fallback = _per_row((word_fall[1] - word_fall[0])[back], first)
    entropy = np.zeros(n)
    # by some rows at a time: the tokens of all words would be many
    cut = np.searchsorted(np.cumsum(tokens), np.arange(0, int(tokens.sum()) + 1, 2_000_000), side="left").tolist() + [n]
    for a, b in zip(cut, cut[1:]):
        if b <= a:
            continue
        mine = back[first[a] : first[b]]
        all_tokens = flat[K.spread(begin[mine], size[mine])]
        owner = np.repeat(np.arange(b - a), tokens[a:b])
        keys, many = np.unique(owner * model.get_piece_size() + all_tokens, return_counts=True)
        who = keys // model.get_piece_size()
        with np.errstate(divide="ignore", invalid="ignore"):
            entropy[a:b] = np.log2(np.maximum(tokens[a:b], 1)) - np.bincount(who, many * np.log2(many), b - a) / np.maximum(tokens[a:b], 1)
    return tokens, fallback, entropy


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", path: str = VOCABULARY) -> DataFrame:
    """Per document its group (language or script), base counts and fertility measures."""
    import pathlib

    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(pathlib.Path(path).read_bytes())
    schema = "doc_id long, band string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, chars_per_token double, fallback double, entropy double"

    def run(batches):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=shared.value)
        for batch in batches:
            ids, text, lang = batch.columns
            for row, data, at in K.slices(text, SLICE):
                if len(data) > SLICE:
                    counts, measures, script = long_row(model, text.slice(row, 1))
                    counts, (tokens, fallback, entropy), script = [np.array([c]) for c in counts], (np.array([x]) for x in measures), np.array([script])
                else:
                    counts, (start, end, first, hashes) = base_counts(data, at)
                    tokens, fallback, entropy = token_stats(model, data, start, end, first, hashes)
                    script = letter_counts(data, at).argmax(axis=1)
                n, some = len(at) - 1, np.maximum(tokens, 1)
                names = lang.slice(row, n)
                band = pa.compute.coalesce(names, pa.array(np.array(_SCRIPTS, object)[script], pa.string()))
                columns = [ids.slice(row, n), band, *(pa.array(c.astype(np.int64)) for c in (*counts, tokens)), pa.array(counts[1] / some), pa.array(fallback / some), pa.array(entropy)]
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in schema.split(", ")])

    return docs.select(F.col(id_col).cast("long"), text_col, F.col(lang_col).cast("string")).mapInArrow(run, schema)


def quartiles(measured: DataFrame) -> DataFrame:
    """(band, measure, lo, hi): quartiles on the grid, from counts of its cells: of the cells in order the first that reaches a quarter, and three quarters, of the documents."""
    cell = lambda c: F.struct(F.lit(c).alias("measure"), F.floor(F.col(c) / GRID[c]).alias("cell"))
    cells = measured.select("band", F.inline(F.array(*map(cell, GRID)))).groupBy("band", "measure", "cell").agg(F.count("*").alias("k"))
    by = Window.partitionBy("band", "measure")
    cells = cells.withColumn("up", F.sum("k").over(by.orderBy("cell"))).withColumn("all", F.sum("k").over(by))
    step = F.create_map(*[x for c, g in GRID.items() for x in (F.lit(c), F.lit(g))])[F.col("measure")]
    at = lambda share: F.min(F.when(F.col("up") >= share * F.col("all"), F.col("cell") * step))
    return cells.groupBy("band", "measure").agg(at(0.25).alias("lo"), at(0.75).alias("hi"))


def judge(measured: DataFrame) -> DataFrame:
    """measured with base_failed, verdict (of the bands) and kept."""
    measured = saved(measured, "fertility")
    found = quartiles(measured.where(F.col("n_words") >= MIN_WORDS))
    width = F.greatest(F.create_map(*[x for c, w in LEAST.items() for x in (F.lit(c), F.lit(w))])[F.col("measure")], F.col("hi") - F.col("lo"))
    one = lambda c: F.max(F.when(F.col("measure") == c, F.struct("lo", "hi", width.alias("w")))).alias(f"b_{c}")
    bands = found.groupBy(F.col("band").alias("b")).agg(*map(one, LEAST))
    bands = saved(bands, "bands")
    bands = F.broadcast(bands) if bands.count() <= MAX_BANDS else bands  # a few languages hold all rows: a shuffle by band would be uneven
    inside = F.lit(True)
    for c in LEAST:
        b = F.col(f"b_{c}")
        inside = inside & F.col(c).between(b["lo"] - REACH * b["w"], b["hi"] + REACH * b["w"])
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = measured.join(bands, F.col("band") == F.col("b"), "left").withColumn("base_failed", failed).withColumn("verdict", F.coalesce(inside, F.lit(True)))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("verdict")).drop("b", *(f"b_{c}" for c in LEAST))
