"""Operator 4: language identification by segmentation-marginalised unigrams.

The pieces are a fixed public vocabulary (its letter pieces in lower case, of any length, and
single bytes, so every word has a segmentation).  Each language has a probability for each
piece.  A word's probability under a language is the sum over all its segmentations, by the
forward algorithm, which keeps as many places as the longest piece has bytes and rescales
them, so words of any length are summed whole; a text's is the product over its words; the
prediction is the language with the largest, and the score its posterior.  Piece
probabilities come from a few EM rounds (forward and backward sums of logarithms, so no word
is too long or too improbable for them) over a bounded sample of labelled documents: TRAIN_DOCS
for each language, chosen by a hash of the id.  Words longer than FIT_WINDOW are learned from
window by window, all of their bytes.

Words are runs of ASCII letters and non-ASCII bytes, A-Z in lower case.  The model, pieces by
languages, is broadcast; more than MAX_LANGUAGES labels are refused, not cut.

Cases: null text, or text without a letter, gives ``und`` with score 0; so does everything
if nothing is labelled.  Ties go to the first language by code point.  Rows without an id
are predicted, never learned from.  Repeated rows are predicted alike.  Texts longer than a
slice are read in pieces cut at white space.  Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .common import saved

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Labelled documents for each language that the fit reads, about.
TRAIN_DOCS = 1500
#: Longer words are learned from in windows of so many bytes, cut between characters (predictions take words whole).
FIT_WINDOW = 96
#: Labels at most: some 170 MB of model.
MAX_LANGUAGES = 1000
ROUNDS = 3
#: Numbers that the forward sums of a chunk of words hold, about.
CELLS = 1 << 21
#: Steps after which the forward sums are rescaled.
RESCALE = 16
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def vocabulary(path: str = VOCABULARY) -> list[bytes]:
    """The letter pieces of a public vocabulary file, and all single bytes."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {bytes([b]) for b in range(256)}
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
            raw = model.id_to_piece(i).replace("▁", "").encode()
            raw = bytes(K.LOWER[np.frombuffer(raw, np.uint8)]) if raw else raw
            if raw and all(_LETTER[b] for b in raw):
                pieces.add(raw)
    return sorted(pieces)


class Pieces:
    """Lookup of byte ranges among the pieces, by hash."""

    SLOTS = 1 << 18

    def __init__(self, pieces: list[bytes]):
        data = np.frombuffer(b"".join(pieces), np.uint8)
        size = np.array([len(p) for p in pieces])
        end = np.cumsum(size)
        hashes = K.range_hashes(K.prefix_sums(data), end - size, end)
        self.n, self.lengths = len(pieces), sorted({len(p) for p in pieces})
        self.hashes, self.ids = np.zeros(self.SLOTS, np.uint64), np.full(self.SLOTS, self.n, np.int32)
        self.probes = 1
        for i, h in enumerate(hashes):
            slot, probe = int(h >> np.uint64(46)), 1
            while self.ids[slot] != self.n:
                slot, probe = (slot + 1) % self.SLOTS, probe + 1
            self.hashes[slot], self.ids[slot], self.probes = h, i, max(self.probes, probe)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Piece numbers; n where there is no such piece."""
        slot = (hashes >> np.uint64(46)).astype(np.int64)
        out = np.where(self.hashes[slot] == hashes, self.ids[slot], self.n)
        for _ in range(self.probes - 1):
            slot = (slot + 1) % self.SLOTS
            hit = (out == self.n) & (self.hashes[slot] == hashes)
            out[hit] = self.ids[slot[hit]]
        return out


def letter_words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each letter word."""
    start, end = K.runs(_LETTER[data], at[at <= len(data)])
    return start, end, np.searchsorted(at, start, side="right") - 1


def lattice(pieces: Pieces, sums: np.ndarray, start: np.ndarray, end: np.ndarray):
    """For each end place i and piece length l in words sorted by size: (i, l, words that have such a piece there, their piece numbers)."""
    size = end - start
    for i in range(1, int(size.max(initial=0)) + 1):
        first = int(np.searchsorted(size, i))
        for l in pieces.lengths:
            if l > i:
                break
            ids = pieces.find(K.range_hashes(sums, start[first:] + i - l, start[first:] + i))
            hit = np.flatnonzero(ids != pieces.n)
            if len(hit):
                yield i, l, first + hit, ids[hit]


def forward(pieces: Pieces, p: np.ndarray, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Log probability of each word under each language (words sorted by size); p: pieces by languages."""
    size = end - start
    ring, logs = np.zeros((pieces.lengths[-1] + 1, len(start), p.shape[1])), np.zeros((len(start), p.shape[1]))
    ring[0], now, done = 1, 0, 0
    for i, l, words, ids in lattice(pieces, sums, start, end):
        if i != now:  # a new place: words that ended before it are out
            done = _ended(ring, logs, size, now, done)
            now = i
            ring[i % len(ring), done:] = 0
        ring[i % len(ring), words] += ring[(i - l) % len(ring), words] * p[ids]
    _ended(ring, logs, size, now, done)
    return logs


def _ended(ring: np.ndarray, logs: np.ndarray, size: np.ndarray, i: int, done: int) -> int:
    """Closes the words of i bytes, rescales the others now and then; gives the first word that goes on."""
    to = int(np.searchsorted(size, i, side="right"))
    logs[done:to] += np.log(ring[i % len(ring), done:to])
    if i and i % RESCALE == 0 and to < len(size):
        most = ring[:, to:].max(axis=0)
        ring[:, to:] /= most
        logs[to:] += np.log(most)
    return to


def in_chunks(size: np.ndarray, wide: int):
    """Slices of words, each of about CELLS numbers, if a word takes so many."""
    step = max(1, CELLS // wide)
    return (slice(i, i + step) for i in range(0, len(size), step))


def windows(data: np.ndarray, start: np.ndarray, end: np.ndarray, most: int = FIT_WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and word of windows of ``most`` bytes, about, that make up each word; no character is cut."""
    many = np.maximum(-(-(end - start) // most), 1)
    word = np.repeat(np.arange(len(start)), many)
    place = K.spread(np.zeros(len(start), np.int64), many)
    cut = start[word] + place * most
    for _ in range(3):
        cut -= (place > 0) & (data[cut] & 0xC0 == 0x80)
    last = np.append(word[1:] != word[:-1], True) if len(word) else np.zeros(0, bool)
    return cut, np.where(last, end[word], np.append(cut[1:], 0)[: len(cut)]), word


def expected(pieces: Pieces, p: np.ndarray, sums: np.ndarray, start: np.ndarray, end: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Expected uses of each piece in weighted words of one language (words sorted by size); p: its probabilities."""
    size, every, logs = end - start, np.arange(len(start)), np.log(p)
    top = int(size.max(initial=0))
    alpha, beta = np.full((top + 1, len(start)), -np.inf), np.full((top + 1, len(start)), -np.inf)
    alpha[0], beta[size, every] = 0, 0
    steps = list(lattice(pieces, sums, start, end))
    for i, l, words, ids in steps:
        alpha[i, words] = np.logaddexp(alpha[i, words], alpha[i - l, words] + logs[ids])
    whole, counts = alpha[size, every], np.zeros(pieces.n)
    for i, l, words, ids in reversed(steps):
        use = logs[ids] + beta[i, words]
        beta[i - l, words] = np.logaddexp(beta[i - l, words], use)
        counts += np.bincount(ids, np.exp(alpha[i - l, words] + use - whole[words]) * weight[words], pieces.n)
    return counts


def _unique(data, sums, start, end):
    """Distinct words sorted by size: start, end, and for each word the number of its distinct one; how often each is found."""
    _, at, back, n = np.unique(K.range_hashes(sums, start, end), return_index=True, return_inverse=True, return_counts=True)
    order = np.argsort((end - start)[at], kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return start[at][order], end[at][order], rank[back], n[order]


def held_out(id_col: str, parts: int, part: int) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % parts == part, F.lit(False))


class Model:
    def __init__(self, languages: list[str], pieces: Pieces, p: np.ndarray):
        self.languages, self.pieces, self.p = languages, pieces, p


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", path: str = VOCABULARY) -> Model:
    """EM over TRAIN_DOCS documents a language; the tables between are pieces by languages."""
    pieces, spark = Pieces(vocabulary(path)), labelled.sparkSession
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    counts = rows.groupBy(lang_col).count().collect()
    languages = sorted(r[0] for r in counts)
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"{len(languages)} labels; a model of more than {MAX_LANGUAGES} isn't broadcast")
    if not languages:
        return Model([], pieces, np.zeros((pieces.n, 0)))
    share = spark.createDataFrame([(languages.index(r[0]), r[0], int(min(1, TRAIN_DOCS / r[1]) * 2**32)) for r in counts], "number int, l string, below long")
    chosen = rows.join(F.broadcast(share), F.col(lang_col) == F.col("l")).where(F.shiftrightunsigned(F.xxhash64(F.lit(4), id_col), 32) < F.col("below"))
    sample = saved(chosen.select("number", F.col(text_col).alias("text")), "langid-sample").repartition(2 * spark.sparkContext.defaultParallelism)
    p = np.full((pieces.n, len(languages)), 1 / pieces.n)
    for _ in range(ROUNDS):
        shared = spark.sparkContext.broadcast((pieces, p))

        def run(batches):
            pieces, p = shared.value
            total = np.zeros_like(p)
            for batch in batches:
                number = batch.column(0).to_numpy()
                for row, _, data, at, _ in K.word_pieces(batch.column(1)):
                    data = K.LOWER[data]
                    start, end, owner = letter_words(data, at)
                    start, end, word = windows(data, start, end)
                    owner = owner[word]
                    sums, lang = K.prefix_sums(data), number[row + owner]
                    for x in np.unique(lang):
                        s, e, _, n = _unique(data, sums, start[lang == x], end[lang == x])
                        for part in in_chunks(s, 8 * FIT_WINDOW):
                            total[:, x] += expected(pieces, p[:, x], sums, s[part], e[part], n[part])
            at = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at[1].astype(np.int32)), pa.array(at[0].astype(np.int32)), pa.array(total[at])], ["lang", "piece", "uses"])

        total = np.full((pieces.n, len(languages)), 0.05)
        uses = sample.mapInArrow(run, "lang int, piece int, uses double").groupBy("lang", "piece").agg(F.sum("uses").alias("uses")).toArrow()
        total[uses["piece"].to_numpy(), uses["lang"].to_numpy()] += uses["uses"].to_numpy()  # a pair once
        p = total / total.sum(axis=0)
        shared.destroy()
        if not np.isfinite(p).all():
            raise ArithmeticError("the model isn't finite")
    return Model(languages, pieces, p)


def predict(docs: DataFrame, model: Model, text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """docs with pred_col and score_col after its columns."""
    schema = T.StructType([*docs.schema.fields, T.StructField(pred_col, T.StringType()), T.StructField(score_col, T.DoubleType())])
    if not model.languages:
        return docs.select("*", F.lit("und").alias(pred_col), F.lit(0.0).alias(score_col))
    shared, letters = docs.sparkSession.sparkContext.broadcast(model), "_has_letter"
    while letters in {c.lower() for c in docs.columns}:
        letters += "_"

    def run(batches):
        m = shared.value
        names = np.array([*m.languages, "und"], object)
        for batch in batches:
            text, known = batch.column(batch.schema.get_field_index(text_col)), batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            total = np.zeros((len(text), len(m.languages)))
            for row, _, data, at, _ in K.word_pieces(text):
                data = K.LOWER[data]
                start, end, owner = letter_words(data, at)
                if not len(start):
                    continue
                sums = K.prefix_sums(data)
                s, e, back, _ = _unique(data, sums, start, end)
                wide = (m.pieces.lengths[-1] + 1) * len(m.languages)
                logs = np.concatenate([forward(m.pieces, m.p, sums, s[part], e[part]) for part in in_chunks(s, wide)])
                for x in range(logs.shape[1]):
                    total[row : row + len(at) - 1, x] += np.bincount(owner, logs[back, x], len(at) - 1)
            total -= total.max(axis=1, keepdims=True, initial=-np.inf)
            best = np.where(known, total.argmax(axis=1), len(m.languages))
            score = np.where(known, 1 / np.exp(total).sum(axis=1), 0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(names[best], pa.string()), pa.array(score)], [*batch.schema.names[:-1], pred_col, score_col])

    return docs.select("*", F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias(letters)).mapInArrow(run, schema)
