"""Operator 11: encoding and decoding with a public BPE vocabulary, by a lexicon of frequent words.

The words of all texts are counted; the most frequent ones, LEXICON_WORDS at most, are compiled
with their ids into a minimal acyclic transducer (transducer.py).  Its file goes to the executors as a
file of the session, and their workers map it into memory.  Each batch looks up its distinct words in it; words that
it lacks are merged exactly, by rank and then place, as the vocabulary's rules say.  So the
lexicon's bound costs time at most, never an id.

Texts are cut at ASCII white space, where no normalisation, word or merge of such a vocabulary
reaches across, and distinct chunks are normalised and split into words once a task and batch.
ASCII chunks are lower-cased and split here; others by the vocabulary file's own rules for
normalising and splitting.

Cases: null text counts as empty, and has no ids; strings of special tokens in a text are these
tokens, as the tokenizers library has it; texts longer than a slice are read in pieces cut
between chunks, and a word of any length is merged whole; repeated rows are encoded alike;
invalid UTF-8 is read as U+FFFD; an empty table gives no rows.  Ids that the vocabulary lacks
are left out in decoding.  Other columns are passed on.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import itertools
import json
import os
import re
import struct
import tempfile
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .common import discard, saved
from .transducer import Transducer, compiled

VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"
#: Words of the lexicon at most, and the bytes that each may have: so its file has a fixed bound, too.
LEXICON_WORDS, LEXICON_BYTES = 1 << 16, 48
#: Distinct words or chunks that a task keeps at once.
KEPT = 1 << 18
_ASCII = re.compile(rb"'(?:s|t|re|ve|m|ll|d)|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")
#: Latin letters with marks that are composed already, each with one lower-case form: normal by themselves.
_LATIN = re.compile("[\x00-\x7fÀ-ÖØ-öø-įĲ-ſ]*")
_LATIN_WORDS = re.compile("'(?:s|t|re|ve|m|ll|d)|[a-zß-öø-ſ]+|[0-9]|[^\t-\r a-z0-9ß-öø-ſ]+")
#: Words of more symbols are merged by a heap of pairs, shorter ones by a scan.
SCANNED = 64
#: The split rule that _ASCII and _LATIN_WORDS stand for on such text in lower case, and the normalisation before it: fixed values of the vocabulary.
_RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMAL = ["NFC", "Replace", "Lowercase"]


def _byte_names() -> list[str]:
    """The character by which vocabularies of bytes name each byte: itself if it prints, else the next free one from 256 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in prints else next(others)) for b in range(256)]


class Vocabulary:
    """A BPE vocabulary with word ends, read from the text of its file."""

    def __init__(self, raw: bytes):
        from tokenizers import Regex, Tokenizer, pre_tokenizers

        file = json.loads(raw)
        model = file["model"]
        split = file["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        if model["type"] != "BPE" or not model["end_of_word_suffix"] or split != _RULE or [x["type"] for x in file["normalizer"]["normalizers"]] != _NORMAL:
            raise ValueError("not a vocabulary of the kind that this operator reads")
        ids, names, end = model["vocab"], _byte_names(), model["end_of_word_suffix"]
        self.inner = [ids[c] for c in names]
        self.last = [ids[c + end] for c in names]
        self.ranks: dict[int, int] = {}  # of pairs of ids
        self.made = []  # what a pair of a rank becomes
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks.setdefault(ids[a] << 32 | ids[b], rank)
            self.made.append(ids[a + b])
        special = {t["content"].encode(): t["id"] for t in file["added_tokens"]}
        self.special = {s: np.uint32(i).tobytes() for s, i in special.items()}
        self.find_special = re.compile(b"|".join(re.escape(s) for s in sorted(special, key=len, reverse=True)) or rb"(?!)")
        self.tokens = {i: t.encode() for t, i in ids.items()} | {i: s for s, i in special.items()}
        self._normal = Tokenizer.from_str(raw.decode()).normalizer
        self._split = pre_tokenizers.Split(Regex(split), "removed", invert=True)

    def chunks(self, raw: bytes) -> list[bytes]:
        """A text cut at white space and around special tokens."""
        if b"<" in raw and self.find_special.search(raw):
            raw = self.find_special.sub(rb" \g<0> ", raw)
        return raw.split()

    def words(self, chunk: bytes) -> list[bytes]:
        """The words of a chunk that is no special token, normalised."""
        if chunk.isascii():
            return _ASCII.findall(chunk.lower())
        text = chunk.decode(errors="replace")
        if _LATIN.fullmatch(text):
            return [w.encode() for w in _LATIN_WORDS.findall(text.lower())]
        return [w.encode() for w, _ in self._split.pre_tokenize_str(self._normal.normalize_str(text))]

    def merged(self, word: bytes) -> bytes:
        """Ids of a word: of the pairs that merge, the one of least rank and then leftmost, until none is left."""
        ids = [self.inner[b] for b in word[:-1]] + [self.last[word[-1]]]
        out = self._scanned(ids) if len(ids) <= SCANNED else self._heaped(ids)
        return struct.pack(f"<{len(out)}I", *out)

    def _scanned(self, ids: list[int]) -> list[int]:
        rank, none = self.ranks.get, len(self.made)
        ranks = [rank(a << 32 | b, none) for a, b in itertools.pairwise(ids)]
        while ranks and (least := min(ranks)) != none:
            i = ranks.index(least)
            ids[i : i + 2] = [new] = [self.made[least]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = rank(new << 32 | ids[i + 1], none)
            if i:
                ranks[i - 1] = rank(ids[i - 1] << 32 | new, none)
        return ids

    def _heaped(self, ids: list[int]) -> list[int]:
        n, rank = len(ids), self.ranks.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i, (a, b) in enumerate(itertools.pairwise(ids)) if (r := rank(a << 32 | b)) is not None]
        heapq.heapify(heap)
        while heap:
            least, i = heapq.heappop(heap)
            j = after[i] if ids[i] >= 0 else n
            if j >= n or rank(ids[i] << 32 | ids[j]) != least:
                continue  # one of the two has gone into another pair
            new = ids[i] = self.made[least]
            ids[j] = -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank(new << 32 | ids[k])) is not None:
                    heapq.heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := rank(ids[h] << 32 | new)) is not None:
                heapq.heappush(heap, (r, h))
        return [i for i in ids if i >= 0]


@functools.lru_cache(2)
def _vocabulary(raw: bytes) -> Vocabulary:
    return Vocabulary(raw)


@functools.lru_cache(2)
def _transducer(path: str) -> Transducer:
    return Transducer(path)


def _shared(df: DataFrame, path: str):
    """The vocabulary file, broadcast: some MB, checked."""
    with open(path, "rb") as f:
        raw = f.read()
    if len(raw) > 64 << 20:
        raise ValueError("a vocabulary of more than 64 MB is not broadcast")
    return df.sparkSession.sparkContext.broadcast(raw)


def _rows(vocabulary: Vocabulary, texts: pa.Array):
    """(row, chunks) of the texts, longer ones in several parts."""
    for row, _, data, at, _ in K.word_pieces(texts):
        raw = data.tobytes()
        for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
            yield row + i, vocabulary.chunks(raw[a:b])


def word_counts(docs: DataFrame, text_col: str = "text", path: str = VOCABULARY) -> DataFrame:
    """(word, n): how often each normalised word of LEXICON_BYTES at most stands in the texts."""
    shared = _shared(docs, path)

    def run(batches):
        vocabulary, counts = _vocabulary(shared.value), Counter()

        def flush():
            words: dict[bytes, int] = {}
            for chunk, n in counts.items():
                for w in () if chunk in vocabulary.special else vocabulary.words(chunk):
                    if len(w) <= LEXICON_BYTES:
                        words[w] = words.get(w, 0) + n
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(words), pa.binary()), pa.array(list(words.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for _, chunks in _rows(vocabulary, batch.column(0)):
                counts.update(chunks)
                if len(counts) > KEPT:
                    yield flush()
        yield flush()

    return docs.select(text_col).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def lexicon(docs: DataFrame, text_col: str = "text", path: str = VOCABULARY, most: int = LEXICON_WORDS) -> str:
    """Compiles the most frequent words with their ids; the name of the session's file that holds them."""
    counts, level = saved(word_counts(docs, text_col, path).where("n > 1"), "bpe-words"), F.floor(F.log2("n") * 8)
    least, total = None, 0
    for r in counts.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():  # 8 levels a doubling
        total += r["count"]
        if total > most:
            break
        least = r["level"]
    frequent = counts.where(level >= least if least is not None else F.lit(False)).select("word")
    shared = _shared(docs, path)

    def run(batches):
        vocabulary = _vocabulary(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([vocabulary.merged(w) for w in batch.column(0).to_pylist()], pa.binary())], ["word", "ids"])

    entries = sorted((bytes(w), np.frombuffer(i, np.uint32).tolist()) for w, i in frequent.mapInArrow(run, "word binary, ids binary").collect())  # `most` rows at most
    discard(counts)
    raw = compiled(entries)
    name = f"tidemark-lexicon-{hashlib.sha256(raw).hexdigest()[:24]}"
    if any(f.endswith(f"/{name}") for f in docs.sparkSession.sparkContext.listFiles):
        return name
    where = os.path.join(tempfile.mkdtemp(prefix="tidemark-lexicon-"), name)  # the driver's own; executors get it from the session
    with open(where, "wb") as f:
        f.write(raw)
    docs.sparkSession.sparkContext.addFile(where)
    return name


def encode(docs: DataFrame, text_col: str = "text", ids_col: str = "ids", path: str = VOCABULARY, lexicon_name: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """docs (its columns ``keep``, or all) with the ids of each text, little-endian unsigned 32-bit integers as bytes, after its columns."""
    kept = docs.columns if keep is None else keep
    name, shared = lexicon_name or lexicon(docs, text_col, path), _shared(docs, path)

    def run(batches):
        vocabulary, known = _vocabulary(shared.value), {}
        words_of = _transducer(SparkFiles.get(name))

        def learn(chunks):
            """Puts the ids of these chunks into ``known``."""
            split = {c: vocabulary.words(c) for c in chunks if c not in vocabulary.special}
            distinct = list({w for ws in split.values() for w in ws})
            ids = dict(zip(distinct, words_of.found(distinct), strict=True))
            for w in distinct:
                if ids[w] is None:
                    ids[w] = vocabulary.merged(w)
            for c, ws in split.items():
                known[c] = b"".join([ids[w] for w in ws])

        for batch in batches:
            texts, out = batch.column(batch.num_columns - 1), [[] for _ in range(batch.num_rows)]
            waiting, new = [], set()

            def settle(waiting=waiting, new=new, out=out):
                learn(new)
                for row, chunks in waiting:
                    out[row].append(b"".join(map(known.__getitem__, chunks)))
                waiting.clear()
                new.clear()
                if len(known) > KEPT:
                    known.clear()
                    known.update(vocabulary.special)

            known.update(vocabulary.special)
            held = 0
            for row, chunks in _rows(vocabulary, texts):
                waiting.append((row, chunks))
                new.update(set(chunks).difference(known))
                held += len(chunks)
                if held > 1 << 16:
                    settle()
                    held = 0
            settle()
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([b"".join(x) for x in out], pa.binary())], [*kept, ids_col])

    return docs.select(*kept, F.col(text_col).alias("_text")).mapInArrow(run, T.StructType([*(docs.schema[c] for c in kept), T.StructField(ids_col, T.BinaryType())]))


def decode(encoded: DataFrame, ids_col: str = "ids", decoded_col: str = "decoded", path: str = VOCABULARY) -> DataFrame:
    """encoded with the tokens of its ids, special ones too, joined by one space, after its columns."""
    shared = _shared(encoded, path)

    def run(batches):
        tokens = _vocabulary(shared.value).tokens
        table = [tokens.get(i) for i in range(max(tokens) + 1)]
        holes = None in table

        def joined(ids: bytes | None) -> bytes:
            numbers = np.frombuffer(ids or b"", np.uint32)
            if holes or numbers.max(initial=0) >= len(table):
                return b" ".join([t for i in numbers.tolist() if (t := tokens.get(i)) is not None])
            return b" ".join(map(table.__getitem__, numbers.tolist()))

        for batch in batches:
            ids = batch.column(batch.schema.get_field_index(ids_col))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([joined(x) for x in ids.to_pylist()], pa.binary()).cast(pa.string())], [*batch.schema.names, decoded_col])

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField(decoded_col, T.StringType())]))
