"""The kernels over one text of many slices: what they hold is bounded, whatever its length."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.common import prose
from tidemark.llm import debruijn, decontaminate, fertility, langid, lm, minhash, suffix_dedup
from tidemark.llm import kernels as K

MB = 1 << 20


@pytest.fixture(scope="module")
def text():
    """24 MB, of which some megabytes are different words."""
    rng = random.Random(1)
    parts = [" ".join(prose(rng, 60_000, "abcdefgh")) for _ in range(8)]
    raw = "\n".join(rng.choice(parts) for _ in range(24 * MB // len(parts[0])))
    return pa.array([raw])


def peak(f) -> float:
    tracemalloc.start()
    f()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return most / MB


def windows(text):
    for _, _, data, at, own in K.word_pieces(text, 12):
        debruijn._Windows(data, at, own, 13, 5)


def blocks(text):
    for _, _, data, at, own in K.pieces(text, 399):
        b = suffix_dedup.Blocks(data, at, own, 400, 40)
        for step in suffix_dedup.STEPS:
            b.cut(step)


def forward_sums(text):
    pieces = langid.Pieces([bytes([b]) for b in range(256)] + [b"abc", b"de"])
    p = np.full((pieces.n, 4), 1 / pieces.n)
    for _, _, data, at, _ in K.word_pieces(text):
        start, end, _ = langid.letter_words(data, at)
        sums = K.prefix_sums(data)
        s, e, _, _ = langid._unique(data, sums, start, end)
        for part in langid.in_chunks(s, (pieces.lengths[-1] + 1) * 4):
            langid.forward(pieces, p, sums, s[part], e[part])


def matches(text):
    words = text[0].as_py()[50_000:51_000].split()[1:40]
    assert decontaminate._best_matches(decontaminate.Items([1], [" ".join(words)]), text, 0.2)[0, 0][0] == 0


@pytest.mark.parametrize("f,most", [(windows, 60), (blocks, 60), (forward_sums, 90), (matches, 150)], ids=["op2", "op5", "op4", "op3"])
def test_pieces_are_bounded(text, f, most):
    assert peak(lambda: f(text)) < most


def test_hashes_of_words_are_what_is_held(text):
    """op6, op9 and op10 hold some arrays of eight bytes a word, not dozens of bytes a byte of text."""
    import sentencepiece

    size = len(text[0].as_py()) / MB
    model = sentencepiece.SentencePieceProcessor(model_file=fertility.VOCABULARY)

    def tokens():
        for _, hashes, first in K.hashed_words(text):
            lm.tokens(hashes, first)

    def sets():
        for _, hashes, first in K.hashed_words(text):
            minhash.shingle_sets(hashes, first, 5)

    # a word of this text has 4.5 bytes with its blank
    assert peak(tokens) < 12 * size
    assert peak(sets) < 20 * size
    assert peak(lambda: fertility.long_row(model, text)) < 25 * size + 200
