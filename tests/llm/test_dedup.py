"""Operators 2, 5, 7 and 10 against brute force."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.common import LOWER, SCHEMA, WORD, corpus, frame, prose
from tidemark.llm import debruijn, line_dedup, minhash, suffix_dedup
from tidemark.llm import kernels as K


def brute_windows(rows, k):
    words, first = {r[0]: WORD.findall(r[1] or "") for r in rows}, {}
    for d, w in words.items():
        for i in range(len(w) - k + 1):
            g = tuple(w[i : i + k])
            first[g] = min(first.get(g, d), d)
    out = {}
    for d, w in words.items():
        gone = {j for i in range(len(w) - k + 1) if first[tuple(w[i : i + k])] < d for j in range(i, i + k)}
        out[d] = (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))
    return out


@pytest.mark.parametrize("seed,window,anchor,letters", [(1, 13, 5, "abcdefgh"), (2, 4, 2, "ab"), (3, 3, 1, "a")])
def test_debruijn(spark, seed, window, anchor, letters):
    rows = corpus(seed, letters=letters)
    got = {r[0]: tuple(r)[1:] for r in debruijn.remove_repeats(frame(spark, rows), window=window, anchor=anchor).collect()}
    assert got == brute_windows(rows, window)


def test_debruijn_repeated_rows_and_ids(spark):
    rows = [(1, "a b c d e f", *[None] * 7)] * 2 + [(2, "x a b c d y", *[None] * 7), (None, "a b\t c d", *[None] * 7), (2, "p q r s", *[None] * 7), (3, "p q r s c d e f", *[None] * 7)]
    got = sorted(tuple(r) for r in debruijn.remove_repeats(frame(spark, rows).na.drop(subset=["doc_id"]), window=4, anchor=2).collect())
    assert got == [(1, 6, 0, "a b c d e f"), (1, 6, 0, "a b c d e f"), (2, 4, 0, "p q r s"), (2, 6, 4, "x y"), (3, 8, 8, "")]
    alone = [tuple(r) for r in debruijn.remove_repeats(frame(spark, rows), window=4, anchor=2).collect() if r[0] is None]
    assert alone == [(None, 4, 0, "a b c d")]


def test_debruijn_wrong_span_is_found(spark):
    """verify() holds words against those at the source."""
    span = "array<struct<start:int,size:int,src:bigint,src_copy:bigint,src_start:int>>"
    mine = (0, 3, 1, 5, 0)
    work = spark.createDataFrame([(1, 5, "a b c d", [mine]), (2, 5, "a b x d", [mine]), (3, 5, "q a b  c", [(1, 3, 1, 5, 0)])], f"id long, copy long, text string, spans {span}")
    assert [tuple(r) for r in debruijn.verify(work).collect()] == [(2, 5, 0, 1, 5, 0)]


def test_debruijn_of_texts_longer_than_a_slice(spark):
    rng = random.Random(5)
    words = prose(rng, 130_000, "abcdefgh")
    long = " \n".join(words)
    assert len(long) > 2 * K.SLICE_BYTES
    rows = [(1, " ".join(words[40_000:90_000]), *[None] * 7), (2, long, *[None] * 7), (3, "x " + long + " y", *[None] * 7), (4, "short one", *[None] * 7)]
    got = {r[0]: tuple(r)[1:] for r in debruijn.remove_repeats(frame(spark, rows)).collect()}
    assert got == brute_windows(rows, 13)


def brute_bytes(rows, k):
    raw, n = [(r[0], (r[1] or "").encode()) for r in rows], defaultdict(int)
    for _, x in raw:
        for i in range(len(x) - k + 1):
            n[x[i : i + k]] += 1
    out = []
    for d, x in raw:
        gone = [False] * len(x)
        for i in range(len(x) - k + 1):
            if n[x[i : i + k]] > 1:
                gone[i : i + k] = [True] * k
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d, len(x), sum(gone), runs, bytes(c for c, g in zip(x, gone) if not g)))
    return sorted(out)


@pytest.mark.parametrize("seed,threshold,gram,steps", [(1, 400, 40, (512, 32, 4, 1)), (2, 20, 5, (32, 4, 1)), (4, 60, 8, (64, 8, 1))])
def test_suffix(spark, seed, threshold, gram, steps):
    rows = corpus(seed)
    got = sorted(tuple(r[:4]) + (bytes(r[4]),) for r in suffix_dedup.remove_repeated(frame(spark, rows), threshold=threshold, gram=gram, steps=steps).collect())
    assert got == brute_bytes(rows, threshold)


def test_suffix_repeated_rows(spark):
    rows = [(1, "abcdefghijklmnopqrstuvwxyz" * 2, *[None] * 7)] * 2 + [(2, "0123456789abcdefghijklmnopqrstuvwxyz", *[None] * 7)]
    got = sorted(tuple(r[:4]) + (bytes(r[4]),) for r in suffix_dedup.remove_repeated(frame(spark, rows), threshold=20, gram=5, steps=(32, 4, 1)).collect())
    assert got == brute_bytes(rows, 20)


def test_suffix_rows_without_id_and_one_id_with_two_texts(spark):
    alphabet = "abcdefghijklmnopqrstuvwxyz"
    rows = [(1, alphabet, *[None] * 7), (1, "0123" + alphabet, *[None] * 7), (None, alphabet * 2, *[None] * 7), (2, None, *[None] * 7)]
    got = {(r[0], r[1], r[2], r[3], bytes(r[4])) for r in suffix_dedup.remove_repeated(frame(spark, rows), threshold=20, gram=5, steps=(32, 4, 1)).collect()}
    assert got == {(1, 26, 26, 1, b""), (1, 30, 26, 1, b"0123"), (None, 52, 0, 0, alphabet.encode() * 2), (2, 0, 0, 0, b"")}


def test_suffix_of_texts_longer_than_a_slice(spark):
    rng = random.Random(5)
    long = " ".join(prose(rng, 150_000, "abcdefgh"))
    assert len(long) > 2 * K.SLICE_BYTES
    rows = [(1, long[100_000:400_000], *[None] * 7), (2, long, *[None] * 7), (3, "xx" + long[: K.SLICE_BYTES + 300], *[None] * 7)]
    got = sorted(tuple(r[:4]) + (bytes(r[4]),) for r in suffix_dedup.remove_repeated(frame(spark, rows)).collect())
    assert got == brute_bytes(rows, 400)


def test_suffix_batches_without_any_span(spark):
    """The bit map lets some texts through that lose nothing; they can fill a batch of their own."""
    spans = "array<struct<start:bigint,n:int,span:bigint>>"
    work = spark.createDataFrame([(1, "abc", None), (2, None, None), (3, "", [])], f"id long, text string, spans {spans}").coalesce(1)
    got = work.mapInArrow(suffix_dedup._remove(3), suffix_dedup.SCHEMA).collect()
    assert [tuple(r[:4]) + (bytes(r[4]),) for r in got] == [(1, 3, 0, 0, b"abc"), (2, 0, 0, 0, b""), (3, 0, 0, 0, b"")]


def test_suffix_equal_hashes_of_other_bytes_stay(spark):
    """unlike() finds runs that only a hash brought together."""
    spans = "array<struct<start:bigint,n:int,span:bigint>>"
    work = spark.createDataFrame([(1, 1, "abcdef", [(0, 2, 9)]), (2, 2, "xabcdefg", [(1, 2, 9), (3, 1, 8)]), (3, 3, "qbcdef", [(0, 2, 9)])], f"id long, copy long, text string, spans {spans}")
    assert sorted(map(tuple, suffix_dedup.unlike(work, 3).collect())) == [(2, 2, 3, 1), (3, 3, 0, 2)]


def brute_lines(rows, sites):
    blanks = " \t\r\f\x0b"
    where, first = defaultdict(set), {}
    for d, text, _, site, *_ in rows:
        for line in (text or "").split("\n"):
            line = line.strip(blanks)
            where[line] |= {site} - {None}
            first[line] = min(first.get(line, d), d)
    common = {x for x, s in where.items() if x and len(s) >= sites}
    out = {}
    for d, text, *_ in rows:
        parts = [] if text is None else text.split("\n")
        keep = [x for x in parts if not (x.strip(blanks) in common and first[x.strip(blanks)] < d)]
        out[d] = (len(parts), len(parts) - len(keep), None if text is None else "\n".join(keep))
    return out


@pytest.mark.parametrize("sites", [2, 3, 5])
def test_lines(spark, sites):
    rows = corpus(5)
    got = line_dedup.remove_boilerplate(frame(spark, rows), min_sites=sites)
    assert got.columns[:-1] == [x.split()[0] for x in SCHEMA.split(", ")]
    assert {r["doc_id"]: (r["_lines"]["n_lines"], r["_lines"]["n_removed"], r["text"]) for r in got.collect()} == brute_lines(rows, sites)


def test_lines_of_rows_with_one_id_and_clashing_names(spark):
    common = [(i + 10, "other\nmine %d" % i, None, f"s{i}", None) for i in range(5)]
    rows = [(50, "precious\nother", None, "s1", "x"), (50, "other\nprecious", None, "s1", "y"), (None, "other\nz", None, "s2", "z"), (51, None, None, "s2", "w"), *common]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _gone string, source string, _lines string").withColumn("_gone_id", F.lit(1)).withColumn("copy", F.lit("c")).withColumn("gone", F.lit(2))
    got = line_dedup.remove_boilerplate(docs)
    assert got.columns == ["doc_id", "text", "_gone", "source", "_gone_id", "copy", "gone", "_lines"]
    assert sorted(r["text"] for r in got.collect() if r["doc_id"] == 50) == ["precious", "precious"]
    assert {r["doc_id"]: r["text"] for r in got.collect() if r["doc_id"] in (None, 10, 11, 51)} == {None: "other\nz", 10: "other\nmine 0", 11: "mine 1", 51: None}


def brute_components(rows, k, at_least):
    sets = {}
    for d, text, *_ in rows:
        w = WORD.findall((text or "").translate(LOWER))
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            inter = len(sets[a] & sets[b])
            if inter and 100 * inter >= at_least * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d), find(d) == d) for d in ids}


@pytest.mark.parametrize("seed,k,at_least", [(1, 3, 85), (6, 5, 80), (7, 1, 60)])
def test_components(spark, seed, k, at_least):
    rows = corpus(seed, letters="abcdefgh" if k > 1 else "abcdefghijklmnopqrst")
    got = {r[0]: tuple(r)[1:] for r in minhash.components(frame(spark, rows), k=k, at_least=at_least).collect()}
    assert got == brute_components(rows, k, at_least)


@pytest.mark.parametrize("crowd", [256, 1, 0])
def test_components_in_a_large_group(spark, monkeypatch, crowd):
    """Many near copies of one text, few of which reach the threshold with the first: no link may be lost."""
    import random

    rng = random.Random(3)
    base = [f"w{i}" for i in range(220)]
    rows = []
    for d in range(240):
        w = list(base)
        for _ in range(rng.randint(1, 9)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(40)}"
        rows.append((d, " ".join(w), *[None] * 7))
    monkeypatch.setattr(minhash, "CROWD", crowd)  # in pairs; in blocks
    got = {r[0]: tuple(r)[1:] for r in minhash.components(frame(spark, rows), k=3, at_least=85).collect()}
    assert got == brute_components(rows, 3, 85)


def test_prefixes_bring_every_similar_pair_together(spark):
    rng = random.Random(5)
    sets = []
    for i in range(120):
        base = set(rng.sample(range(400), 30)) if i % 4 == 0 else base
        own = set(rng.sample(sorted(base), 30 - rng.randint(0, 2))) | set(rng.sample(range(400), rng.randint(0, 2)))
        sets.append((i, i, len(own), np.sort(np.array(sorted(own), np.uint64)).tobytes(), own))
    df = spark.createDataFrame([r[:4] for r in sets], "id long, s long, n long, set binary")
    keys = {}
    for r in minhash.prefixes(df, 85, 100).collect():
        keys.setdefault(r["id"], set()).add(r["key"])
    pairs = [(a, b) for a in range(120) for b in range(a) if 100 * len(sets[a][4] & sets[b][4]) >= 85 * len(sets[a][4] | sets[b][4])]
    assert len(pairs) > 20 and all(keys[a] & keys[b] for a, b in pairs)
    assert max(len(k) for k in keys.values()) <= 32 - 28 + 1


def test_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for df in (debruijn.remove_repeats(docs), suffix_dedup.remove_repeated(docs), line_dedup.remove_boilerplate(docs), minhash.components(docs)):
        assert df.collect() == []


def test_estimate_is_near_jaccard():
    import numpy as np

    values = np.arange(6000, dtype=np.uint64)
    from tidemark.llm import kernels as K

    h = K.mix(values * np.uint64(7919))
    both = np.concatenate((h[:5000], h[1000:]))
    regs = minhash.sketch(both, np.repeat([0, 1], 5000), 2)
    got, n = minhash.estimate(regs[:1], regs[1:], np.array([5000.0]), np.array([5000.0]))
    assert n[0] == minhash.REGISTERS and abs(got[0] - 4000 / 6000) < 0.2
    assert hashlib.sha256(regs.tobytes()).hexdigest() == hashlib.sha256(minhash.sketch(both, np.repeat([0, 1], 5000), 2).tobytes()).hexdigest()


@pytest.mark.parametrize("share", [0.8, 0.85])
def test_pairs_at_the_threshold_meet_and_pass(share):
    """Sketches alone: of pairs exactly at the threshold all share a band and pass the estimate (2000 pairs; fewer than one in 10,000 may not)."""
    import numpy as np

    rng = np.random.default_rng(7)
    n, union = 2000, 300
    both = round(share * union)
    own = (union - both) // 2
    values = rng.integers(0, 2**64, (n, union), dtype=np.uint64)
    left, right = values[:, : both + own], np.concatenate((values[:, :both], values[:, both + own :]), axis=1)
    x, y = (minhash.sketch(v.reshape(-1), np.repeat(np.arange(n), v.shape[1]), n) for v in (left, right))
    band = minhash.band_size(share)
    assert (minhash.band_keys(x, band) == minhash.band_keys(y, band)).any(axis=1).all()
    assert minhash.passes(x, y, np.full(n, float(left.shape[1])), np.full(n, float(right.shape[1])), share).all()
    # unrelated documents, and half-alike ones, seldom meet
    z = minhash.sketch(rng.integers(0, 2**64, n * 260, dtype=np.uint64), np.repeat(np.arange(n), 260), n)
    assert (minhash.band_keys(x, band) == minhash.band_keys(z, band)).any(axis=1).mean() < 0.01


def test_a_group_just_below_the_threshold(spark):
    """Near copies of one text that are .7 to .84 alike: nothing is linked, and full sets meet in blocks without a pair coming out."""
    rng = random.Random(13)
    base = [f"w{i}" for i in range(240)]
    rows = []
    for d in range(150):
        w = list(base)
        for at in range(rng.randrange(12), 240, 26):
            w[at] = f"x{d}" if rng.random() < 0.3 else f"y{rng.randrange(9)}"
        rows.append((d, " ".join(w), *[None] * 7))
    got = {r[0]: tuple(r)[1:] for r in minhash.components(frame(spark, rows), k=3, at_least=85).collect()}
    want = brute_components(rows, 3, 85)
    assert got == want and sum(v[2] for v in want.values()) > 100


def test_components_of_rows_without_id_and_one_id_with_two_texts(spark):
    a, b, c = (" ".join(prose(random.Random(i), 60)) for i in (1, 2, 3))
    rows = [(1, a, *[None] * 7), (5, a, *[None] * 7), (5, b, *[None] * 7), (7, b + " end", *[None] * 7), (9, c, *[None] * 7), (None, a, *[None] * 7), (9, c, *[None] * 7), (4, "", *[None] * 7)]
    got = sorted(minhash.components(frame(spark, rows), k=3, at_least=85).select("doc_id", "component_id", "kept").collect(), key=str)
    assert sorted(map(tuple, got), key=str) == sorted([(1, 1, True), (5, 1, False), (5, 1, False), (7, 1, False), (9, 9, True), (9, 9, True), (None, None, True), (4, 4, True)], key=str)


def test_full_sets_are_there_once_without_a_shuffle_of_all(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (1, "a b c e"), (2, "a b c d")], "id long, text string")
    ids = docs.select("id").distinct()
    sets = minhash.full_sets(docs, ids, ids.where("id = 1"), 3).collect()
    assert sorted(r["id"] for r in sets) == [1, 1, 2] and len({r["s"] for r in sets}) == 3
