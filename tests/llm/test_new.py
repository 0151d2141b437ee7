"""BPE, whitening and the Merkle manifest against the library, numpy and plain trees."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest

from tidemark.llm import bpe, merkle, queries, transducer, whitening

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, pos long, path string, word string, n long"
ODD = [None, "", " \n\t ", "one", "Don't I'LL they're ''s a'sb x'T", "Ünï ÇÖDÉ Σίσυφος İıẞ", "a<|endoftext|>b <|StartOfText|><|startoftext|≯", "日本語の文 、ไทย 한글가 🙂‍", "12 ½ Ⅷ ٣٤", "\x00\x1c\x85 x　y", "é́ a̸ ̸", "x" * 30_000, "ab" * 9_000 + "!" * 700, "퟿ ﬁ ǅ"]


def docs(seed=5, n=150):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeABCéß'.,!019") for _ in range(rng.randint(1, 9))) for _ in range(80)]
    texts = [*ODD, *(" ".join(rng.choice(words) for _ in range(rng.randint(1, 90))) for _ in range(n))]
    rows = [(i, t, rng.choice(["en", "fr", None, "日本", ""]), rng.choice(["s1", "s2", None]), rng.choice([None, 4, 77]), "x", 3, "p", "w", 1) for i, t in enumerate(texts)]
    rows += rows[3:9] + [(None, "Null Id", "en", None, None, "x", 3, "p", "w", 1)] * 3
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.VOCABULARY)


@pytest.mark.parametrize("most", [0, 40, 1 << 16])
def test_bpe_equals_the_library(spark, library, most):
    rows = docs()
    df = frame(spark, rows)
    out = bpe.decode(bpe.encode(df, lexicon_name=bpe.lexicon(df, most=most)))
    assert out.columns == [*df.columns, "ids", "decoded"]
    got = sorted((r["doc_id"] or -1, r["text"] or "", np.frombuffer(r["ids"], "<u4").tolist(), r["decoded"]) for r in out.collect())
    want = []
    for r in rows:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        want.append((r[0] or -1, r[1] or "", ids, library.decode(ids, skip_special_tokens=False)))
    assert got == sorted(want)


def test_bpe_of_texts_longer_than_a_slice(spark, library):
    rng = random.Random(1)
    text = " ".join("".join(rng.choice("abcdé日,") for _ in range(rng.randint(1, 12))) for _ in range(60_000))
    out = bpe.encode(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert np.frombuffer(out["ids"], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_bpe_of_any_characters(library):
    with open(bpe.VOCABULARY, "rb") as f:
        v = bpe.Vocabulary(f.read())
    rng = random.Random(2)
    pool = "abcdeABC'’ \t\n\x1c\x85 　.,!?<|>0129٣½ÉéÁ̸́ΣσςİIıßẞΩΩ日本ไทย🙂‍\x00\x07ǅﬁ한글가𝒳Ⅷ②"
    for _ in range(3000):
        s = "".join(rng.choice(pool) for _ in range(rng.randint(0, 30))).replace("<", rng.choice(["<", "<|endoftext|>"]))
        ids = b"".join(v.special.get(c) or b"".join(map(v.merged, v.words(c))) for c in v.chunks(s.encode()))
        assert np.frombuffer(ids, np.uint32).tolist() == library.encode(s, add_special_tokens=False).ids


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert bpe.decode(bpe.encode(none)).collect() == []
    assert merkle.verify(merkle.manifest(none, ["doc_id", "text"], keep={"claimed": merkle.leaf("text")}), "claimed").collect() == []
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, x int")
    assert whitening.whiten(vectors).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, []), (2, None)], "vec_id long, embedding array<float>")).collect() == []


def test_transducer_is_minimal_and_exact(tmp_path):
    rng = random.Random(4)
    words = sorted({bytes(rng.choices(b"ab", k=rng.randint(1, 7))) + rng.choice([b"ing", b"ed", b""]) for _ in range(400)})
    (tmp_path / "t").write_bytes(transducer.compiled((w, [i, 7]) for i, w in enumerate(words)))
    t = transducer.Transducer(str(tmp_path / "t"))
    assert t.numbers(words).tolist() == list(range(len(words)))
    assert t.found(words[:2]) == [np.array([i, 7], np.uint32).tobytes() for i in range(2)]
    others = [w for w in {w[:k] for w in words for k in range(8)} | {w + b"x" for w in words} if w not in set(words)]
    assert set(t.numbers(others).tolist()) == {-1}
    # as many states as there are different sets of endings (Myhill and Nerode)
    prefixes = {w[:k] for w in words for k in range(len(w) + 1)}
    assert t.states == len({frozenset(w[len(p) :] for w in words if w.startswith(p)) for p in prefixes})
    (tmp_path / "e").write_bytes(transducer.compiled([]))
    assert transducer.Transducer(str(tmp_path / "e")).found([b"a", b""]) == [None, None]
    with pytest.raises(ValueError, match="sorted"):
        transducer.compiled([(b"b", []), (b"a", [])])


def vectors(seed=3, n=400, d=10):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) @ rng.normal(size=(d, d)) + rng.normal(size=d) * 5
    rows = [(i, [float(np.float32(c)) for c in v], "x", 1) for i, v in enumerate(x)]
    bad = [(900, None, "x", 1), (901, [1.0] * (d - 1) + [None], "x", 1), (902, [float("nan")] * d, "x", 1), (903, [float("-inf")] + [0.0] * (d - 1), "x", 1), (904, [], "x", 1), (905, [1.0], "x", 1), (906, [1e30] * d, "x", 1)]
    return rows + [rows[0]] * 3 + [(None, *rows[1][1:])] + bad, len(bad)


@pytest.mark.parametrize("scale", [1, 1 << 14, 1 << 27])
def test_whitening_against_numpy(spark, scale):
    rows, bad = vectors()
    rows = [(i, v and [c * scale if c is not None and abs(c) < 1e20 else c for c in v], *rest) for i, v, *rest in rows]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, x string, n long").repartition(4)
    got = whitening.whiten(df, components=6).collect()
    kept = rows[:-bad]
    x = [[int(np.floor(64 * c)) + 1000000 for c in v] for _, v, *_ in kept]
    n, d = len(x), len(x[0])
    sums = [sum(r[i] for r in x) for i in range(d)]
    centred = np.array([[n * r[i] - sums[i] for i in range(d)] for r in x], object)
    covariance = np.array([[float(sum(a * b for a, b in zip(centred[:, i], centred[:, j]))) / n**3 for j in range(d)] for i in range(d)])
    e, axes = np.linalg.eigh(covariance)
    e, axes = e[::-1], axes[:, ::-1]
    want = (centred / n).astype(float) @ (axes / np.sqrt(e))
    deviation = [v if (v := sum(c * c for c in r)) < 1 << 63 else None for r in centred]
    assert len(got) == n * 6 and {r["n"] for r in got} == {n}
    signs = {}
    for k in range(6):
        mine = sorted((r["vec_id"] if r["vec_id"] is not None else -1, abs(r["whitened"])) for r in got if r["component"] == k + 1)
        his = sorted((kept[i][0] if kept[i][0] is not None else -1, abs(want[i, k])) for i in range(n))
        assert np.allclose([m[1] for m in mine], [h[1] for h in his], atol=1e-6)
        signs[k] = {np.sign(r["whitened"] * want[r["vec_id"], k]) for r in got if r["component"] == k + 1 and r["vec_id"] is not None and abs(want[r["vec_id"], k]) > 1e-3}
        assert len(signs[k]) == 1
    assert {(r["vec_id"], r["deviation"]) for r in got} == {(kept[i][0], deviation[i]) for i in range(n)}
    assert all(abs(r["explained"] - e[r["component"] - 1] / e.sum()) < 1e-9 for r in got)
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9


def test_whitening_where_nothing_varies(spark):
    flat = spark.createDataFrame([(i, [1.0, float(i), 2.0]) for i in range(5)], "vec_id long, embedding array<double>")
    got = whitening.whiten(flat).collect()
    assert {(r["component"], r["whitened"] is None, r["explained"]) for r in got} == {(1, False, 1.0), (2, True, 0.0), (3, True, 0.0)}
    one = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])], "vec_id long, embedding array<double>")).collect()
    assert [(r["whitened"], r["explained"], r["deviation"], r["identity_error"]) for r in one] == [(None, None, 0, 0.0)] * 2


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r, text):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], r[4], text)))


def tree(leaves):
    """The root, and each leaf's siblings as (left, right), by plain levels."""
    level, where, paths = leaves, list(range(len(leaves))), [[] for _ in leaves]
    while len(level) > 1:
        runs = [level[i : i + 8] for i in range(0, len(level), 8)]
        for p, w in zip(paths, where):
            p.append(("".join(runs[w // 8][: w % 8]), "".join(runs[w // 8][w % 8 + 1 :])))
        where, level = [w // 8 for w in where], [h(*r) for r in runs]
    return level[0], paths


def plain_manifest(rows):
    groups = {}
    for r in rows:
        changed = r[1] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[1]) if changed else r[1]
        groups.setdefault(r[2], []).append((-1 if r[0] is None else r[0], leaf(r, r[1]), leaf(r, lowered)))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([x[1] for x in sorted(groups[g])]) for g in names}
    root, over = tree([trees[g][0] for g in names])
    out = []
    for g, up in zip(names, over):
        for (i, d, claimed), path in zip(sorted(groups[g]), trees[g][1]):
            folded = claimed
            for left, right in path + up:
                folded = h(left, folded, right)
            out.append((i, d, trees[g][0], root, h(*(a + b for a, b in path + up)), folded, folded == root))
    return sorted(out)


def test_merkle_against_plain_trees(spark, tmp_path):
    rows = docs(n=1300)
    for sample in (rows, rows[:1], [r for r in rows if r[2] == "en"][:9]):
        frame(spark, sample).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
        got = queries.op13_merkle(spark, str(tmp_path))
        assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
        assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in got.collect()) == plain_manifest(sample)


def test_merkle_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    want = con.execute(queries.OP13_SQL)
    columns = [c[0] for c in want.description]
    assert sorted(map(tuple, queries.op13_merkle(spark, sf).select(columns).collect())) == sorted(want.fetchall())


def test_blocks_give_the_same_tree_as_levels():
    rng = random.Random(6)
    for n in (1, 2, 8, 9, 64, 65, 511, 512):
        leaves = [rng.randbytes(32) for _ in range(n)]
        paths = [[] for _ in leaves]
        root = merkle.traverse(leaves, merkle.height(n), paths)
        assert root.hex() == tree([x.hex() for x in leaves])[0]
        assert all(merkle.fold(x, b"".join(p))[0] == root for x, p in zip(leaves, paths))
    assert merkle.height(513) == merkle.LEVELS
