"""Every query of this subpackage, and the pipeline, on empty tables, on rows without ids or texts, and on very long texts."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TABLES = {"documents": DOCS, "pages": "page_id long, url string, html string", "benchmark": "item_id long, text string", "embeddings": "vec_id long, embedding array<float>, label int"}
COLUMNS = {
    "op1_warc": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"], "op2_debruijn": ["doc_id", "n_words", "n_removed", "kept_sha256"], "op4_langid": ["doc_id", "held_out", "lang_pred", "score"],
    "op5_suffix": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"], "op6_lm": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"], "op7_line_dedup": ["doc_id", "n_lines", "n_removed", "kept_sha256"],
    "op8_mixing": ["doc_id", "size", "source_size", "target", "taken"], "op9_fertility": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op10_minhash": ["doc_id", "n_shingles", "component_id", "kept"], "op11_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"], "op12_whitening": ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
    "op13_merkle": ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
}


def written(spark, where, **rows):
    for name, schema in TABLES.items():
        spark.createDataFrame(rows.get(name, []), schema).repartition(2).write.parquet(f"{where}/{name}.parquet")
    return str(where)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_empty_tables(spark, tmp_path, name):
    out = queries.queries()[name](spark, written(spark, tmp_path))
    assert out.collect() == [] and (name not in COLUMNS or set(COLUMNS[name]) <= set(out.columns))


def odd_documents():
    rng = random.Random(4)
    say = lambda ws, n=60: " ".join(rng.choice(ws) for _ in range(n))
    english, german = "the house and water of with people under long street".split(), "der das und mit haus wasser unter lange nicht auch".split()
    rows = [(i, say(english), "en", rng.choice(["a", "b", None]), 300) for i in range(20)] + [(100 + i, say(german), "de", "a", 300) for i in range(20)]
    rows += [(None, say(english), "en", "a", 300), (None, None, None, None, None), (500, None, "en", "a", None), (501, "", None, None, 0), (502, " \n\t", "de", "b", 3), rows[3], rows[3], (None, say(english), None, "b", 300)]
    return rows


@pytest.mark.parametrize("name", [q for q in sorted(queries.queries()) if q not in ("op1_warc", "op3_cgk", "op12_whitening")])
def test_rows_without_ids_or_texts_each_get_a_row(spark, tmp_path, name):
    rows = odd_documents()
    assert queries.queries()[name](spark, written(spark, tmp_path, documents=rows)).count() == len(rows)


def test_pipeline_on_an_empty_table(spark, tmp_path):
    assert corpus_pipeline.run(spark, written(spark, tmp_path)).collect() == []


def test_pipeline_without_ids_labels_or_benchmark(spark, tmp_path):
    rows = odd_documents()
    out = corpus_pipeline.run(spark, written(spark, tmp_path / "a", documents=rows)).collect()
    # null and empty texts have no letters; rows that share an id stay or go together
    assert len(out) == sum(bool(r[1] and r[1].strip()) for r in rows)
    unlabelled = [(r[0], r[1], None, None, None) for r in rows]
    assert len(corpus_pipeline.run(spark, written(spark, tmp_path / "b", documents=unlabelled)).collect()) == len(out)


def test_very_long_texts(spark, tmp_path):
    rng = random.Random(9)
    long = "\n".join(" ".join(rng.choice(["alpha", "beta", "gamma", "délta"]) + str(rng.randrange(10**6)) for _ in range(12)) for _ in range(20_000))
    sf = written(spark, tmp_path, documents=[(1, long, "en", "a", len(long)), (2, "short text", "en", "a", 10)], pages=[(1, "u", long), (2, "v", long), (3, "w", None)])
    pages = {r["page_id"]: r for r in queries.op1_warc(spark, sf).collect()}
    digest = hashlib.sha256(long.encode()).hexdigest()
    assert [(pages[i]["payload_bytes"], pages[i]["payload_digest"], pages[i]["record_type"], pages[i]["refers_to"]) for i in (1, 2)] == [(len(long.encode()), digest, "response", None), (len(long.encode()), digest, "revisit", 1)]
    kept = {r["doc_id"]: r for r in queries.op7_line_dedup(spark, sf).collect()}
    assert (kept[1]["n_lines"], kept[1]["n_removed"], kept[1]["kept_sha256"]) == (20_000, 0, digest)
    mixed = queries.op8_mixing(spark, sf)
    assert mixed.agg(F.max("size")).first()[0] == 240_000 and all(0 <= r["taken"] <= 2 * r["size"] for r in mixed.collect())
