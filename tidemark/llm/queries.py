"""The queries of this subpackage, opN_<name>, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, debruijn, decontaminate, fertility, langid, line_dedup, lm, merkle, minhash, mixing, suffix_dedup, warc, whitening
from .common import bounded_batches, documents


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet")).drop("whole")


OP1_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT *, CASE WHEN n >= 100 AND page_id IS NOT NULL THEN min(page_id) OVER (PARTITION BY d) ELSE page_id END AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest, CASE WHEN first IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to FROM f
"""


def op2_debruijn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return debruijn.remove_repeats(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op3_cgk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held = langid.held_out("doc_id", 3, 1)
    model = langid.fit(docs.where(~held))
    return langid.predict(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op5_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeated(documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(documents(spark, sf_dir), langid.held_out("doc_id", 7, 2))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.remove_boilerplate(documents(spark, sf_dir))
    return kept.select("doc_id", "_lines.n_lines", "_lines.n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH rows AS (SELECT row_number() OVER () AS r, doc_id, source, string_split(text, chr(10)) AS parts FROM documents),
l AS (SELECT r, doc_id, source, unnest(parts) AS raw, generate_subscripts(parts, 1) AS pos FROM rows),
t AS (SELECT *, trim(raw, ' ' || chr(9) || chr(13) || chr(12) || chr(11)) AS line FROM l),
b AS (SELECT line, min(doc_id) AS first FROM t WHERE line <> '' AND doc_id IS NOT NULL GROUP BY line HAVING count(DISTINCT source) >= 5),
m AS (SELECT t.r, t.doc_id, t.pos, t.raw, coalesce(t.doc_id > b.first, false) AS gone FROM t LEFT JOIN b ON t.line = b.line),
g AS (SELECT r, count(*) AS n, count(*) FILTER (WHERE gone) AS n_gone, string_agg(raw, chr(10) ORDER BY pos) FILTER (WHERE NOT gone) AS kept FROM m GROUP BY r)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_gone, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM rows d LEFT JOIN g ON d.r = g.r
"""


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).drop("source", "copies")


def op9_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.judge(fertility.measure(documents(spark, sf_dir))).drop("band")


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.components(documents(spark, sf_dir), k=3, at_least=85)


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = bpe.decode(bpe.encode(documents(spark, sf_dir), keep=["doc_id"]))
    return both.select("doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose id's CRC-32 is divisible by 3 are held against the manifest with their A-Z in lower case."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    changed = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, lower).otherwise(F.col("text"))
    claimed = merkle.leaf("doc_id", "source", "lang", "n_chars", changed)
    proofs = merkle.manifest(documents(spark, sf_dir), ["doc_id", "source", "lang", "n_chars", "text"], keep={"claimed": claimed})
    return merkle.verify(proofs, "claimed").withColumnRenamed("id", "doc_id")


OP13_SQL = """
WITH RECURSIVE crc(i, k, x) AS (SELECT range, 0, range FROM range(256) UNION ALL SELECT i, k + 1, CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END FROM crc WHERE k < 8),
steps AS (SELECT list(x ORDER BY i) AS t FROM crc WHERE k = 8),
rows AS (SELECT doc_id, lang, text, list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])) AS crc,
  coalesce(length(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(length(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head
  FROM documents, steps),
hashed AS (SELECT doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
  sha256(head || CASE WHEN text IS NULL THEN '-' WHEN xor(crc, 4294967295) % 3 = 0 THEN strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE strlen(text) || ':' || text END) AS claimed FROM rows),
leaves AS (SELECT *, coalesce('t' || lang, '') AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM hashed),
nodes(level, tree, pos, n, digest) AS (SELECT 0, tree, pos, n, leaf FROM leaves
  UNION ALL SELECT level + 1, tree, pos // 8, any_value((n + 7) // 8), sha256(string_agg(digest, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY level, tree, pos // 8),
tops AS (SELECT tree, digest, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
over(level, pos, n, digest) AS (SELECT 0, pos, n, digest FROM tops
  UNION ALL SELECT level + 1, pos // 8, any_value((n + 7) // 8), sha256(string_agg(digest, '' ORDER BY pos)) FROM over WHERE n > 1 GROUP BY level, pos // 8),
sides AS (SELECT level, tree, pos, coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM nodes WHERE n > 1 WINDOW w AS (PARTITION BY level, tree, pos // 8 ORDER BY pos)),
over_sides AS (SELECT level, pos, coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM over WHERE n > 1 WINDOW w AS (PARTITION BY level, pos // 8 ORDER BY pos)),
folds(level, tree, first, pos, digest, proof) AS (SELECT 0, tree, pos, pos, claimed, '' FROM leaves
  UNION ALL SELECT f.level + 1, f.tree, f.first, f.pos // 8, sha256(l || f.digest || r), proof || l || r FROM folds f JOIN sides s ON f.level = s.level AND f.tree = s.tree AND f.pos = s.pos),
ended AS (SELECT f.tree, f.first, t.digest AS subroot, t.pos, f.digest, f.proof FROM folds f JOIN (SELECT tree, max(level) AS level FROM nodes GROUP BY tree) h ON f.tree = h.tree AND f.level = h.level JOIN tops t ON f.tree = t.tree),
last(level, tree, first, subroot, pos, digest, proof) AS (SELECT 0, tree, first, subroot, pos, digest, proof FROM ended
  UNION ALL SELECT f.level + 1, f.tree, f.first, f.subroot, f.pos // 8, sha256(l || f.digest || r), proof || l || r FROM last f JOIN over_sides s ON f.level = s.level AND f.pos = s.pos)
SELECT d.doc_id, d.leaf, f.subroot, (SELECT digest FROM over WHERE n = 1) AS root, sha256(f.proof) AS proof_sha256, f.digest AS folded_root, f.digest = (SELECT digest FROM over WHERE n = 1) AS verified
FROM leaves d JOIN last f ON d.tree = f.tree AND d.pos = f.first WHERE f.level = (SELECT max(level) FROM over)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_warc, op2_debruijn, op3_cgk, op4_langid, op5_suffix, op6_lm, op7_line_dedup, op8_mixing, op9_fertility, op10_minhash, op11_bpe, op12_whitening, op13_merkle)}


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": OP1_SQL, "op7_line_dedup": OP7_SQL, "op13_merkle": OP13_SQL}
