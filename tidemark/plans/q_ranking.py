"""Queries of top-k search, scores and the retrieval plan."""

from pyspark.sql import functions as F

from ..operators import ranking as R
from ..operators.dedup import representation_rank
from ..operators.graph import strength
from ..operators.vector_index import VectorIndex
from .registry import query

NEAREST = "SELECT query, point, similarity, rank FROM (SELECT q.vec_id AS query, p.vec_id AS point, round(list_cosine_similarity(CAST(p.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS similarity, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(CAST(p.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) DESC, p.vec_id) AS rank FROM embeddings p, embeddings q WHERE q.vec_id % 50 = 0{where}) WHERE rank <= {k}"


def search(embeddings, points, k):
    queries = embeddings.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("q_vector"))
    return R.top_k(queries, points.select(F.col("vec_id").alias("point"), F.col("embedding").alias("vector")), k).select("query", "point", "similarity", "rank")


@query("topk01_cosine", NEAREST.format(where="", k=10), "t:embeddings")
def _(embeddings):
    return search(embeddings, embeddings, 10)


@query("topk01_indexed", NEAREST.format(where="", k=10), "t:embeddings")
def _(embeddings):
    index = VectorIndex(embeddings.select(F.col("vec_id").alias("point"), F.col("embedding").alias("vector")))
    return index.search(embeddings.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("q_vector")), 10)


@query("topk02_branches", NEAREST.format(where=" AND p.label IN (1, 3, 5)", k=5), "t:embeddings")
def _(embeddings):
    return search(embeddings, embeddings.where(F.col("label").isin(1, 3, 5)), 5)


@query("topk03_overlay_forced", "SELECT id, score FROM (SELECT id, score, row_number() OVER (PARTITION BY path, substr(text, 1, 200) ORDER BY pri, score DESC, id) AS r FROM (SELECT id, path, text, 1.0 AS score, 0 AS pri FROM chunks WHERE path LIKE '%part7.%' UNION ALL SELECT id, path, text, score, 1 FROM chunks WHERE branch = 'feature/search' AND score > 0.5)) WHERE r = 1", "chunks")
def _(chunks):
    forced = chunks.where("path like '%part7.%'").select("id", "path", "text", F.lit(1.0).alias("score"), F.lit(0).alias("pri"))
    hits = chunks.where("branch = 'feature/search' and score > 0.5").select("id", "path", "text", "score", F.lit(1).alias("pri"))
    return R.first_rows(forced.unionByName(hits), [F.col("path"), F.substring("text", 1, 200)], [F.col("pri"), F.desc("score"), F.col("id")]).select("id", "score")


@query("topk04_point_order", "SELECT id, path FROM chunks ORDER BY path, start_line, end_line, primary_name, id LIMIT 100", "chunks")
def _(chunks):
    return chunks.orderBy("path", "start_line", "end_line", "primary_name", "id").limit(100).select("id", "path")


@query("topk05_rules", "SELECT p_partkey AS id, p_size AS priority FROM part WHERE p_partkey % 2 = 0 ORDER BY p_size, p_partkey LIMIT 50", "t:part")
def _(part):
    return part.where("p_partkey % 2 = 0").orderBy("p_size", "p_partkey").limit(50).select(F.col("p_partkey").alias("id"), F.col("p_size").alias("priority"))


SEV = "CASE severity WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 3 ELSE 4 END"


@query("topk06_notable", f"SELECT project_id, id FROM (SELECT project_id, id, row_number() OVER (PARTITION BY project_id ORDER BY {SEV}, id) AS r FROM issues) WHERE r <= 3", "issues")
def _(issues):
    from ..operators.aggregates import severity_rank

    return R.cap_per(issues, ["project_id"], 3, [severity_rank(F.col("severity")), F.col("id")]).select("project_id", "id")


@query("topk07_page", "SELECT id FROM issues ORDER BY id DESC LIMIT 20 OFFSET 60", "issues")
def _(issues):
    return issues.orderBy(F.desc("id")).offset(60).limit(20).select("id")


@query("topk08_stable_priority", "SELECT id, resolved FROM issues ORDER BY resolved, id LIMIT 200", "issues")
def _(issues):
    return issues.orderBy("resolved", "id").limit(200).select("id", "resolved")


@query("topk09_query_cap", "SELECT path, id FROM (SELECT path, id, row_number() OVER (PARTITION BY path ORDER BY score DESC, id) AS r FROM chunks) WHERE r <= 12", "chunks")
def _(chunks):
    return R.cap_per(chunks, ["path"], 12, [F.desc("score"), F.col("id")]).select("path", "id")


@query("topk10_metadata_neighbours", "SELECT c.id FROM chunks c, (SELECT * FROM chunks WHERE id = 11) p WHERE c.id <> p.id AND (c.path = p.path OR c.primary_name = p.primary_name OR c.parent_class = p.parent_class OR c.namespace = p.namespace)", "chunks")
def _(chunks):
    point = F.broadcast(chunks.where("id = 11").limit(1).select(*[F.col(c).alias(f"p_{c}") for c in ("id", "path", "primary_name", "parent_class", "namespace")]))
    same = [F.coalesce(F.col(c) == F.col(f"p_{c}"), F.lit(False)) for c in ("path", "primary_name", "parent_class", "namespace")]
    return chunks.join(point, (F.col("id") != F.col("p_id")) & (same[0] | same[1] | same[2] | same[3])).select("id")


BOOST = "CASE content_type WHEN 'functions_classes' THEN 1.1 WHEN 'simplified_code' THEN 1.0 WHEN 'fallback' THEN 0.95 WHEN 'oversized_split' THEN 0.8 ELSE 1.0 END"
THIN = "CASE WHEN density < 0 THEN 0.85 WHEN density < 0.1 THEN 0.3 + 0.7 * density / 0.1 ELSE 1.0 END"


@query("scr01_03_boost_density_cap", f"SELECT id, round(least(score * CAST({BOOST} AS DOUBLE) * CAST({THIN} AS DOUBLE), 1.0), 6) AS score FROM chunks", "chunks")
def _(chunks):
    return chunks.select("id", F.round(R.boost(F.col("score"), F.col("content_type"), F.col("density")), 6).alias("score"))


@query("scr04_ecosystem", "SELECT id, round(score * CASE WHEN language <> 'en' THEN 0.2 ELSE 1.0 END, 6) AS score FROM chunks", "chunks")
def _(chunks):
    return chunks.select("id", F.round(F.col("score") * R.ecosystem_factor(F.col("language"), F.lit("en")), 6).alias("score"))


@query("scr05_oversize", "SELECT id, round(CASE WHEN length(text) > 2000 THEN greatest(0.5, 1 - (least(length(text) / 2000, 3) - 1) * 0.5 / 2) ELSE 1.0 END, 6) AS factor FROM chunks", "chunks")
def _(chunks):
    return chunks.select("id", F.round(R.size_factor(F.length("text"), 2000), 6).alias("factor"))


@query("scr06_threshold_fallback", "SELECT id FROM chunks WHERE branch = 'main' AND score >= 0.9 UNION ALL SELECT id FROM (SELECT id FROM chunks WHERE branch = 'develop' ORDER BY score DESC, id LIMIT 5)", "chunks")
def _(chunks):
    return R.threshold_or_best(chunks.where("branch = 'main'"), "score", 0.9, 5, "id").unionByName(R.threshold_or_best(chunks.where("branch = 'develop'"), "score", 1.9, 5, "id")).select("id")


DIR = "regexp_extract({}, '^(.*)/', 1)"


@query("scr07_rerank", "WITH c AS (SELECT DISTINCT path FROM chunks WHERE id % 97 = 0) SELECT id, round(score * CASE WHEN path IN (SELECT path FROM c) THEN 1.5 ELSE 1.0 END * CASE WHEN " + DIR.format("path") + " IN (SELECT " + DIR.format("path") + " FROM c) THEN 1.3 ELSE 1.0 END, 6) AS score FROM chunks", "chunks")
def _(chunks):
    out = R.rerank(chunks.select("id", "path", "score"), chunks.where("id % 97 = 0"))
    return out.select("id", F.round("score", 6).alias("score"))


@query("scr08_group_score", "SELECT id, CAST(CASE id % 5 WHEN 0 THEN 0.95 WHEN 1 THEN 0.92 WHEN 2 THEN 0.86 WHEN 3 THEN 0.84 ELSE 0.8 END AS DOUBLE) AS score FROM chunks", "chunks")
def _(chunks):
    k = F.col("id") % 5
    group = F.when(k == 0, "changed_files").when(k == 1, "definitions").when(k == 2, "class_context").when(k == 3, "namespace_context").otherwise("other")
    return chunks.select("id", R.lookup(R.GROUP_SCORE, group, 0.8).alias("score"))


@query("scr09_density", "SELECT id, round(least((least(length(text) % 23, 10) * 0.3 + least(length(text) % 7, 5) * 0.5 + least(length(text) % 5, 3) * 1.0) / greatest(end_line - start_line, 1), 1.0), 4) AS density FROM chunks", "chunks")
def _(chunks):
    n = F.length("text")
    return chunks.select("id", R.information_density({"a": (n % 23, 10, 0.3), "b": (n % 7, 5, 0.5), "c": (n % 5, 3, 1.0)}, F.col("end_line") - F.col("start_line")).alias("density"))


@query("scr10_task_relevance", "SELECT c.id, CAST(sum(CASE WHEN contains(lower(path), term) THEN 6 ELSE 0 END + 2 * least(CAST((length(lower(text)) - length(replace(lower(text), term, ''))) / length(term) AS BIGINT), 5)) AS BIGINT) AS relevance FROM chunks c, (SELECT unnest(['part7', 'the', 'tion']) AS term) GROUP BY c.id", "chunks")
def _(chunks):
    terms = F.array(*[F.lit(t) for t in ("part7", "the", "tion")])
    value = lambda t: F.when(F.contains(F.lower("path"), t), 6).otherwise(0) + 2 * F.least(R.occurrences(F.lower("text"), t), F.lit(5))
    return chunks.select("id", F.aggregate(F.transform(terms, value), F.lit(0).cast("long"), lambda s, x: s + x).alias("relevance"))


@query("scr11_relation_strength", "SELECT node, round(least(sum(weight), 5.0), 6) AS strength FROM (SELECT src AS node, CAST(weight AS DOUBLE) AS weight FROM edges UNION ALL SELECT dst, CAST(weight AS DOUBLE) FROM edges) GROUP BY node", "edges")
def _(edges):
    return strength(edges.withColumn("weight", F.col("weight").cast("double"))).withColumn("strength", F.round("strength", 6))


@query("scr12_representation", "SELECT path, arg_max(id, rank * 10000000 - id) AS id, max(rank) AS rank FROM (SELECT id, path, CAST(CASE WHEN line % 3 = 0 THEN 1000000000 ELSE 0 END + CASE WHEN line > 1 THEN 100000000 WHEN line > 0 THEN 10000000 ELSE 0 END + CASE WHEN id % 2 = 0 THEN length(title) ELSE 0 END + length(reason) AS BIGINT) AS rank FROM issues) GROUP BY path", "issues")
def _(issues):
    snippet, diff = F.when(F.col("line") % 3 == 0, "x = 1"), F.when(F.col("id") % 2 == 0, F.col("title"))
    ranked = issues.select("id", "path", representation_rank(snippet, F.col("line"), diff, F.col("reason")).cast("long").alias("rank"))
    return ranked.groupBy("path").agg(F.max_by("id", F.struct("rank", -F.col("id"))).alias("id"), F.max("rank").alias("rank"))


PARTS = {"path": 0.2, "language": 0.1, "semantic_names": 0.2, "primary_name": 0.2, "content_type": 0.1, "parent_class": 0.1, "docstring": 0.1}


@query("scr13_completeness", "SELECT id, round(CASE WHEN length(path) > 0 THEN 0.2 ELSE 0 END + CASE WHEN length(language) > 0 THEN 0.1 ELSE 0 END + CASE WHEN id % 4 > 0 THEN 0.2 ELSE 0 END + CASE WHEN length(primary_name) > 0 THEN 0.2 ELSE 0 END + CASE WHEN length(content_type) > 0 THEN 0.1 ELSE 0 END + CASE WHEN length(parent_class) > 0 THEN 0.1 ELSE 0 END + CASE WHEN id % 3 = 0 THEN 0.1 ELSE 0 END, 6) AS completeness FROM chunks", "chunks")
def _(chunks):
    known = chunks.withColumn("semantic_names", F.when(F.col("id") % 4 > 0, F.array("primary_name")).otherwise(F.array().cast("array<string>"))).withColumn("docstring", F.when(F.col("id") % 3 == 0, "what it does").otherwise(""))
    return known.select("id", F.round(R.completeness(PARTS, dict(known.dtypes)), 6).alias("completeness"))


@query("scr14_tiers", "WITH t AS (SELECT id, CASE WHEN id % 50 = 0 THEN 1 WHEN score >= 0.88 THEN 2 ELSE 3 END AS tier, score FROM chunks), n AS (SELECT count(*) FILTER (WHERE tier = 1) AS a, count(*) FILTER (WHERE tier = 2) AS b FROM t), r AS (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY score DESC, id) AS r FROM t) SELECT id, tier FROM r, n WHERE tier = 1 OR (tier = 2 AND r <= 16 + greatest(64 - a, 0)) OR (tier = 3 AND r <= 8 + greatest(16 + greatest(64 - a, 0) - b, 0))", "chunks")
def _(chunks):
    rows = chunks.select("id", "score", F.when(F.col("id") % 50 == 0, 1).when(F.col("score") >= 0.88, 2).otherwise(3).alias("tier"))
    return R.tiers(rows, [F.desc("score"), F.col("id")]).select("id", "tier")


FLAGSHIP_SQL = f"""
WITH hits AS (SELECT c.id, c.path, c.text, c.content_type, c.density, c.language, max(round(list_cosine_similarity(CAST(p.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6)) AS score
              FROM embeddings p JOIN chunks c ON c.id = p.vec_id, embeddings q WHERE q.vec_id % 50 = 0 GROUP BY ALL),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path, text ORDER BY score DESC, id) AS r FROM hits) WHERE r = 1),
s AS (SELECT id, path, round(least(score * CAST({BOOST} AS DOUBLE) * CAST({THIN} AS DOUBLE), 1.0) * CASE WHEN language <> 'en' THEN 0.2 ELSE 1.0 END
        * CASE WHEN length(text) > 16000 THEN greatest(0.5, 1 - (least(length(text) / 16000, 3) - 1) * 0.5 / 2) ELSE 1.0 END, 6) AS score FROM one),
k AS (SELECT * FROM s WHERE score >= 0.7 UNION ALL SELECT * FROM (SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM s WHERE score >= 0.7) ORDER BY score DESC, id LIMIT 5))
SELECT id, path, score FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY score DESC, id) AS r FROM k) WHERE r <= 4
"""


@query("plan_pr_context", FLAGSHIP_SQL, "t:embeddings", "chunks")
def _(embeddings, chunks):
    """Search by a stated set of query vectors, then merge, adjust, threshold and cap."""
    queries = embeddings.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("q_vector"))
    points = embeddings.select(F.col("vec_id").alias("point"), F.col("embedding").alias("vector"))
    hits = R.best_similarities(queries, points).select(F.col("point").alias("id"), F.col("similarity").alias("score"))
    rows = hits.join(chunks.drop("score"), "id").withColumn("family", F.col("language"))
    return R.merge_and_rank(rows, "en").select("id", "path", "score")
