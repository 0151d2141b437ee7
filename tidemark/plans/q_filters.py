"""Queries of filters, sources and sinks."""

from pyspark.sql import functions as F

from ..operators import filters as O
from .registry import query

TAIL = "regexp_replace(path, '^[^/]*/', '')"


@query("flt01_include_globs", f"SELECT id, path FROM chunks WHERE regexp_matches(path, '^src/src1/.*$') OR regexp_matches({TAIL}, '^src/src1/.*$') OR regexp_matches(path, '^(.*/)?[^/]*\\.py$') OR regexp_matches({TAIL}, '^(.*/)?[^/]*\\.py$')", "chunks")
def _(chunks):
    return O.select_paths(chunks, ["src/src1/", "**/*.py"], []).select("id", "path")


@query("flt02_exclude_globs", f"SELECT id, path FROM chunks WHERE NOT (regexp_matches(path, '^[^/]*/en/[^/]*$') OR regexp_matches({TAIL}, '^[^/]*/en/[^/]*$') OR regexp_matches(path, '^(.*/)?[^/]*\\.md$') OR regexp_matches({TAIL}, '^(.*/)?[^/]*\\.md$'))", "chunks")
def _(chunks):
    return O.select_paths(chunks, [], ["*/en/*", "**/*.md"]).select("id", "path")


@query("flt03_branch_globs", "SELECT branch, CAST(count(*) AS BIGINT) AS n FROM chunks WHERE branch = 'main' OR regexp_matches(branch, '^feature/[^/]*$') GROUP BY branch", "chunks")
def _(chunks):
    return chunks.where(O.branch_matches(F.col("branch"), ["main", "feature/*"])).groupBy("branch").agg(F.count("*").alias("n"))


@query("flt05_boolean_tree", "SELECT id FROM chunks WHERE branch = 'main' AND (language IN ('en','fr') OR content_type = 'fallback') AND NOT coalesce(parent_class = 'Class3', false)", "chunks")
def _(chunks):
    return chunks.where(O.tree([F.col("branch") == "main"], [F.col("language").isin("en", "fr"), F.col("content_type") == "fallback"], [F.col("parent_class") == "Class3"])).select("id")


@query("flt06_substring", "SELECT id FROM chunks WHERE contains(lower(concat_ws(' ', path, primary_name, parent_class)), 'class7')", "chunks")
def _(chunks):
    return chunks.where(O.contains_text("CLASS7", "path", "primary_name", "parent_class")).select("id")


@query("flt07_non_semantic", "SELECT id FROM (SELECT id, id % 5 = 0 AS a, CASE WHEN id % 3 = 0 THEN NULL ELSE id % 7 = 0 END AS b FROM chunks) WHERE NOT (coalesce(a, false) OR coalesce(b, false))", "chunks")
def _(chunks):
    flagged = chunks.select("id", (F.col("id") % 5 == 0).alias("a"), F.when(F.col("id") % 3 != 0, F.col("id") % 7 == 0).alias("b"))
    return flagged.where(~O.non_semantic("a", "b")).select("id")


@query("flt08_oversample_filter", "SELECT id, language, score FROM (SELECT * FROM (SELECT * FROM chunks ORDER BY score DESC, id LIMIT 80) WHERE language <> 'en' AND path NOT LIKE '%.md' ORDER BY score DESC, id LIMIT 20)", "chunks")
def _(chunks):
    best = chunks.orderBy(F.desc("score"), "id").limit(80)
    return best.where((F.col("language") != "en") & ~F.col("path").endswith(".md")).orderBy(F.desc("score"), "id").limit(20).select("id", "language", "score")


@query("flt09_issue_list", "SELECT id, severity, created_at FROM issues WHERE NOT resolved AND severity = 'HIGH' AND contains(path, 'pkg3/') AND contains(lower(author), 'dev1') AND created_at >= TIMESTAMP '1996-01-01' ORDER BY id DESC LIMIT 25 OFFSET 5", "issues")
def _(issues):
    found = issues.where(~F.col("resolved") & O.optional(severity="HIGH", category=None) & F.contains("path", F.lit("pkg3/")) & O.contains_text("DEV1", "author") & (F.col("created_at") >= F.lit("1996-01-01").cast("timestamp")))
    return found.orderBy(F.desc("id")).offset(5).limit(25).select("id", "severity", "created_at")


@query("flt10_severity_alias", "SELECT id FROM issues WHERE severity = 'HIGH' AND upper(category) = 'BUG_RISK'", "issues")
def _(issues):
    return issues.where((F.col("severity") == O.severity_of(F.lit("critical"))) & (F.upper("category") == "BUG_RISK")).select("id")


@query("flt11_like_search", "SELECT id FROM issues WHERE lower(path) LIKE '%file7%' OR lower(author) LIKE '%v7%'", "issues")
def _(issues):
    return issues.where(O.like_any("FILE7", "path") | O.like_any("v7", "author")).select("id")


@query("flt12_optional_parameter", "SELECT id FROM issues WHERE severity = 'LOW' AND author = 'dev3'", "issues")
def _(issues):
    return issues.where(O.optional(severity="LOW", author="dev3", category=None)).select("id")


@query("flt13_path_match", "SELECT a.path AS path, b.short AS short FROM (SELECT DISTINCT path FROM issues) a JOIN (SELECT DISTINCT CASE WHEN id % 2 = 0 THEN path ELSE regexp_extract(path, '([^/]*)$', 1) END AS short FROM issues) b ON a.path = b.short", "issues")
def _(issues):
    paths = issues.select("path").distinct()
    short = issues.select(F.when(F.col("id") % 2 == 0, F.col("path")).otherwise(O.base_name(F.col("path"))).alias("short")).distinct()
    # matching paths end in the same file name: an equi-join, the rest is checked on its pairs
    a, b = paths.withColumn("name", O.base_name(F.col("path"))), short.withColumn("name", O.base_name(F.col("short")))
    return a.join(b, "name").where(O.path_matches(F.col("path"), F.col("short"))).select("path", "short")


@query("flt14_skip_reasons", "SELECT coalesce(r, 'kept') AS reason, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE WHEN id % 9 = 0 THEN 'deleted' WHEN id % 9 = 1 THEN 'gitlink' WHEN id % 10 = 0 THEN 'binary' WHEN regexp_matches(path, '(^|/)(dist|build|vendor|node_modules)/') THEN 'generated' WHEN length(text) > 3000 THEN 'oversize' END AS r FROM chunks) GROUP BY 1", "chunks")
def _(chunks):
    change = F.when(F.col("id") % 9 == 0, "deleted").when(F.col("id") % 9 == 1, "gitlink").otherwise("modified")
    reason = O.skip_reason(change, F.col("path"), F.length("text"), F.col("id") % 10 == 0, 3000)
    return chunks.groupBy(F.coalesce(reason, F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query("flt15_config_files", "SELECT path, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE id % 5 WHEN 0 THEN 'app/package.json' WHEN 1 THEN 'a/Dockerfile' WHEN 2 THEN 'x/y.yml' WHEN 3 THEN 'src/a.java' ELSE 'json' END AS path FROM issues) WHERE path IN ('app/package.json', 'a/Dockerfile', 'x/y.yml') GROUP BY path", "issues")
def _(issues):
    k = F.col("id") % 5
    path = F.when(k == 0, "app/package.json").when(k == 1, "a/Dockerfile").when(k == 2, "x/y.yml").when(k == 3, "src/a.java").otherwise("json")
    return issues.select(path.alias("path")).where(O.is_config(F.col("path"))).groupBy("path").agg(F.count("*").alias("n"))


@query("flt16_checks", "SELECT id, 'line_known' AS \"check\" FROM issues WHERE line IS NULL UNION ALL SELECT id, 'line_small' FROM issues WHERE line >= 390 UNION ALL SELECT id, 'category_set' FROM issues WHERE category NOT IN ('security', 'style', 'bug_risk', 'performance')", "issues")
def _(issues):
    return O.violations(issues, "id", line_known=F.col("line").isNotNull(), line_small=F.col("line") < 390, category_set=F.col("category").isin("security", "style", "bug_risk", "performance"))


@query("flt17_publication_gate", "SELECT coalesce(r, 'published') AS code, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE WHEN severity = 'INFO' THEN 'not_publishable' WHEN resolved THEN 'contradicted' WHEN line IS NULL THEN 'no_anchor' WHEN line % 50 > 25 THEN 'out_of_hunk' END AS r FROM issues) GROUP BY 1", "issues")
def _(issues):
    code = O.first_reject(not_publishable=F.col("severity") == "INFO", contradicted=F.col("resolved"), no_anchor=F.col("line").isNull(), out_of_hunk=F.col("line") % 50 > 25)
    return issues.groupBy(F.coalesce(code, F.lit("published")).alias("code")).agg(F.count("*").alias("n"))


@query("src01_scan", "SELECT id, path, CAST(octet_length(encode(text)) AS BIGINT) AS size FROM chunks WHERE regexp_matches(path, '\\.(py|java)$') AND octet_length(encode(text)) <= 5000 AND NOT contains(text, chr(0))", "chunks")
def _(chunks):
    from ..sources.files import text_files

    return text_files(chunks.select("id", "path", F.encode("text", "UTF-8").alias("content")), include=["**/*.py", "**/*.java"], max_bytes=5000).select("id", "path", "size")


@query("src03_decode_guard", "SELECT doc_id FROM documents WHERE doc_id % 10 > 1", "t:documents")
def _(documents):
    raw = F.encode("text", "UTF-8")
    spoilt = F.when(F.col("doc_id") % 10 == 0, F.concat(raw, F.lit(b"\x00"))).when(F.col("doc_id") % 10 == 1, F.concat(raw, F.lit(b"\xff\xfe"))).otherwise(raw)
    return documents.where(O.decodable(spoilt)).select("doc_id")


@query("src04_generated_assets", "SELECT DISTINCT p_brand AS brand, p_size % 4 AS k FROM part WHERE p_size % 4 < 2", "t:part")
def _(part):
    k = F.col("p_size") % 4
    name = F.concat(F.lit("static/app"), F.when(k == 0, "-a1b2c3d4.js").when(k == 1, ".9f8e7d6c5.css").when(k == 2, "-abcdefgh.js").otherwise("-a1b2c3d4.py"))
    return part.where(O.generated_asset(name)).select(F.col("p_brand").alias("brand"), k.alias("k")).distinct()


@query("src05_tree_identity", "WITH r AS (SELECT DISTINCT source, path || ':' || sha256(text) AS f FROM chunks), t1 AS (SELECT source, substr(a, 1, 4) AS a, sha256(string_agg(f, ';' ORDER BY f)) AS f FROM (SELECT *, sha256(f) AS a FROM r) GROUP BY source, substr(a, 1, 4)), t2 AS (SELECT source, substr(a, 1, 2) AS a, sha256(string_agg(f, ';' ORDER BY f)) AS f FROM t1 GROUP BY source, substr(a, 1, 2)) SELECT source, sha256(string_agg(f, ';' ORDER BY f)) AS identity FROM t2 GROUP BY source", "chunks")
def _(chunks):
    from ..sources.files import tree_identity

    return tree_identity(chunks.select("source", "path", "text").distinct(), "source")


@query("src06_bounded_scroll", "SELECT id, path, (SELECT count(*) FROM chunks WHERE branch = 'main') > 50 AS truncated FROM chunks WHERE branch = 'main' ORDER BY path, start_line, end_line, primary_name, id LIMIT 50", "chunks")
def _(chunks):
    from ..sources.files import scroll

    return scroll(chunks.where("branch = 'main'"), ["path", "start_line", "end_line", "primary_name", "id"], 50).select("id", "path", "truncated")


@query("src07_lookup_by_ids", "SELECT c.id, c.path FROM chunks c WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = c.id AND l.toxic = 1)", "chunks", "t:labels")
def _(chunks, labels):
    return chunks.join(labels.where("toxic = 1").select(F.col("doc_id").alias("id")), "id", "left_semi").select("id", "path")


@query("src09_parent_with_children", "SELECT r_name, n_name FROM region LEFT JOIN nation ON r_regionkey = n_regionkey", "t:region", "t:nation")
def _(region, nation):
    return region.join(nation, F.col("r_regionkey") == F.col("n_regionkey"), "left").select("r_name", "n_name")


@query("snk01_upsert", "SELECT id, score FROM (SELECT id, score + 1 AS score FROM chunks WHERE id % 4 = 0 UNION ALL SELECT id, score FROM chunks WHERE id % 4 <> 0 AND id % 3 = 0)", "chunks")
def _(chunks):
    from ..sources.sinks import upsert

    old, new = chunks.where("id % 3 = 0").select("id", "score"), chunks.where("id % 4 = 0").select("id", (F.col("score") + 1).alias("score"))
    return upsert(old, new, ["id"])


@query("snk04_upsert_counter", "SELECT project_id, CAST(count(*) AS BIGINT) AS n FROM issues WHERE id % 2 = 0 OR id % 3 = 0 GROUP BY project_id", "issues")
def _(issues):
    from ..sources.sinks import add_counts

    old = issues.where("id % 2 = 0").groupBy("project_id").agg(F.count("*").alias("n"))
    new = issues.where("id % 2 <> 0 and id % 3 = 0").groupBy("project_id").agg(F.count("*").alias("n"))
    return add_counts(old, new, ["project_id"], "n")


@query("snk05_insert_missing", "SELECT path, min(id) AS id FROM issues WHERE id < 500 GROUP BY path UNION ALL SELECT path, min(id) FROM issues WHERE id >= 500 AND path NOT IN (SELECT path FROM issues WHERE id < 500) GROUP BY path", "issues")
def _(issues):
    from ..sources.sinks import insert_missing

    old = issues.where("id < 500").groupBy("path").agg(F.min("id").alias("id"))
    new = issues.where("id >= 500").groupBy("path").agg(F.min("id").alias("id"))
    return insert_missing(old, new, ["path"])


@query("snk06_content_store", "SELECT sha256(text) AS hash, CAST(count(*) AS BIGINT) AS uses, CAST(min(octet_length(encode(text))) AS BIGINT) AS bytes FROM chunks GROUP BY text", "chunks")
def _(chunks):
    from ..sources.sinks import content_store

    blobs, references = content_store(chunks.select("path", "id", "text"), "text")
    return references.groupBy("hash").agg(F.count("*").alias("uses")).join(blobs, "hash").select("hash", "uses", F.octet_length("text").cast("long").alias("bytes"))


@query("flt04_plugin_globs", "SELECT id, regexp_full_match(path, 'src/.*/[^/]*\\.py') AS deep, regexp_full_match(path, 'src/[^/]*/e[^/]/[^/]*') AS two, regexp_full_match(path, '[^/]*\\.py') AS top FROM chunks", "chunks")
def _(chunks):
    globs = {"deep": "src/**/*.py", "two": "src/*/e?/*", "top": "*.py"}
    return chunks.select("id", *(O.contract_glob(F.col("path"), g).alias(n) for n, g in globs.items()))


@query("src02_load_files", "SELECT 'f' || id AS path, id % 3 <> 1 AS intact, CAST(octet_length(encode(text)) AS BIGINT) AS size FROM chunks WHERE id % 7 <> 0 AND octet_length(encode(text)) <= 1048576", "chunks")
def _(chunks):
    from ..sources.files import load_files

    path = F.concat(F.lit("f"), F.col("id").cast("string")).alias("path")
    files = chunks.where("id % 7 <> 0").select(path, F.encode("text", "UTF-8").alias("content"))
    k = F.col("id") % 3
    wanted = chunks.select(path, F.when(k == 0, F.sha2("text", 256)).when(k == 1, "0000").alias("digest"))
    return load_files(files, wanted).select("path", "intact", "size")


@query("src10_csv", "SELECT CAST(id AS STRING) AS id, title || ', \"' || author || '\"' AS note FROM issues", "issues")
def _(issues):
    from ..shared import new_path
    from ..sources.files import read_csv

    spark, path = issues.sparkSession, new_path(issues.sparkSession, "cohort")
    note = F.concat("title", F.lit(', "'), "author", F.lit('"'))
    issues.select("id", note.alias("note")).write.csv(path, header=True, escape='"')
    return read_csv(spark, path, ["id", "note"])


@query("snk03_versions", "SELECT id FROM issues WHERE id % 2 = 0", "issues")
def _(issues):
    """A generation of half of the rows, one of all rows, and back again."""
    from ..sources.sinks import Versions

    table = Versions(issues.sparkSession)
    half = issues.where("id % 2 = 0").select("id")
    table.publish(half, half.count())
    table.publish(issues.select("id"))
    table.roll_back()
    return table.current()
