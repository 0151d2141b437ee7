"""Queries of sets, duplicates and graphs."""

from pyspark.sql import functions as F

from ..operators import dedup as D
from ..operators import graph as G
from ..operators.components import connected_components
from .registry import query


@query("set01_ordered_distinct", "SELECT conv_id, first_seen FROM (SELECT conv_id, list(role ORDER BY turn) AS first_seen FROM (SELECT conv_id, role, min(turn) AS turn FROM conversations GROUP BY 1, 2) GROUP BY conv_id)", "t:conversations")
def _(conversations):
    return D.ordered_distinct(conversations, "conv_id", "role", "turn").withColumnRenamed("seen", "first_seen")


@query("set02_subtraction", "SELECT DISTINCT id FROM audit WHERE id NOT IN (SELECT id FROM issues WHERE resolved)", "audit", "issues")
def _(audit, issues):
    return audit.select("id").distinct().join(issues.where("resolved").select("id"), "id", "left_anti")


@query("set03_union_minus_seen", "(SELECT primary_name AS k FROM chunks UNION SELECT namespace FROM chunks UNION SELECT parent_class FROM chunks WHERE parent_class IS NOT NULL) EXCEPT SELECT primary_name FROM chunks WHERE id % 3 = 0", "chunks")
def _(chunks):
    names = chunks.select(F.col("primary_name").alias("k")).union(chunks.select("namespace")).union(chunks.where("parent_class is not null").select("parent_class")).distinct()
    return names.exceptAll(chunks.where("id % 3 = 0").select("primary_name").distinct().join(names, F.col("primary_name") == F.col("k"), "left_semi"))


@query("set05_promotion", "WITH k AS (SELECT DISTINCT path FROM issues WHERE id < 700), c AS (SELECT project_id AS request, count(*) AS n, count(k.path) AS k FROM issues LEFT JOIN k USING (path) GROUP BY 1) SELECT request, CASE WHEN k = n THEN 'EXACT' WHEN k > 0 THEN 'PARTIAL' ELSE 'NONE' END AS reuse, k < n AS needs_context FROM c", "issues")
def _(issues):
    commits = issues.select(F.col("project_id").alias("request"), F.col("id").alias("commit"), F.col("path").alias("patch"))
    return D.promotion(commits, issues.where("id < 700").select(F.col("path").alias("patch"), F.lit("main").alias("target")))


@query("ded01_content_best", "SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY path, text ORDER BY score DESC, id) AS r FROM chunks) WHERE r = 1", "chunks")
def _(chunks):
    return D.keep_best(chunks).select("id")


@query("ded02_branch_priority", "WITH o AS (SELECT DISTINCT path FROM chunks WHERE branch = 'main') SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY path, branch, substr(text, 1, 100) ORDER BY score DESC, id) AS r FROM chunks WHERE branch = 'main' OR path NOT IN (SELECT path FROM o)) WHERE r = 1", "chunks")
def _(chunks):
    return D.branch_priority(chunks, "main").select("id")


@query("ded03_layer_priority", "SELECT id FROM (SELECT id, CASE branch WHEN 'feature/search' THEN 3 WHEN 'develop' THEN 2 ELSE 1 END AS p, max(CASE branch WHEN 'feature/search' THEN 3 WHEN 'develop' THEN 2 ELSE 1 END) OVER (PARTITION BY path) AS m FROM chunks) WHERE p = m", "chunks")
def _(chunks):
    return D.layer_priority(chunks, F.when(F.col("branch") == "feature/search", 3).when(F.col("branch") == "develop", 2).otherwise(1)).select("id")


@query("ded04_narrative", r"WITH i AS (SELECT id, resolved, path || chr(1) || trim(regexp_replace(regexp_replace(lower(title), '\b(at |on |in )?lines? \d+\b', ' ', 'g'), '(^|\s)\d+(\s|$)', ' \2', 'g')) || chr(1) || lower(reason) AS k, line, reason FROM issues) SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY k ORDER BY (line IS NOT NULL) DESC, id) AS r, resolved FROM i WHERE NOT resolved) WHERE r = 1 UNION ALL SELECT id FROM i WHERE resolved", "issues")
def _(issues):
    from ..functions import text as T

    rows = issues.select(F.col("id").alias("seq"), "path", "title", "reason", "severity", "line", "resolved", F.lit("d").alias("diff"))
    key = F.concat_ws("\u0001", "path", T.normal_title(F.col("title")), T.normal_line(F.lower("reason")))
    return D.absorb(rows, F.when(F.length("reason") >= D.NARRATIVE, key), F.col("line").isNotNull().cast("int")).select(F.col("seq").alias("id"))


@query("ded06_merge_promotion", f"SELECT path, min(id) AS id, CASE min(CASE severity WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 3 ELSE 4 END) WHEN 1 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' WHEN 3 THEN 'LOW' ELSE 'INFO' END AS severity, CAST(count(DISTINCT line) AS BIGINT) - max(CASE WHEN id = m AND line IS NOT NULL THEN 1 ELSE 0 END) AS others FROM (SELECT *, min(id) OVER (PARTITION BY path) AS m FROM issues WHERE NOT resolved) GROUP BY path", "issues")
def _(issues):
    rows = issues.where("not resolved").select(F.col("id").alias("seq"), "path", "severity", F.col("line").cast("long"), "resolved", F.lit("d").alias("diff"))
    out = D.absorb(rows, F.col("path"), F.lit(0))
    return out.select("path", F.col("seq").alias("id"), "severity", F.size(F.coalesce("places", F.array())).cast("long").alias("others")).withColumn("others", F.when(F.col("others") < 0, 0).otherwise(F.col("others")))


@query("ded07_prompt_fingerprint", "SELECT id, path || '::' || CAST(coalesce(CAST(floor(line / 3) AS BIGINT), 0) AS STRING) || '::' || severity || '::' || substr(lower(reason), 1, 50) AS fp FROM issues", "issues")
def _(issues):
    return issues.select("id", D.prompt_fingerprint(F.col("path"), F.col("line"), F.col("severity"), F.col("reason")).alias("fp"))


def _findings(issues):
    """Findings with a snippet at every third line."""
    snippet = F.when(F.col("line") % 3 == 0, F.concat(F.lit("call("), (F.col("line") % 40).cast("string"), F.lit(")")))
    return issues.select(F.col("id").alias("seq"), F.col("path").alias("file"), "line", snippet.alias("snippet"), "title", "reason")


#: The three passes in order; of equal ones the best by snippet, line and length, then the first.
_TIER = "{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY CASE WHEN NOT resolved THEN {key} END, CASE WHEN resolved OR {key} IS NULL THEN id END ORDER BY rank DESC, id) AS r_{name} FROM {source}) WHERE r_{name} = 1)"
_SNIPPET = "CASE WHEN line % 3 = 0 THEN 'call(' || CAST(line % 40 AS STRING) || ')' END"
_FP = "sha256({head}coalesce(h, 'no_hash') || ':' || t)"
_IDENTITY = "CASE WHEN h IS NOT NULL THEN path || chr(1) || {fp} || ':line-hash:' || h WHEN s IS NOT NULL THEN path || chr(1) || {fp} || ':snippet:line:' || coalesce(CAST(line AS STRING), '') || ':' || s END"


@query(
    "ded05_ingest",
    r"WITH f AS (SELECT id, path, line, resolved, category, reason, lower(title) AS title, " + _SNIPPET + r" AS s, CASE WHEN line % 5 < 2 THEN md5(CAST(line % 9 AS STRING)) END AS h, trim(regexp_replace(regexp_replace(lower(title), '\b(at |on |in )?lines? \d+\b', ' ', 'g'), '(^|\s)\d+(\s|$)', ' \2', 'g')) AS t FROM issues), "
    "k AS (SELECT *, CASE WHEN s IS NOT NULL THEN 1000000000 ELSE 0 END + CASE WHEN line > 1 THEN 100000000 WHEN line > 0 THEN 10000000 ELSE 0 END + 1 + length(reason) AS rank FROM f), "
    + _TIER.format(name="t1", key="path || chr(1) || title || chr(1) || lower(reason)", source="k") + ", " + _TIER.format(name="t2", key=_IDENTITY.format(fp=_FP.format(head="coalesce(upper(category), 'UNKNOWN') || ':' || ")), source="t1") + ", "
    + _TIER.format(name="t3", key=_IDENTITY.format(fp=_FP.format(head="")), source="t2") + " SELECT id FROM t3",
    "issues",
)
def _(issues):
    rows = _findings(issues).join(issues.select(F.col("id").alias("seq"), "severity", "category", "resolved"), "seq")
    hash_ = F.when(F.col("line") % 5 < 2, F.md5((F.col("line") % 9).cast("string")))
    return D.ingest(rows.withColumn("line_hash", hash_).withColumn("diff", F.lit("d"))).select(F.col("seq").alias("id"))


@query("ded08_duplicates", None, "issues")
def _(issues):
    return D.duplicates(_findings(issues))


@query("ded09_similar_pairs", None, "issues")
def _(issues):
    return D.similar_pairs(_findings(issues))


@query("ded10_clusters", None, "issues")
def _(issues):
    return D.clusters(D.similar_pairs(_findings(issues)))


@query("ded11_greedy", None, "issues")
def _(issues):
    return D.greedy(_findings(issues), "file")


@query("ded12_stale", "WITH c AS (SELECT DISTINCT path FROM chunks WHERE id % 3 = 2), f AS (SELECT DISTINCT path FROM chunks WHERE branch = 'feature/search' AND score > 0.4) SELECT id, path IN (SELECT path FROM c) AS stale FROM chunks WHERE branch = 'main' AND (path NOT IN (SELECT path FROM c) OR path NOT IN (SELECT path FROM f)) UNION ALL SELECT id, false FROM chunks WHERE branch = 'feature/search' AND score > 0.4 AND path IN (SELECT path FROM c)", "chunks")
def _(chunks):
    c = chunks.select("id", "path", "branch", "score")
    return D.replace_stale(c.where("branch = 'main'"), c.where("branch = 'feature/search' and score > 0.4"), c.where("id % 3 = 2")).select("id", "stale")


@query("ded13_flatten", "SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY path, text ORDER BY id % 6, id) AS r FROM chunks) WHERE r = 1", "chunks")
def _(chunks):
    return D.flatten_groups(chunks.select("id", "path", "text", (F.col("id") % 6).alias("grp"), F.col("id").alias("seq"))).select("id")


REACH = "WITH RECURSIVE s AS (SELECT src AS a, dst AS b FROM edges{w} UNION SELECT dst, src FROM edges{w}), r AS (SELECT a AS node, a AS reach FROM s UNION SELECT r.node, s.b FROM r JOIN s ON s.a = r.reach) SELECT node, min(reach) AS component FROM r GROUP BY node"


@query("grf01_review_groups", REACH.format(w=" WHERE src % 3 = 0 AND dst % 3 = 0 AND src <> dst"), "edges")
def _(edges):
    changed = edges.select(F.col("src").alias("path")).union(edges.select("dst")).where("path % 3 = 0")
    return G.review_groups(edges, changed)


@query("grf02_components", REACH.format(w=" WHERE src <> dst"), "edges")
def _(edges):
    return connected_components(edges, "src", "dst")


@query("grf03_build", "WITH n AS (SELECT DISTINCT src AS node FROM edges), i AS (SELECT src, dst, kind, weight FROM edges WHERE dst IN (SELECT node FROM n) AND src <> dst) SELECT src, dst, CAST(max(weight) AS DOUBLE) AS weight, min(kind) AS kind FROM (SELECT * FROM i UNION ALL SELECT dst, src, kind, weight FROM i) GROUP BY 1, 2", "edges")
def _(edges):
    return G.build(edges.withColumn("weight", F.col("weight").cast("double")), edges.select(F.col("src").alias("node")))


@query("grf04_batches", None, "chunks")
def _(chunks):
    return G.batches(review_files(chunks))


def review_files(chunks):
    """Reviews of forty chunks each: their files, a third of them in no component."""
    each = chunks.select(F.floor(F.col("id") / 40).alias("review"), F.concat("path", F.lit("#"), (F.col("id") % 3).cast("string")).alias("path"), "id", "score", F.length("text").alias("chars"))
    files = each.groupBy("review", "path").agg(F.sum("score").alias("strength"), F.min("id").alias("first"), F.sum("chars").alias("chars"))
    k = F.col("first") % 9
    priority = F.when(k == 0, "CRITICAL").when(k < 3, "HIGH").when(k < 6, "MEDIUM").otherwise("LOW")
    return files.select("review", "path", F.when(F.col("first") % 3 > 0, F.col("first") % 4).alias("component"), "strength", priority.alias("priority"), (F.floor(F.col("chars") / 4) + 1000).alias("tokens"))


@query("grf05_undirected", "SELECT a, b, kind, round(least(max(w) + 0.2 * (sum(w) - max(w)), 8.0), 6) AS weight FROM (SELECT least(src, dst) AS a, greatest(src, dst) AS b, kind, CAST(weight AS DOUBLE) AS w FROM (SELECT src, dst, kind, weight FROM edges UNION ALL SELECT dst, src, kind, weight * 2 FROM edges WHERE src % 3 = 0)) GROUP BY 1, 2, 3", "edges")
def _(edges):
    e = edges.withColumn("weight", F.col("weight").cast("double"))
    back = e.where("src % 3 = 0").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "kind", (F.col("weight") * 2).alias("weight"))
    return G.undirected(e.unionByName(back)).withColumn("weight", F.round("weight", 6))


@query("grf05_virtual_nodes", "WITH m AS (SELECT DISTINCT coalesce(parent_class, namespace) AS key, path AS node FROM chunks), s AS (SELECT key, count(*) AS size FROM m GROUP BY key HAVING count(*) BETWEEN 2 AND 80), c AS (SELECT * FROM s ORDER BY size DESC, key LIMIT 12) SELECT key, node, CAST(size AS BIGINT) AS size FROM m JOIN c USING (key)", "chunks")
def _(chunks):
    return G.virtual_nodes(chunks.select(F.coalesce("parent_class", "namespace").alias("key"), F.col("path").alias("node")), 2, 80, 12, F.desc("size"))


@query("grf06_imports", "WITH e AS (SELECT DISTINCT path, primary_name || namespace || parent_class AS name FROM chunks WHERE id % 2 = 0), o AS (SELECT name, min(path) AS target FROM e WHERE name IS NOT NULL GROUP BY name HAVING count(*) = 1), u AS (SELECT DISTINCT path AS source, primary_name || namespace || parent_class AS name FROM chunks WHERE id % 2 = 1 OR id % 4 = 0) SELECT source, target, name FROM u JOIN o USING (name) WHERE source <> target", "chunks")
def _(chunks):
    rows = chunks.select("id", "path", F.concat("primary_name", "namespace", "parent_class").alias("name"))
    return G.imports(rows.where("id % 2 = 0").select("path", "name"), rows.where("id % 2 = 1 or id % 4 = 0").select("path", "name"))


@query("grf07_contracts", "WITH f AS (SELECT DISTINCT path, id FROM chunks) SELECT DISTINCT b.path AS source, a.path AS target, 's' || a.id AS name FROM f a JOIN f b ON b.id = a.id + 1 WHERE a.path <> b.path", "chunks")
def _(chunks):
    name = lambda c: F.concat(F.lit("s"), c.cast("string"))
    text = F.concat(F.lit('{"$id": "'), name(F.col("id")), F.lit('", "items": {"$ref": "'), name(F.col("id") - 1), F.lit('#/x"}}'))
    return G.contract_references(chunks.select("path", text.alias("text")))


@query("grf08_focus", "SELECT id, [path] AS paths FROM chunks WHERE path IN ('src/src1/en/part1.java', 'src/src2/en/part2.ts')", "chunks")
def _(chunks):
    fact = lambda p: F.struct(F.lit("a").alias("source"), F.lit("calls").alias("relation"), F.lit("b").alias("target"), p.alias("path"))
    packets = chunks.select("id", F.array(fact(F.col("path")), fact(F.concat(F.lit("other/"), F.col("path")))).alias("facts"))
    return G.focus(packets, ["src/src1/en/part1.java", "src/src2/en/part2.ts"]).select("id", "paths")
