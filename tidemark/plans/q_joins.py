"""Queries of joins."""

from pyspark.sql import functions as F

from ..operators import joins as J
from .registry import query


@query("jn01_inner", "SELECT i.id, a.total FROM issues i JOIN analyses a ON a.id = i.id WHERE NOT i.resolved", "issues", "analyses")
def _(issues, analyses):
    return issues.where("not resolved").select("id").join(analyses.select("id", "total"), "id")


@query("jn02_left", "SELECT i.id, a.total FROM issues i LEFT JOIN analyses a ON a.id = i.id", "issues", "analyses")
def _(issues, analyses):
    return issues.select("id").join(analyses.select("id", "total"), "id", "left")


@query("jn03_semi_any_of", "SELECT id FROM issues i WHERE EXISTS (SELECT 1 FROM analyses a WHERE a.id = i.id AND a.high > 3) OR EXISTS (SELECT 1 FROM audit e WHERE e.id = i.id AND e.status = 'RUNNING') OR id IN (SELECT src FROM edges)", "issues", "analyses", "audit", "edges")
def _(issues, analyses, audit, edges):
    ids = analyses.where("high > 3").select("id").union(audit.where("status = 'RUNNING'").select("id")).union(edges.select("src"))
    return issues.join(ids.distinct(), "id", "left_semi").select("id")


@query("jn04_anti", "SELECT id FROM issues i WHERE NOT EXISTS (SELECT 1 FROM analyses a WHERE a.id = i.id)", "issues", "analyses")
def _(issues, analyses):
    return issues.join(analyses.select("id"), "id", "left_anti").select("id")


@query("jn06_line_distance", "SELECT id, CAST(coalesce(abs(line - 200), 2147483646) AS BIGINT) AS distance FROM issues", "issues")
def _(issues):
    return issues.select("id", J.line_distance(F.col("line"), F.lit(200)).cast("long").alias("distance"))


LINES = "SELECT doc_id AS doc, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents"


@query(
    "jn07_closest_line",
    f"WITH l AS ({LINES}), w AS (SELECT doc, line, pos + 3 AS at, doc * 1000000 + pos AS id FROM l WHERE pos % 7 = 1), c AS (SELECT doc, line, count(*) AS n FROM l GROUP BY 1, 2) "
    "SELECT w.id, CAST(CASE WHEN c.n > 5 THEN -1 ELSE (SELECT arg_min(l.pos, abs(l.pos - w.at) * 1000000 + l.pos) FROM l WHERE l.doc = w.doc AND l.line = w.line) END AS BIGINT) AS pos FROM w JOIN c USING (doc, line)",
    "t:documents",
)
def _(documents):
    lines = documents.select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).select("doc", (F.col("pos") + 1).cast("long").alias("pos"), F.md5("line").alias("hash"))
    wanted = lines.where("pos % 7 = 1").select((F.col("doc") * 1000000 + F.col("pos")).alias("id"), "doc", "hash", (F.col("pos") + 3).alias("line"))
    return J.closest_line(wanted, lines)


@query("jn08_range_overlap", "SELECT a.id AS a, b.id AS b FROM chunks a JOIN issues b ON b.project_id = a.id % 50 AND a.start_line * 11 <= b.line + 6 AND a.start_line * 11 + 30 >= b.line", "chunks", "issues")
def _(chunks, issues):
    a = chunks.select(F.col("id").alias("a"), (F.col("id") % 50).alias("key"), (F.col("start_line") * 11).alias("a_start"), (F.col("start_line") * 11 + 30).alias("a_end"))
    b = issues.where("line is not null").select(F.col("id").alias("b"), F.col("project_id").alias("key"), F.col("line").alias("b_start"), (F.col("line") + 6).alias("b_end"))
    return J.overlapping(a, b, "key", 32).select("a", "b")


@query("jn09_alive_on", "SELECT project_id, CAST(count(*) AS BIGINT) AS open FROM issues WHERE created_at <= TIMESTAMP '1997-01-01' AND NOT (resolved AND resolved_at <= TIMESTAMP '1997-01-01') GROUP BY 1", "issues")
def _(issues):
    from ..operators.aggregates import alive_on

    day = F.lit("1997-01-01").cast("timestamp")
    return issues.where(alive_on(F.col("created_at"), F.col("resolved"), F.col("resolved_at"), day)).groupBy("project_id").agg(F.count("*").alias("open"))


REFERENCE = r"CASE id % 6 WHEN 0 THEN regexp_replace(regexp_replace(path, '^.*/', ''), '\.[^.]*$', '') WHEN 1 THEN replace(regexp_replace(path, '\.[^.]*$', ''), '/', '.') WHEN 2 THEN 'com.other.' || regexp_replace(regexp_replace(path, '^.*/', ''), '\.[^.]*$', '') WHEN 3 THEN 'lib::' || upper(regexp_replace(regexp_replace(path, '^.*/', ''), '\.[^.]*$', '')) WHEN 4 THEN replace(regexp_replace(path, '^[^/]*/(.*)/[^/]*$', '\1'), '/', '.') ELSE 'nothing' END"


@query(
    "jn10_reference_resolution",
    rf"WITH f AS (SELECT DISTINCT path, regexp_replace(path, '\.[^.]*$', '') AS whole, regexp_replace(regexp_replace(path, '^.*/', ''), '\.[^.]*$', '') AS bare FROM chunks), n AS (SELECT key, max(path) AS target FROM (SELECT path, unnest([bare, lower(bare), replace(whole, '/', '.')]) AS key FROM f) GROUP BY key), "
    rf"r AS (SELECT id, {REFERENCE} AS reference FROM chunks), s AS (SELECT *, CASE WHEN contains(reference, '.') THEN regexp_extract(reference, '([^.]*)$', 1) WHEN contains(reference, '/') THEN regexp_extract(reference, '([^/]*)$', 1) ELSE regexp_replace(reference, '^.*::', '') END AS simple FROM r), "
    "d AS (SELECT reference, max(path) AS target FROM (SELECT DISTINCT reference FROM s) JOIN f ON contains('/' || whole || '/', '/' || replace(reference, '.', '/') || '/') GROUP BY reference) "
    "SELECT s.id, coalesce(a.target, b.target, c.target, d.target) AS target, CASE WHEN a.target IS NOT NULL THEN 1 WHEN b.target IS NOT NULL THEN 2 WHEN c.target IS NOT NULL THEN 3 WHEN d.target IS NOT NULL THEN 4 END AS rule FROM s LEFT JOIN n a ON a.key = s.reference LEFT JOIN n b ON b.key = s.simple LEFT JOIN n c ON c.key = lower(s.simple) LEFT JOIN d ON d.reference = s.reference",
    "chunks",
)
def _(chunks):
    bare = F.regexp_replace(F.regexp_replace("path", "^.*/", ""), r"\.[^.]*$", "")
    k = F.col("id") % 6
    reference = (
        F.when(k == 0, bare).when(k == 1, F.replace(F.regexp_replace("path", r"\.[^.]*$", ""), F.lit("/"), F.lit("."))).when(k == 2, F.concat(F.lit("com.other."), bare))
        .when(k == 3, F.concat(F.lit("lib::"), F.upper(bare))).when(k == 4, F.replace(F.regexp_replace("path", "^[^/]*/(.*)/[^/]*$", "$1"), F.lit("/"), F.lit("."))).otherwise("nothing")
    )
    return J.resolve_references(chunks.select("id", reference.alias("reference")), chunks).select("id", "target", "rule")


@query("jn11_same_package_pairs", "SELECT DISTINCT a.path AS a, b.path AS b FROM (SELECT DISTINCT path, regexp_extract(path, '^(.*)/', 1) AS dir FROM issues) a JOIN (SELECT DISTINCT path, regexp_extract(path, '^(.*)/', 1) AS dir FROM issues) b ON a.dir = b.dir AND a.path < b.path", "issues")
def _(issues):
    # pairs of the files of a directory are what is asked for here
    files = issues.select("path", F.regexp_extract("path", "^(.*)/", 1).alias("dir")).distinct()
    return files.select("dir", F.col("path").alias("a")).join(files.select("dir", F.col("path").alias("b")), "dir").where("a < b").select("a", "b")


@query("jn12_definitions", "SELECT id FROM chunks WHERE primary_name IN (SELECT n FROM (SELECT DISTINCT 'name' || CAST(src % 150 AS STRING) AS n FROM edges) ORDER BY n LIMIT 100)", "chunks", "edges")
def _(chunks, edges):
    names = edges.select(F.concat(F.lit("name"), (F.col("src") % 150).cast("string")).alias("primary_name")).distinct().orderBy("primary_name").limit(100)
    return chunks.join(names, "primary_name", "left_semi").select("id")


@query("jn13_two_hops", "WITH f AS (SELECT parent_class FROM chunks WHERE primary_name = 'name7' AND parent_class IS NOT NULL), p AS (SELECT DISTINCT parent_class AS n FROM f ORDER BY n LIMIT 50) SELECT id FROM chunks WHERE parent_class IN (SELECT n FROM p) AND primary_name <> 'name7'", "chunks")
def _(chunks):
    parents = chunks.where("primary_name = 'name7' and parent_class is not null").select("parent_class").distinct().orderBy("parent_class").limit(50)
    return chunks.where("primary_name <> 'name7'").join(parents, "parent_class", "left_semi").select("id")


@query("jn14_peers", "SELECT id, kind FROM ((SELECT id, 'class' AS kind FROM chunks WHERE parent_class = 'Class3' ORDER BY path, start_line, id LIMIT 20) UNION ALL (SELECT id, 'namespace' AS kind FROM chunks WHERE namespace = 'ns4' ORDER BY path, start_line, id LIMIT 10))", "chunks")
def _(chunks):
    peers = lambda c, kind, n: chunks.where(c).orderBy("path", "start_line", "id").limit(n).select("id", F.lit(kind).alias("kind"))
    return peers("parent_class = 'Class3'", "class", 20).unionByName(peers("namespace = 'ns4'", "namespace", 10))


@query(
    "jn15_suffix_fallback",
    "WITH w AS (SELECT DISTINCT CASE id % 4 WHEN 0 THEN path WHEN 1 THEN 'moved/' || path WHEN 2 THEN 'a/b/' || path ELSE 'none/' || regexp_replace(path, '^.*/', '') END AS path FROM issues), f AS (SELECT DISTINCT path FROM issues), "
    "e AS (SELECT path, cut, array_to_string(list_slice(string_split(path, '/'), cut, 99), '/') AS tail FROM (SELECT path, unnest(range(1, greatest(length(string_split(path, '/')), 2))) AS cut FROM w)), "
    "g AS (SELECT path, arg_min(tail, cut) AS found FROM e WHERE tail IN (SELECT path FROM f) GROUP BY path) SELECT w.path, g.found FROM w LEFT JOIN g USING (path)",
    "issues",
)
def _(issues):
    k = F.col("id") % 4
    moved = F.when(k == 0, F.col("path")).when(k == 1, F.concat(F.lit("moved/"), "path")).when(k == 2, F.concat(F.lit("a/b/"), "path")).otherwise(F.concat(F.lit("none/"), F.regexp_replace("path", "^.*/", "")))
    return J.resolve_suffix(issues.select(moved.alias("path")).distinct(), issues)


@query("jn16_graph_neighbours", "SELECT DISTINCT dst AS node FROM edges WHERE src IN (SELECT dst FROM edges WHERE src < 100) UNION SELECT dst FROM edges WHERE src < 100", "edges")
def _(edges):
    first = edges.where("src < 100").select("dst").distinct()
    second = edges.join(first.withColumnRenamed("dst", "src"), "src", "left_semi").select("dst")
    return first.union(second).distinct().withColumnRenamed("dst", "node")


@query("jn17_overlay", "SELECT id, branch FROM chunks WHERE branch = 'main' AND path NOT IN (SELECT path FROM chunks WHERE branch = 'feature/search') UNION ALL SELECT id, branch FROM chunks WHERE branch = 'feature/search'", "chunks")
def _(chunks):
    top = chunks.where("branch = 'feature/search'").select("id", "branch", "path")
    return J.overlay(chunks.where("branch = 'main'").select("id", "branch", "path"), top, top, "path").select("id", "branch")


@query("jn18_provenance", "WITH a AS (SELECT path, md5(title) AS hash, id AS commit, pr_version AS seq, line AS at FROM issues WHERE id % 3 = 0 AND line IS NOT NULL), l AS (SELECT id, path, md5(title) AS hash, line AS pos FROM issues WHERE id % 3 = 1 AND line IS NOT NULL) SELECT id, arg_min(commit, rank) AS commit FROM (SELECT l.id, a.commit, row_number() OVER (PARTITION BY l.id ORDER BY a.seq DESC, abs(a.at - l.pos), a.at, a.commit) AS rank FROM l JOIN a USING (path, hash)) GROUP BY id", "issues")
def _(issues):
    known = issues.where("line is not null").withColumn("hash", F.md5("title"))
    # equal places of one sequence number: the least commit
    added = known.where("id % 3 = 0").groupBy("path", "hash", F.col("pr_version").alias("seq"), F.col("line").alias("pos")).agg(F.min("id").alias("commit"))
    return J.provenance(known.where("id % 3 = 1").select("id", "path", "hash", F.col("line").alias("pos")), added)


@query("jn19_token_edges", "WITH d AS (SELECT primary_name AS token, id AS dst, branch, path FROM chunks), k AS (SELECT token FROM d GROUP BY token HAVING count(*) < 30), u AS (SELECT id AS src, 'name' || CAST((id * 7) % 120 AS STRING) AS token, branch FROM chunks) SELECT src, token, dst, rank FROM (SELECT u.src, u.token, d.dst, row_number() OVER (PARTITION BY u.src, u.token ORDER BY CASE WHEN u.branch = d.branch THEN 0 ELSE 1 END, d.path, d.dst) AS rank FROM u JOIN d USING (token) WHERE token IN (SELECT token FROM k) AND u.src <> d.dst) WHERE rank <= 3", "chunks")
def _(chunks):
    d = chunks.select(F.col("primary_name").alias("token"), F.col("id").alias("dst"), "branch", "path")
    u = chunks.select(F.col("id").alias("src"), F.concat(F.lit("name"), ((F.col("id") * 7) % 120).cast("string")).alias("token"), "branch")
    return J.token_edges(u, d, 3, [F.col("path"), F.col("dst")])


@query("jn20_lineage_shadow", "WITH RECURSIVE l AS (SELECT id, CASE WHEN id % 10 > 0 THEN id - 1 END AS parent FROM issues), a AS (SELECT id, parent AS anc FROM l WHERE parent IS NOT NULL AND id % 3 = 0 UNION SELECT a.id, l.parent FROM a JOIN l ON l.id = a.anc WHERE l.parent IS NOT NULL) SELECT id FROM issues WHERE id % 3 = 0 AND id NOT IN (SELECT anc FROM a)", "issues")
def _(issues):
    links = issues.select("id", F.when(F.col("id") % 10 > 0, F.col("id") - 1).alias("parent"))
    return J.shadowed(issues.where("id % 3 = 0").select("id"), links)


@query("jn21_paired_modes", "SELECT a.source AS mode, a.k AS case_id, a.n AS n, b.n AS base_n, b.n IS NOT NULL AS paired FROM (SELECT source, doc_id % 30 AS k, count(*) AS n FROM documents GROUP BY 1, 2) a LEFT JOIN (SELECT doc_id % 30 AS k, count(*) AS n FROM documents WHERE source = 'src0' GROUP BY 1) b USING (k) WHERE a.source <> 'src0'", "t:documents")
def _(documents):
    rows = documents.groupBy(F.col("source").alias("mode"), (F.col("doc_id") % 30).alias("case_id")).agg(F.count("*").alias("n"))
    return J.paired(rows, "mode", "case_id", "src0")


@query("jn22_receipts", """WITH c AS (SELECT 'c' || id AS id, CASE WHEN id % 7 = 0 THEN 'abstained' WHEN resolved THEN 'published' ELSE 'rejected' END AS state, ['h' || id // 16, 'h' || (id // 16 + 1)] AS shown, CASE WHEN id % 3 > 0 THEN ['h' || id // 16] ELSE [] END AS stood FROM issues),
h AS (SELECT DISTINCT 'h' || id // 16 AS hunk, 'p' || id // 160 AS path FROM issues), p AS (SELECT hunk, list_sort(list(DISTINCT id)) AS prompt FROM (SELECT id, unnest(shown) AS hunk FROM c) GROUP BY hunk),
a AS (SELECT hunk, list_sort(list(DISTINCT id)) AS anchored, coalesce(list_sort(list(DISTINCT id) FILTER (WHERE state = 'published')), []) AS published, coalesce(list_sort(list(DISTINCT id) FILTER (WHERE state = 'rejected')), []) AS rejected FROM (SELECT id, state, unnest(stood) AS hunk FROM c) GROUP BY hunk)
SELECT hunk, path, coalesce(prompt, []) AS prompt, coalesce(anchored, []) AS anchored, coalesce(published, []) AS published, coalesce(rejected, []) AS rejected, CASE WHEN len(published) > 0 THEN 'published' WHEN len(rejected) > 0 THEN 'rejected' ELSE 'no_anchored_candidate' END AS outcome FROM h LEFT JOIN p USING (hunk) LEFT JOIN a USING (hunk)""", "issues")  # fmt: skip
def _(issues):
    name = lambda head, of: F.concat(F.lit(head), of.cast("string"))
    at = F.expr("id div 16")
    state = F.when(F.col("id") % 7 == 0, "abstained").when(F.col("resolved"), "published").otherwise("rejected")
    c = issues.select(name("c", F.col("id")).alias("id"), state.alias("state"), F.array(name("h", at), name("h", at + 1)).alias("prompt_hunks"), F.when(F.col("id") % 3 > 0, F.array(name("h", at))).alias("anchor_hunks"))
    return J.receipts(issues.select(name("h", at).alias("hunk"), name("p", F.expr("id div 160")).alias("path")).distinct(), c)
