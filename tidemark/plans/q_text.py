"""Queries of text and hash functions."""

from pyspark.sql import functions as F

from ..functions import text as T
from ..shared import bounded_batches
from .registry import query

NL = "regexp_replace({}, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')"
NORM = "trim(" + NL + ")"
LINES = "SELECT doc_id AS doc, unnest(p) AS line, generate_subscripts(p, 1) AS pos FROM (SELECT doc_id, CASE WHEN list_extract(p, -1) = '' THEN list_slice(p, 1, length(p) - 1) ELSE p END AS p FROM (SELECT doc_id, regexp_split_to_array(text, '\\r?\\n') AS p FROM documents))"
# Fixed values, written out here so that a slip in the library shows.
ROOT_STOP = "[" + ", ".join(f"'{w}'" for w in """
    a an and are as at be because by can could for from has have if in into is it may of on or that the their this to was were will with would
""".split()) + "]"
TASK_STOP = "[" + ", ".join(f"'{w}'" for w in """
    about acceptance add added adding after against also another before being branch change changes code context could create criteria description does enable ensure from
    have implement implementation into issue must new only pull request requested return review should support task that their then there these they this through update using
    when where which with without
""".split()) + "]"


@query("txt01_03_lines", f"SELECT doc, CAST(pos AS INTEGER) AS pos, md5({NORM.format('line')}) AS hash FROM ({LINES})", "t:documents")
def _(documents):
    return T.explode_lines(documents).select("doc", "pos", "hash")


TITLE = r"trim(regexp_replace(regexp_replace(regexp_replace(lower(title), '\b(at |on |in )?lines? \d+([-–]\d+)?\b', ' ', 'g'), '(^|\s)\d+(\s|$)', ' \2', 'g'), '\s+', ' ', 'g'))"


@query("txt04_title", f"SELECT id, {TITLE} AS title FROM issues", "issues")
def _(issues):
    return issues.select("id", T.normal_title(F.col("title")).alias("title"))


@query("txt05_06_fingerprints", f"SELECT id, sha256(coalesce(upper(category), 'UNKNOWN') || ':' || coalesce(h, 'no_hash') || ':' || {TITLE}) AS fp, sha256(coalesce(h, 'no_hash') || ':' || {TITLE}) AS content_fp FROM (SELECT *, CASE WHEN line IS NOT NULL THEN md5(reason) END AS h FROM issues)", "issues")
def _(issues):
    h = F.when(F.col("line").isNotNull(), F.md5("reason"))
    return issues.select("id", T.fingerprint(F.col("category"), h, F.col("title")).alias("fp"), T.content_fingerprint(h, F.col("title")).alias("content_fp"))


@query("txt07_anchored_identity", f"SELECT id, CASE WHEN line IS NOT NULL THEN 'f' || id || ':line-hash:' || md5(reason) WHEN id % 2 = 0 THEN 'f' || id || ':snippet:s::' || reason END AS identity FROM issues", "issues")
def _(issues):
    fp = F.concat(F.lit("f"), F.col("id").cast("string"))
    return issues.select("id", T.anchored_identity(fp, F.when(F.col("line").isNotNull(), F.md5("reason")), F.lit("s"), F.col("line"), F.when(F.col("id") % 2 == 0, F.col("reason"))).alias("identity"))


DIFF = "'diff --git a/' || path || ' b/' || path || chr(10) || '+x' || chr(10)"


@query("txt08_diff_fingerprint", f"SELECT project_id, sha256(string_agg(length(s) || ':' || s, '' ORDER BY s)) AS fp FROM (SELECT project_id, {DIFF} AS s FROM (SELECT DISTINCT project_id, path FROM issues)) GROUP BY project_id", "issues")
def _(issues):
    one = F.concat(F.lit("diff --git a/"), F.col("path"), F.lit(" b/"), F.col("path"), F.lit("\r\n+x\r\n"))
    diffs = issues.select("project_id", one.alias("s")).distinct().groupBy("project_id").agg(F.array_join(F.collect_list("s"), "").alias("diff"))
    return diffs.select("project_id", T.diff_fingerprint(F.col("diff")).alias("fp"))


@query("txt09_locate", f"WITH l AS ({LINES}), w AS (SELECT doc, pos, line, doc * 100000 + pos AS id FROM l WHERE pos % 9 = 2), e AS (SELECT w.id, min(l.pos) AS pos FROM w JOIN l ON l.doc = w.doc AND md5({NORM.format('l.line')}) = md5({NORM.format('w.line')}) GROUP BY w.id) SELECT w.id, CAST(e.pos AS INTEGER) AS pos, 'HASH_EXACT' AS how, 1.0::DOUBLE AS confidence FROM w JOIN e USING (id)", "t:documents")
def _(documents):
    lines = T.explode_lines(documents)
    wanted = lines.where("pos % 9 = 2").select((F.col("doc") * 100000 + F.col("pos")).alias("id"), "doc", F.col("line").alias("snippet"))
    return T.locate(wanted, lines)


@query("txt10_split", None, "t:documents")
def _(documents):
    bounded_batches(documents.sparkSession)
    return documents.select("doc_id", F.posexplode(T.split_text(2000, 200)(F.col("text"))).alias("index", "chunk"))


@query("txt12_fixed_split", "SELECT doc_id, CAST(i AS INTEGER) AS index, substr(text, CAST(i * 1800 + 1 AS INTEGER), 2000) AS chunk FROM (SELECT doc_id, text, unnest(range(0, greatest(1, CAST(ceil((length(text) - 200) / 1800) AS BIGINT)))) AS i FROM documents)", "t:documents")
def _(documents):
    n = F.greatest(F.lit(1), F.ceil((F.length("text") - 200) / 1800))
    at = documents.select("doc_id", "text", F.explode(F.sequence(F.lit(0), n.cast("int") - 1)).alias("index"))
    return at.select("doc_id", "index", F.substring(F.col("text"), F.col("index") * 1800 + 1, F.lit(2000)).alias("chunk"))


@query("txt13_chunk_id", "SELECT id, substr(sha256(path || ':' || CAST(start_line AS STRING) || ':' || substr(text, 1, 500)), 1, 32) AS chunk FROM chunks", "chunks")
def _(chunks):
    return chunks.select("id", T.chunk_id(F.col("path"), F.col("start_line"), F.col("text")).alias("chunk"))


@query("txt14_metadata", "SELECT conv_id, turn, list_slice(list_distinct_ordered, 1, 30) AS names FROM (SELECT conv_id, turn, [x FOR x, i IN regexp_extract_all('class ' || role || '_x extends Base' || CAST(turn AS STRING) || ' def ' || role || '() def other()', '(?:class|interface|def|func|function|struct|trait)\\s+([A-Za-z_]\\w*)', 1) IF true] AS list_distinct_ordered FROM conversations)", "t:conversations")
def _(conversations):
    code = F.concat(F.lit("class "), F.col("role"), F.lit("_x extends Base"), F.col("turn").cast("string"), F.lit(" def "), F.col("role"), F.lit("() def other()"))
    return conversations.select("conv_id", "turn", T.metadata(code)["names"].alias("names"))


@query("txt15_header", "SELECT id, concat_ws(' | ', 'File: ' || path, 'In: ' || parent_class, 'Namespace: ' || namespace) AS header FROM chunks", "chunks")
def _(chunks):
    return chunks.select("id", T.embedding_header(File=F.col("path"), In=F.col("parent_class"), Namespace=F.col("namespace")).alias("header"))


@query("txt16_archive_path", "SELECT id, CASE id % 4 WHEN 2 THEN 'repo-xyz/' || path WHEN 3 THEN 'a-0a1b2c3/' || path ELSE path END AS clean FROM chunks", "chunks")
def _(chunks):
    k = F.col("id") % 4
    # an archive's root, none, a name that is no root, and a root below a root, of which the first goes
    head = F.when(k == 0, F.concat(F.lit("repo-"), F.substring(F.md5("path"), 1, 12), F.lit("/"))).when(k == 2, "repo-xyz/").when(k == 3, "b-0a1b2c3d4e/a-0a1b2c3/").otherwise("")
    return chunks.select("id", T.clean_archive_path(F.concat(head, "path")).alias("clean"))


@query("txt17_language", "SELECT id, CASE regexp_extract(path, '\\.([a-z]+)$', 1) WHEN 'py' THEN 'python' WHEN 'java' THEN 'java' WHEN 'ts' THEN 'typescript' WHEN 'md' THEN 'markdown' ELSE 'text' END AS lang FROM chunks", "chunks")
def _(chunks):
    return chunks.select("id", T.language_of(F.col("path")).alias("lang"))


@query("txt18_slug", "SELECT id, replace(replace(lower(path), '/', '_'), '.', '_') AS slug FROM chunks", "chunks")
def _(chunks):
    return chunks.select("id", T.slug(F.col("path")).alias("slug"))


@query("txt19_query_snippets", "SELECT id, CASE WHEN length(reason) > 15 THEN reason END AS q FROM issues", "issues")
def _(issues):
    return issues.select("id", T.query_snippets(F.concat(F.lit("+"), F.col("reason"), F.lit("\n-\n "))).alias("q"))


@query("txt20_duplication_queries", "SELECT role, kind, query, CAST(count(*) AS BIGINT) AS n FROM (SELECT role, unnest([{'kind': 'definition', 'query': 'load_' || role}, {'kind': 'type', 'query': 'Big'}, {'kind': 'call', 'query': 'load_' || role}, {'kind': 'call', 'query': 'save'}], recursive := true) FROM conversations) GROUP BY ALL", "t:conversations")
def _(conversations):
    code = F.concat(F.lit("class Big: def load_"), F.col("role"), F.lit("(x): save(x)"))
    return conversations.select("role", F.inline(T.duplication_queries(code))).groupBy("role", "kind", "query").agg(F.count("*").alias("n"))


@query("txt21_identifiers", "SELECT id, ids FROM (SELECT id, regexp_extract_all(path, '([A-Za-z_][A-Za-z0-9_]{2,})', 1) AS ids FROM issues)", "issues")
def _(issues):
    return issues.select("id", T.identifiers(F.col("path")).alias("ids"))


@query("txt22_task_terms", rf"""WITH t AS (SELECT id, reason || ' ' || path || ': utf8Decoder_v' || id % 5 || ' getHTTPResponse.x1, v2Api/ (' || author || 'Fix) 12345 with' AS t FROM issues),
w AS (SELECT id, unnest(regexp_extract_all(t, '[A-Za-z][A-Za-z0-9_.:$\\/-]{{2,}}')) AS w FROM t),
c AS (SELECT DISTINCT id, regexp_replace(lower(unnest(list_concat([w], string_split(regexp_replace(w, '([a-z0-9])([A-Z])', '\1 \2', 'g'), ' ')))), '^[./\\_:-]+|[./\\_:-]+$', '', 'g') AS c FROM w)
SELECT id, list(c ORDER BY -length(c), c) AS terms FROM c WHERE length(c) >= 3 AND NOT list_contains({TASK_STOP}, c) AND NOT regexp_matches(c, '^[0-9]+$') GROUP BY id""", "issues")
def _(issues):
    text = F.concat("reason", F.lit(" "), "path", F.lit(": utf8Decoder_v"), (F.col("id") % 5).cast("string"), F.lit(" getHTTPResponse.x1, v2Api/ ("), "author", F.lit("Fix) 12345 with"))
    return issues.select("id", T.task_terms(text).alias("terms"))


@query("txt23_relation_token", "SELECT id, replace(lower(path), '/', '.') AS token FROM issues", "issues")
def _(issues):
    return issues.select("id", T.relation_token(F.concat(F.lit(" '"), F.col("path"), F.lit("'"))).alias("token"))


@query("txt24_sequence_ratio", None, "issues")
def _(issues):
    return issues.select("id", F.round(T.sequence_ratio(F.col("title"), F.col("reason")), 6).alias("ratio"))


@query("txt25_overlap", f"WITH t AS (SELECT id, list_filter(list_distinct(regexp_extract_all(lower(title), '[a-z0-9_$]+')), lambda w: length(w) > 1 AND NOT list_contains({ROOT_STOP}, w)) AS a, list_filter(list_distinct(regexp_extract_all(lower(reason), '[a-z0-9_$]+')), lambda w: length(w) > 1 AND NOT list_contains({ROOT_STOP}, w)) AS b FROM issues), n AS (SELECT id, length(list_intersect(a, b)) AS c, length(a) AS x, length(b) AS y FROM t) SELECT id, CAST(c AS INTEGER) AS common, round(c / least(x, y), 6) AS containment, round(c / (x + y - c), 6) AS jaccard FROM n", "issues")
def _(issues):
    o = T.overlap(T.token_set(F.col("title")), T.token_set(F.col("reason")))
    return issues.select("id", o["common"].alias("common"), F.round(o["containment"], 6).alias("containment"), F.round(o["jaccard"], 6).alias("jaccard"))


@query("txt26_also_affects", "SELECT id, CASE WHEN id % 3 = 2 THEN '' ELSE reason END AS body, CASE id % 3 WHEN 0 THEN [path, 'x.py'] WHEN 1 THEN [] ELSE [author, path, title] END AS places FROM issues", "issues")
def _(issues):
    k = F.col("id") % 3
    listed = F.concat(F.col("reason"), F.lit("\nAlso affects:\n- "), F.col("path"), F.lit("\n- x.py\n"))
    s = T.split_also_affects(F.when(k == 0, listed).when(k == 1, F.col("reason")).otherwise(F.concat(F.lit("ALSO affects: "), F.concat_ws(", ", "author", "path", "title"))))
    return issues.select("id", s["body"].alias("body"), s["places"].alias("places"))


#: A kind of change by id % 7: its head, its hunks, and what the parser must find (change, then for each hunk its number, new start, new count and lines).
CHANGES = [
    ("new file mode 100644\nindex 0..1\n--- /dev/null\n+++ b/{p}\n@@ -0,0 +1,2 @@\n+a\n+b\n", "added", [(0, 1, 2, 2)]),
    ("deleted file mode 100644\n--- a/{p}\n+++ /dev/null\n@@ -1,2 +0,0 @@\n-a\n-b", "deleted", [(0, 0, 0, 2)]),
    ("index 1..2 100644\n--- a/{p}\n+++ b/{p}\n@@ -1,2 +1,2 @@ f\n a\n-b\n+c\n@@ -30 +30 @@\n+d\n\\ No newline at end of file\n", "modified", [(0, 1, 2, 3), (1, 30, 1, 1)]),
    ("similarity index 100%\nrename from old/{p}\nrename to {p}\n", "renamed", []),
    ("index 1..2 100644\nBinary files a/{p} and b/{p} differ\n", "binary", []),
    ("index 1..2 160000\n--- a/{p}\n+++ b/{p}\n@@ -1 +1 @@\n-Subproject commit 1\n+Subproject commit 2\n", "gitlink", [(0, 1, 1, 2)]),
    ("--- a/{p}\n+++ b/{p}\n@@ -x,2 +y @@\n+a\n", "modified", []),
]
EXPECTED = ", ".join(str((k, change, *h)).replace("None", "NULL") for k, (_, change, hunks) in enumerate(CHANGES) for h in hunks or [(None,) * 4])


@query("txt27_parse_diff", f"SELECT id, path, change, CAST(hunk AS INTEGER) AS hunk, CAST(new_start AS INTEGER) AS new_start, CAST(new_count AS INTEGER) AS new_count, CAST(n_lines AS INTEGER) AS n_lines FROM issues JOIN (VALUES {EXPECTED}) AS e(k, change, hunk, new_start, new_count, n_lines) ON k = id % 7", "issues")
def _(issues):
    body = F.element_at(F.array(*(F.lit(x) for x, *_ in CHANGES)), (F.col("id") % 7 + 1).cast("int"))
    old = F.when(F.col("id") % 7 == 3, F.concat(F.lit("old/"), "path")).otherwise(F.col("path"))
    diff = F.concat(F.lit("diff --git a/"), old, F.lit(" b/"), F.col("path"), F.lit("\n"), F.replace(body, F.lit("{p}"), F.col("path")))
    hunks = T.parse_diff(issues.select("id", diff.alias("diff")))
    return hunks.select("id", "path", "change", "hunk", "new_start", "new_count", F.when(F.col("lines").isNotNull(), F.size("lines")).alias("n_lines"))


@query("txt28_chunk_diff", None, "t:documents")
def _(documents):
    # every line of a text becomes a hunk
    hunks = F.transform(F.split("text", "\n", -1), lambda x, i: F.concat(F.lit("@@ -"), i.cast("string"), F.lit(",1 +"), i.cast("string"), F.lit(",1 @@\n+"), x, F.lit("\n")))
    diff = F.concat(F.lit("diff --git a/"), "source", F.lit(" b/"), "source", F.lit("\n"), F.array_join(hunks, ""))
    return documents.select("doc_id", F.posexplode(T.chunk_diff(diff, 1000)).alias("index", "chunk"))


@query("txt29_diff_summary", r"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents), e AS (SELECT doc_id, unnest(p) AS t, generate_subscripts(p, 1) AS i FROM l),
m AS (SELECT doc_id, i, CASE WHEN i = 1 THEN '--- a/' || doc_id WHEN i = 2 THEN '+++ b/' || doc_id WHEN i % 5 = 0 THEN '@@ -' || i % 30 || ',3 +1 @@ f ' WHEN i % 3 = 0 THEN '+' || length(t) % 7 WHEN i % 3 = 1 THEN '-' || length(t) % 5 ELSE ' ' || t END AS x FROM e),
c AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r FROM m WHERE (x LIKE '+%' AND x NOT LIKE '+++%') OR (x LIKE '-%' AND x NOT LIKE '---%')),
h AS (SELECT doc_id, list(x ORDER BY i)[1:20] AS headers FROM (SELECT doc_id, trim(x) AS x, min(i) AS i FROM m WHERE x LIKE '@@%' GROUP BY ALL) GROUP BY doc_id),
s AS (SELECT doc_id, list(x ORDER BY i) AS sample FROM (SELECT doc_id, x, min(i) AS i FROM c WHERE r <= 80 GROUP BY ALL) GROUP BY doc_id),
n AS (SELECT doc_id, CAST(count(*) FILTER (WHERE x LIKE '+%') AS INTEGER) AS added, CAST(count(*) FILTER (WHERE x LIKE '-%') AS INTEGER) AS deleted FROM c GROUP BY doc_id)
SELECT l.doc_id, coalesce(added, 0) AS added, coalesce(deleted, 0) AS deleted, coalesce(headers, []) AS headers, coalesce(sample, []) AS sample FROM l LEFT JOIN n USING (doc_id) LEFT JOIN h USING (doc_id) LEFT JOIN s USING (doc_id)""", "t:documents")  # fmt: skip
def _(documents):
    s = lambda head, of: F.concat(F.lit(head), of.cast("string"))

    def line(t, k):
        i = k + 1
        return (
            F.when(i == 1, s("--- a/", F.col("doc_id"))).when(i == 2, s("+++ b/", F.col("doc_id"))).when(i % 5 == 0, F.concat(s("@@ -", i % 30), F.lit(",3 +1 @@ f ")))
            .when(i % 3 == 0, s("+", F.length(t) % 7)).when(i % 3 == 1, s("-", F.length(t) % 5)).otherwise(F.concat(F.lit(" "), t))
        )

    return documents.select("doc_id", T.diff_summary(F.transform(F.split("text", "\n", -1), line)).alias("d")).select("doc_id", "d.*")


@query("txt30_snippets", "WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents) SELECT doc_id, CAST(i AS INTEGER) AS i, array_to_string(list_slice(p, i * 8 + 1, i * 8 + 8), chr(10)) AS snippet FROM (SELECT doc_id, p, unnest(range(0, least(10, CAST(ceil(length(p) / 8) AS BIGINT)))) AS i FROM l)", "t:documents")
def _(documents):
    return documents.select("doc_id", F.posexplode(T.snippets(F.split("text", "\n", -1))).alias("i", "snippet"))


@query("txt31_budget", "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents), s AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY pos) AS used FROM l) SELECT doc_id, CAST(count(*) FILTER (WHERE used <= 1500) AS INTEGER) AS kept, CAST(count(*) FILTER (WHERE used > 1500) AS INTEGER) AS omitted FROM s GROUP BY doc_id", "t:documents")
def _(documents):
    b = T.budget(F.split("text", "\n", -1), 1500)
    return documents.select("doc_id", F.size(b["kept"]).alias("kept"), b["omitted"].alias("omitted"))


# Fixed values, written out here too.
SUSPECT = " OR ".join(f"regexp_matches(bare, '{p}', 'i')" for p in [
    r"\b(ignore|disregard|forget)\s+(all\s+)?(previous|above|prior)\s+(instructions?|prompts?|rules?)",
    r"\b(new|different|change)\s+(system\s+)?(prompt|instructions?|rules?)",
    r"\byou\s+are\s+(now|a)\b",
    r"\b(act|behave|pretend)\s+(as|like)\s+",
    r"\brole\s*[:=]",
    r"\b(output|print|write|return)\s+(only|just|exactly)",
    r"\bformat\s*[:=]\s*(json|xml|raw)",
    r"###\s*(system|assistant|user)",
    r"<\|?(system|assistant|user|endof)\|?>",
    r"\[\s*(INST|SYS)\s*\]",
    r"\b(reveal|show|display|tell)\s+(me\s+)?(your|the)\s+(system|initial|original)\s+(prompt|instructions?)",
    r"\bwhat\s+(are|is)\s+your\s+(system\s+)?(prompt|instructions?|rules?)",
    r"\bexec(ute)?\s*\(",
    r"\beval\s*\(",
    r"\bos\s*\.\s*(system|popen|exec)",
    r"\bsubprocess\s*\.",
    r"\bimport\s+(os|sys|subprocess)",
])


@query("txt32_sanitise", rf"WITH c AS (SELECT conv_id, turn, regexp_replace(role || ':    ' || text || ' ### <|x|> ' || chr(7), '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g') AS bare FROM conversations) SELECT conv_id, turn, CASE WHEN length(bare) BETWEEN 1 AND 2000 AND NOT ({SUSPECT}) THEN trim(regexp_replace(replace(replace(replace(regexp_replace(bare, '\s{{3,}}', '  ', 'g'), '###', '# # #'), '<|', '< |'), '|>', '| >'), '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g')) END AS clean FROM c", "t:conversations")
def _(conversations):
    return conversations.select("conv_id", "turn", T.sanitised(F.concat("role", F.lit(":    "), "text", F.lit(" ### <|x|> \x07"))).alias("clean"))


@query("txt33_redact", """WITH e AS (SELECT *, replace(props, ' ', '') AS p FROM events)
SELECT event_id, '{"items":[{"apiKey":""},{"deep":[[' || p || ']],"x-api-key":"[REDACTED]"}],"note":"' || event_type || '","service_base_url":"https://host' || user_id % 7 || ':8080/p","token":' || CASE event_id % 3 WHEN 0 THEN '"[REDACTED]"' WHEN 1 THEN 'null' ELSE '{}' END || ',"tokens":["' || event_type || '"],"user":{"Password":' || CASE event_id % 5 WHEN 0 THEN '[]' ELSE '"[REDACTED]"' END || ',"who":' || user_id || '}}' AS props FROM e""", "t:events")
def _(events):
    secret, password = F.expr("case event_id % 3 when 0 then '\"s\"' when 1 then 'null' else '{}' end"), F.expr("case event_id % 5 when 0 then '[]' else concat('{\"a\": ', props, ', \"b\": \"y2\"}') end")
    parts = ['{"user": {"Password": ', password, ', "who": ', F.col("user_id").cast("string"), '}, "tokens": ["', F.col("event_type"), '"], "token": ', secret, ', "items": [{"apiKey": ""}, {"x-api-key": ', F.col("event_id").cast("string"), ', "deep": [[', F.col("props"), ']]}], "service_base_url": "https://u:p@host', (F.col("user_id") % 7).cast("string"), ':8080/p?q=1#f", "note": "', F.col("event_type"), '"}']
    return events.select("event_id", T.redacted(F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))).alias("props"))


@query("win07_context_hash", f"WITH l AS (SELECT doc, pos, md5({NORM.format('line')}) AS h FROM ({LINES})) SELECT doc, CAST(pos AS INTEGER) AS pos, md5(string_agg(h, '') OVER (PARTITION BY doc ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) AS context FROM l", "t:documents")
def _(documents):
    return T.context_hash(T.explode_lines(documents), 2).select("doc", "pos", "context")


@query("win08_range_hash", f"WITH l AS (SELECT doc, pos, md5({NORM.format('line')}) AS h FROM ({LINES})) SELECT doc AS id, md5(string_agg(h, '' ORDER BY pos)) AS range_hash FROM l WHERE pos BETWEEN 2 AND 6 GROUP BY doc", "t:documents")
def _(documents):
    ranges = documents.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("doc"), F.lit(2).alias("first"), F.lit(6).alias("last"))
    return T.range_hash(ranges, T.explode_lines(documents))


@query("json_event_props", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events", "t:events")
def _(events):
    return events.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))
