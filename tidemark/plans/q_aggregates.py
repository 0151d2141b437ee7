"""Queries of aggregations and windows."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import aggregates as A
from .registry import query

OPEN = "count(*) FILTER (WHERE NOT resolved"
LONG = lambda x, name: f"CAST({x} AS BIGINT) AS {name}"
COUNTS = ", ".join([LONG(OPEN + ")", "total"), *[LONG(f"{OPEN} AND severity = '{s}')", s.lower()) for s in ("HIGH", "MEDIUM", "LOW", "INFO")], LONG("count(*) FILTER (WHERE resolved)", "resolved")])


@query("agg01_conditional_counts", f"SELECT project_id, {COUNTS} FROM issues GROUP BY project_id", "issues")
def _(issues):
    return A.counters(issues, "project_id")


@query("agg02_counter_refresh", f"SELECT project_id, pr, {COUNTS} FROM issues GROUP BY project_id, pr", "issues")
def _(issues):
    return A.counters(issues, "project_id", "pr")


@query("agg03_count_by_severity", "SELECT severity, CAST(count(*) AS BIGINT) AS n FROM issues WHERE NOT resolved GROUP BY severity", "issues")
def _(issues):
    return issues.where("not resolved").groupBy("severity").agg(F.count("*").alias("n"))


@query("agg04_top_files_project", "SELECT coalesce(path, 'unknown') AS path, CAST(count(*) AS BIGINT) AS n FROM issues GROUP BY 1 ORDER BY n DESC, path LIMIT 10", "issues")
def _(issues):
    return A.top_files(issues, 10, unresolved_only=False)


@query("agg04_top_files_branch", "SELECT coalesce(path, 'unknown') AS path, CAST(count(*) AS BIGINT) AS n FROM issues WHERE NOT resolved GROUP BY 1 ORDER BY n DESC, path LIMIT 10", "issues")
def _(issues):
    return A.top_files(issues, 10, unresolved_only=True)


@query("agg05_distinct_files", "SELECT project_id, CAST(count(DISTINCT path) AS BIGINT) AS files FROM issues GROUP BY project_id", "issues")
def _(issues):
    return issues.groupBy("project_id").agg(F.count_distinct("path").alias("files"))


@query("agg06_by_category", "SELECT k.category, CAST(count(i.id) AS BIGINT) AS n FROM (SELECT unnest(['security','performance','quality','bug_risk','style','documentation','best_practices','error_handling','testing','architecture']) AS category) k LEFT JOIN (SELECT id, CASE WHEN category = 'code_quality' THEN 'quality' ELSE category END AS category FROM issues WHERE NOT resolved) i ON i.category = k.category GROUP BY 1", "issues")
def _(issues):
    return A.by_category(issues)


@query("agg07_average_per_run", "SELECT project_id, round(avg(total), 6) AS mean FROM analyses GROUP BY project_id", "analyses")
def _(analyses):
    return analyses.groupBy("project_id").agg(F.round(F.avg("total"), 6).alias("mean"))


@query("agg08_next_version", "SELECT p.project_id, CAST(coalesce(max(a.pr_version), 0) + 1 AS BIGINT) AS next FROM (SELECT unnest(range(0, 25)) AS project_id) p LEFT JOIN analyses a ON a.project_id = p.project_id GROUP BY 1", "analyses")
def _(analyses):
    projects = analyses.sparkSession.range(25).withColumnRenamed("id", "project_id")
    return projects.join(analyses, "project_id", "left").groupBy("project_id").agg((F.coalesce(F.max("pr_version"), F.lit(0)) + 1).alias("next"))


@query("agg09_exists", "SELECT project_id, count(*) FILTER (WHERE status = 'RUNNING' AND event_type = 'error') > 0 AS active FROM audit GROUP BY project_id", "audit")
def _(audit):
    return audit.groupBy("project_id").agg((A.count_where((F.col("status") == "RUNNING") & (F.col("event_type") == "error")) > 0).alias("active"))


@query("agg10_windowed_sum", "SELECT project_id, round(sum(ms), 4) AS used FROM audit WHERE received_at >= TIMESTAMP '2024-01-20' GROUP BY project_id", "audit")
def _(audit):
    return audit.where(F.col("received_at") >= F.lit("2024-01-20").cast("timestamp")).groupBy("project_id").agg(F.round(F.sum("ms"), 4).alias("used"))


@query("agg11_daily_audit", "SELECT CAST(CAST(received_at AS DATE) AS STRING) AS day, provider, event_type, status, CAST(count(*) AS BIGINT) AS n, CAST(floor(avg(ms)) AS BIGINT) AS mean_ms, max(ms) AS max_ms FROM audit WHERE received_at > (SELECT max(received_at) FROM audit) - INTERVAL 30 DAYS GROUP BY 1, 2, 3, 4", "audit")
def _(audit):
    last = F.broadcast(audit.agg(F.max("received_at").alias("last")))
    rows = audit.join(last, F.col("received_at") > F.col("last") - F.expr("INTERVAL 30 DAYS"))
    return rows.groupBy(F.to_date("received_at").cast("string").alias("day"), "provider", "event_type", "status").agg(F.count("*").alias("n"), F.floor(F.avg("ms")).alias("mean_ms"), F.max("ms").alias("max_ms"))


@query("agg12_dedup_keep_min", "SELECT id FROM issues i WHERE id = (SELECT min(id) FROM issues j WHERE j.project_id = i.project_id AND j.path = i.path AND j.severity = i.severity AND j.title = i.title AND coalesce(j.category, '-') = coalesce(i.category, '-'))", "issues")
def _(issues):
    return A.keep_first(issues, [F.col("project_id"), F.col("path"), F.col("severity"), F.col("title"), F.coalesce("category", F.lit("-"))]).select("id")


@query("agg13_worst_severity", "SELECT path, CASE min(CASE severity WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 3 ELSE 4 END) WHEN 1 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' WHEN 3 THEN 'LOW' ELSE 'INFO' END AS worst FROM issues GROUP BY path", "issues")
def _(issues):
    return A.worst_severity(issues, "path")


@query("agg14_letter", "SELECT id, CASE WHEN total = 0 THEN 'A+' WHEN 3*high+2*medium+low <= 5 THEN 'A' WHEN 3*high+2*medium+low <= 15 THEN 'B' WHEN 3*high+2*medium+low <= 30 THEN 'C' WHEN 3*high+2*medium+low <= 50 THEN 'D' ELSE 'F' END AS grade FROM analyses", "analyses")
def _(analyses):
    return analyses.select("id", A.letter(F.col("high"), F.col("medium"), F.col("low"), F.col("total")).alias("grade"))


GATE = [("g", "ISSUES_BY_SEVERITY", "HIGH", None, "GREATER_THAN", 1, True), ("g", "NEW_ISSUES", None, None, "GREATER_THAN_OR_EQUAL", 5, True), ("g", "ISSUES_BY_SEVERITY", "LOW", None, "EQUAL", 3, True), ("g", "NEW_ISSUES", None, None, "LESS_THAN", 100, False)]


@query("agg15_quality_gate", "SELECT id, CASE WHEN high > 1 OR total - resolved >= 5 OR low = 3 THEN 'FAILED' ELSE 'PASSED' END AS result, CAST((CASE WHEN high > 1 THEN 1 ELSE 0 END) + (CASE WHEN total - resolved >= 5 THEN 1 ELSE 0 END) + (CASE WHEN low = 3 THEN 1 ELSE 0 END) AS BIGINT) AS n_failed FROM analyses", "analyses")
def _(analyses):
    metric = lambda name, sev, v: F.struct(F.lit(name).alias("metric"), F.lit(sev).cast("string").alias("severity"), F.lit(None).cast("string").alias("category"), v.alias("value"))
    each = F.array(metric("ISSUES_BY_SEVERITY", "HIGH", F.col("high")), metric("ISSUES_BY_SEVERITY", "LOW", F.col("low")), metric("NEW_ISSUES", None, F.col("total") - F.col("resolved")))
    metrics = analyses.select("id", F.inline(each))
    conditions = analyses.sparkSession.createDataFrame(GATE, "gate string, metric string, severity string, category string, comparator string, threshold long, enabled boolean")
    return A.evaluate_gate(metrics, conditions)


@query("agg16_trend", "WITH r AS (SELECT project_id, total, row_number() OVER (PARTITION BY project_id ORDER BY created_at, id) AS i, count(*) OVER (PARTITION BY project_id) AS n FROM analyses), m AS (SELECT project_id, max(n) AS n, avg(total) FILTER (WHERE i <= floor(n / 2)) AS a, avg(total) FILTER (WHERE i > floor(n / 2)) AS b FROM r GROUP BY 1) SELECT project_id, CASE WHEN n < 2 THEN 'stable' WHEN a = 0 THEN (CASE WHEN b > 0 THEN 'up' ELSE 'stable' END) WHEN (b - a) / a > 0.1 THEN 'up' WHEN (b - a) / a < -0.1 THEN 'down' ELSE 'stable' END AS trend FROM m", "analyses")
def _(analyses):
    return A.trend(analyses, "project_id", "created_at", "total", "id")


FROM, NOW = "1996-03-01 06:30:00", "1996-05-31 18:00:00"


@query("agg17_daily_snapshots", f"SELECT CAST(d AS STRING) AS day, CAST(count(*) FILTER (WHERE created_at <= d AND NOT (resolved AND resolved_at <= d)) AS BIGINT) AS open, CAST(count(*) FILTER (WHERE created_at <= d AND resolved AND resolved_at <= d) AS BIGINT) AS done, CAST(count(*) FILTER (WHERE severity = 'HIGH' AND created_at <= d AND NOT (resolved AND resolved_at <= d)) AS BIGINT) AS high, CAST(count(*) FILTER (WHERE severity = 'MEDIUM' AND created_at <= d AND NOT (resolved AND resolved_at <= d)) AS BIGINT) AS medium, CAST(count(*) FILTER (WHERE severity = 'LOW' AND created_at <= d AND NOT (resolved AND resolved_at <= d)) AS BIGINT) AS low FROM (SELECT d FROM (SELECT unnest(generate_series(TIMESTAMP '{FROM}', TIMESTAMP '{NOW}', INTERVAL 1 DAY)) AS d UNION SELECT TIMESTAMP '{NOW}') ORDER BY d DESC LIMIT 60), issues GROUP BY d", "issues")
def _(issues):
    return A.daily_snapshots(issues, FROM, NOW, 60).withColumn("day", F.date_format("day", "yyyy-MM-dd HH:mm:ss"))


@query("agg18_resolved_rate", "SELECT project_id, id, rate FROM (SELECT project_id, id, created_at, round(CASE WHEN total > 0 THEN resolved / total ELSE 0 END, 6) AS rate, row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, id DESC) AS r FROM analyses) WHERE r <= 12", "analyses")
def _(analyses):
    w = Window.partitionBy("project_id").orderBy(F.desc("created_at"), F.desc("id"))
    rate = F.round(F.when(F.col("total") > 0, F.col("resolved") / F.col("total")).otherwise(0.0), 6)
    return analyses.withColumn("r", F.row_number().over(w)).where("r <= 12").select("project_id", "id", rate.alias("rate"))


CASES = "SELECT source AS mode, doc_id % 25 AS case_id, list(DISTINCT doc_id) FILTER (WHERE quality = 1) AS expected, list(DISTINCT doc_id) FILTER (WHERE n_chars > 1200) AS published FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2"


def cases(documents, labels):
    rows = documents.join(labels, "doc_id")
    return rows.groupBy(F.col("source").alias("mode"), (F.col("doc_id") % 25).alias("case_id")).agg(F.collect_set(F.when(F.col("quality") == 1, F.col("doc_id"))).alias("expected"), F.collect_set(F.when(F.col("n_chars") > 1200, F.col("doc_id"))).alias("published"))


PR = "SELECT {by}, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall FROM (SELECT {by_sql}, count(*) FILTER (WHERE quality = 1 AND n_chars > 1200) AS tp, count(*) FILTER (WHERE quality = 0 AND n_chars > 1200) AS fp, count(*) FILTER (WHERE quality = 1 AND n_chars <= 1200) AS fn FROM documents JOIN labels USING (doc_id) GROUP BY 1)"


def rounded(df):
    return df.withColumn("precision", F.round("precision", 6)).withColumn("recall", F.round("recall", 6))


@query("agg19_precision_recall", PR.format(by="mode", by_sql="source AS mode"), "t:documents", "t:labels")
def _(documents, labels):
    return rounded(A.precision_recall(cases(documents, labels), "mode"))


@query("agg20_median_p95", "SELECT project_id, quantile_disc(total, 0.95) AS p95, round(median(total), 6) AS med FROM analyses GROUP BY project_id", "analyses")
def _(analyses):
    # the median of an even number is the middle of its two neighbours: of rank n / 2, and, from above, of the values' negatives
    low = A.exact_quantiles(analyses, "project_id", "total", {"p95": 0.95, "below": 0.5})
    high = A.exact_quantiles(analyses.select("project_id", (-F.col("total")).alias("total")), "project_id", "total", {"above": 0.5})
    return low.join(high, "project_id").select("project_id", "p95", F.round((F.col("below") - F.col("above")) / 2, 6).alias("med"))


@query("agg20_quantiles_of_all", "SELECT l_linestatus, quantile_disc(l_extendedprice, 0.5) AS p50, quantile_disc(l_extendedprice, 0.95) AS p95, quantile_disc(l_extendedprice, 0.0001) AS least FROM lineitem GROUP BY l_linestatus", "t:lineitem")
def _(lineitem):
    return A.exact_quantiles(lineitem, "l_linestatus", "l_extendedprice", {"p50": 0.5, "p95": 0.95, "least": 0.0001})


@query("agg21_stratified", PR.format(by="profile", by_sql="CASE WHEN lang < source THEN lang || '+' || source ELSE source || '+' || lang END AS profile"), "t:documents", "t:labels")
def _(documents, labels):
    rows = documents.withColumn("profile", F.concat_ws("+", F.sort_array(F.array("lang", "source")))).join(labels, "doc_id")
    each = rows.groupBy("profile", (F.col("doc_id") % 25).alias("case_id")).agg(F.collect_set(F.when(F.col("quality") == 1, F.col("doc_id"))).alias("expected"), F.collect_set(F.when(F.col("n_chars") > 1200, F.col("doc_id"))).alias("published"))
    return rounded(A.precision_recall(each, "profile"))


@query("agg22_labelled_replay", "SELECT toxic, CAST(count(*) FILTER (WHERE quality = 1 AND p) AS BIGINT) AS tp, CAST(count(*) FILTER (WHERE quality = 0 AND p) AS BIGINT) AS fp, CAST(count(*) FILTER (WHERE quality = 1 AND NOT p) AS BIGINT) AS fn, CAST(count(*) FILTER (WHERE quality = 0 AND NOT p) AS BIGINT) AS tn FROM (SELECT *, doc_id % 3 > 0 AS p FROM labels) GROUP BY toxic", "t:labels")
def _(labels):
    p, q = F.col("doc_id") % 3 > 0, F.col("quality") == 1
    return labels.groupBy("toxic").agg(A.count_where(q & p).alias("tp"), A.count_where(~q & p).alias("fp"), A.count_where(q & ~p).alias("fn"), A.count_where(~q & ~p).alias("tn"))


COST = "SELECT mode, CAST(sum(cost) AS DOUBLE) AS tokens, sum(cost) / count(*) AS case_cost, CAST(quantile_disc(cost, 0.95) AS DOUBLE) AS p95_cost FROM (SELECT source AS mode, doc_id % 25 AS case_id, sum(n_chars) AS cost FROM documents GROUP BY 1, 2) GROUP BY mode"


@query("agg23_acceptance_gate", f"WITH m AS (SELECT * FROM ({PR.format(by='mode', by_sql='source AS mode')}) JOIN ({COST}) USING (mode)), b AS (SELECT * FROM m WHERE mode = 'src0') SELECT m.mode, m.precision >= 0.6 AS precision_ok, m.recall >= 0.6 AS recall_ok, m.precision - b.precision >= -0.05 AS precision_held, m.recall - b.recall >= -0.05 AS recall_held, m.tokens <= 1.1 * b.tokens AS tokens_ok, m.case_cost <= 1.1 * b.case_cost AS case_cost_ok, m.p95_cost <= 1.1 * b.p95_cost AS p95_cost_ok FROM m, b", "t:documents", "t:labels")
def _(documents, labels):
    costs = documents.groupBy(F.col("source").alias("mode"), F.col("doc_id") % 25).agg(F.sum("n_chars").alias("cost")).groupBy("mode")
    costs = costs.agg(F.sum("cost").cast("double").alias("tokens"), F.avg("cost").alias("case_cost"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY cost)").alias("p95_cost"))
    return A.accepted(rounded(A.precision_recall(cases(documents, labels), "mode")).join(costs, "mode").select("mode", "precision", "recall", "tokens", "case_cost", "p95_cost"), "src0")


TOP = lambda c, n, k: f"(SELECT '{n}' AS counter, CAST({c} AS STRING) AS value, CAST(count(*) AS BIGINT) AS n FROM chunks WHERE {c} IS NOT NULL GROUP BY 2 ORDER BY n DESC, value LIMIT {k})"


NAMES = "(SELECT 'name' AS counter, value, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest([primary_name, parent_class, namespace, branch, language]) AS value FROM chunks) WHERE value IS NOT NULL GROUP BY value ORDER BY n DESC, value LIMIT 120)"


@query("agg24_overview", " UNION ALL ".join([TOP("branch", "branch", 80), TOP("language", "language", 40), TOP("path", "file", 120), NAMES, TOP("source", "pr", 80)]), "chunks")
def _(chunks):
    return A.frequencies(chunks, branch=(F.col("branch"), 80), language=(F.col("language"), 40), file=(F.col("path"), 120), name=(F.array("primary_name", "parent_class", "namespace", "branch", "language", "source"), 120), pr=(F.col("source"), 80))


@query("agg25_index_stats", "SELECT branch, CAST(count(*) AS BIGINT) AS points, CAST(count(DISTINCT path) AS BIGINT) AS files FROM chunks GROUP BY branch", "chunks")
def _(chunks):
    return chunks.groupBy("branch").agg(F.count("*").alias("points"), F.count_distinct("path").alias("files"))


@query("agg26_distinct_branches", "SELECT DISTINCT branch FROM chunks", "chunks")
def _(chunks):
    return chunks.select("branch").distinct()


@query("agg27_retrieval_metrics", "SELECT content_type, round(avg(score), 6) AS mean, min(score) AS low, max(score) AS high, CAST(count(*) AS BIGINT) AS n FROM chunks GROUP BY content_type", "chunks")
def _(chunks):
    return chunks.groupBy("content_type").agg(F.round(F.avg("score"), 6).alias("mean"), F.min("score").alias("low"), F.max("score").alias("high"), F.count("*").alias("n"))


@query("agg28_dominant_family", "WITH c AS (SELECT CASE language WHEN 'en' THEN 'germanic' WHEN 'de' THEN 'germanic' WHEN 'fr' THEN 'romance' END AS family, count(*) AS n FROM chunks GROUP BY 1) SELECT family, CAST(sum(n) AS BIGINT) AS n FROM c WHERE family IS NOT NULL GROUP BY family HAVING sum(n) >= 0.7 * (SELECT sum(n) FROM c WHERE family IS NOT NULL)", "chunks")
def _(chunks):
    return A.dominant(chunks, F.when(F.col("language").isin("en", "de"), "germanic").when(F.col("language") == "fr", "romance"))


@query("agg29_relationship_summary", "SELECT kind, CAST(count(*) AS BIGINT) AS edges, CAST(count(DISTINCT src) AS BIGINT) AS files, round(2.0 * count(*) / (SELECT count(*) FROM (SELECT src FROM edges UNION SELECT dst FROM edges)), 6) AS mean_degree FROM edges GROUP BY kind", "edges")
def _(edges):
    nodes = edges.select("src").union(edges.select("dst")).distinct().agg(F.count("*").alias("v"))
    return edges.groupBy("kind").agg(F.count("*").alias("edges"), F.count_distinct("src").alias("files")).join(F.broadcast(nodes), F.lit(True)).select("kind", "edges", "files", F.round(2.0 * F.col("edges") / F.col("v"), 6).alias("mean_degree"))


@query("agg30_state_counts", "SELECT k.state, CAST(count(a.id) AS BIGINT) AS n FROM (SELECT unnest(['DONE','RUNNING','FAILED','QUEUED','CANCELLED']) AS state) k LEFT JOIN audit a ON a.status = k.state GROUP BY 1", "audit")
def _(audit):
    states = audit.sparkSession.createDataFrame([(s,) for s in ("DONE", "RUNNING", "FAILED", "QUEUED", "CANCELLED")], "state string")
    return states.join(audit.groupBy(F.col("status").alias("state")).agg(F.count("*").alias("k")), "state", "left").select("state", F.coalesce("k", F.lit(0)).alias("n"))


@query("agg31_size_class", """WITH t AS (SELECT pr, project_id, count(DISTINCT path) AS files, sum(coalesce(line, 0)) AS lines, sum(strlen(reason)) * 200 AS bytes FROM issues WHERE id % 4 < 3 GROUP BY pr, project_id)
SELECT pr, project_id, CASE WHEN files <= 4 AND lines <= 800 AND bytes <= 120000 THEN 'small' WHEN files <= 15 AND lines <= 3000 AND bytes <= 450000 THEN 'medium' ELSE 'large' END AS size, files <= 4 AND lines <= 800 AND bytes <= 120000 AS fast,
  CASE WHEN files > 4 THEN 'file count ' || files || ' > 4' WHEN lines > 800 THEN 'changed lines ' || lines || ' > 800' WHEN bytes > 120000 THEN 'diff bytes ' || bytes || ' > 120000' ELSE 'within small PR thresholds' END AS reason FROM t""", "issues")
def _(issues):
    t = issues.where("id % 4 < 3").groupBy("pr", "project_id").agg(F.count_distinct("path").alias("files"), F.sum(F.coalesce("line", F.lit(0))).alias("lines"), (F.sum(F.octet_length("reason")) * 200).alias("bytes"))
    sizes = [F.col(c) for c in ("files", "lines", "bytes")]
    return t.select("pr", "project_id", A.size_class(*sizes).alias("size"), A.fast_check(*sizes).alias("f")).select("pr", "project_id", "size", "f.*")


@query("agg32_diff_totals", "SELECT pr, CAST(a AS BIGINT) AS added, CAST(d AS BIGINT) AS deleted, (a > 20 AND d > 20 AND least(a, d) / greatest(a, d) > 0.7) AS refactor FROM (SELECT pr, sum(high + medium) AS a, sum(low + resolved) AS d FROM analyses GROUP BY pr)", "analyses")
def _(analyses):
    t = analyses.groupBy("pr").agg(F.sum(F.col("high") + F.col("medium")).alias("added"), F.sum(F.col("low") + F.col("resolved")).alias("deleted"))
    a, d = F.col("added"), F.col("deleted")
    return t.withColumn("refactor", (a > 20) & (d > 20) & F.coalesce(F.try_divide(F.least(a, d), F.greatest(a, d)) > 0.7, F.lit(False)))


@query("agg33_sampling_estimator", "WITH r AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS i, count(*) OVER () AS n FROM chunks), p AS (SELECT DISTINCT CAST(floor(k * n / 100) AS BIGINT) AS i FROM (SELECT unnest(range(0, 100)) AS k), (SELECT count(*) AS n FROM chunks)) SELECT CAST(count(*) AS BIGINT) AS sampled, CAST(round(avg(length(text)) * max(n)) AS BIGINT) AS estimate FROM r JOIN p USING (i)", "chunks")
def _(chunks):
    n = chunks.count()
    return A.evenly_spaced(chunks.select("id", "text"), "id").agg(F.count("*").alias("sampled"), F.round(F.avg(F.length("text")) * n).cast("long").alias("estimate"))


@query("agg34_coverage_rollup", "SELECT target, covered, missed, percent, percent + 1e-12 < CASE WHEN target IS NULL THEN 79.0 WHEN target = 'src1' THEN 85.0 ELSE 75.0 END AS below FROM (SELECT source AS target, CAST(sum(c) AS BIGINT) AS covered, CAST(sum(m) AS BIGINT) AS missed, round(100.0 * sum(c) / (sum(c) + sum(m)), 6) AS percent FROM (SELECT source, doc_id % 17 AS c, doc_id % 5 AS m FROM documents) GROUP BY ROLLUP (source))", "t:documents")
def _(documents):
    c, m = F.sum(F.col("doc_id") % 17), F.sum(F.col("doc_id") % 5)
    rolled = documents.rollup(F.col("source").alias("target")).agg(c.alias("covered"), m.alias("missed"), F.round(100.0 * c / (c + m), 6).alias("percent"))
    least = F.when(F.col("target").isNull(), 79.0).when(F.col("target") == "src1", 85.0).otherwise(75.0)
    return rolled.withColumn("below", A.below(F.col("percent"), least))


@query("agg35_commit_coverage", "SELECT project_id, CASE WHEN u = 0 THEN 'FULL' WHEN u = n THEN 'NOT_ANALYZED' ELSE 'PARTIAL' END AS coverage FROM (SELECT project_id, count(*) AS n, count(*) FILTER (WHERE id NOT IN (SELECT id FROM issues)) AS u FROM audit GROUP BY project_id)", "audit", "issues")
def _(audit, issues):
    known = audit.join(issues.select("id", F.lit(True).alias("known")), "id", "left").groupBy("project_id").agg(F.count("*").alias("n"), A.count_where(F.col("known").isNull()).alias("u"))
    return known.select("project_id", F.when(F.col("u") == 0, "FULL").when(F.col("u") == F.col("n"), "NOT_ANALYZED").otherwise("PARTIAL").alias("coverage"))


@query("agg36_merkle", "WITH r AS (SELECT branch, CAST(length(CAST(id AS STRING)) AS STRING) || ':' || CAST(id AS STRING) || '=' || sha256(text) AS f FROM chunks), t1 AS (SELECT branch, substr(a, 1, 4) AS a, sha256(string_agg(f, ';' ORDER BY f)) AS f, count(*) AS n FROM (SELECT *, sha256(f) AS a FROM r) GROUP BY branch, substr(a, 1, 4)), t2 AS (SELECT branch, substr(a, 1, 2) AS a, sha256(string_agg(f, ';' ORDER BY f)) AS f, sum(n) AS n FROM t1 GROUP BY branch, substr(a, 1, 2)) SELECT branch, sha256(string_agg(f, ';' ORDER BY f)) AS seal, CAST(sum(n) AS BIGINT) AS members FROM t2 GROUP BY branch", "chunks")
def _(chunks):
    return A.merkle(chunks.withColumn("digest", F.sha2("text", 256)), "id", "digest", "branch")


@query("agg37_rejections", "SELECT severity AS gate, coalesce(category, 'none') AS code, CAST(count(*) AS BIGINT) AS n FROM issues WHERE resolved GROUP BY 1, 2", "issues")
def _(issues):
    return issues.where("resolved").groupBy(F.col("severity").alias("gate"), F.coalesce("category", F.lit("none")).alias("code")).agg(F.count("*").alias("n"))


@query("win01_latest_with_ties", "SELECT id FROM analyses a WHERE pr_version = (SELECT max(pr_version) FROM analyses b WHERE b.project_id = a.project_id AND b.pr = a.pr)", "analyses")
def _(analyses):
    w = Window.partitionBy("project_id", "pr").orderBy(F.desc("pr_version"))
    return analyses.withColumn("r", F.rank().over(w)).where("r = 1").select("id")


@query("win02_latest_by_id", "SELECT project_id, max(id) AS id FROM analyses GROUP BY project_id", "analyses")
def _(analyses):
    return analyses.groupBy("project_id").agg(F.max("id").alias("id"))


@query("win03_newest_per_file", "SELECT DISTINCT ON (path) path, id FROM issues ORDER BY path, created_at DESC, id DESC", "issues")
def _(issues):
    return issues.groupBy("path").agg(F.max_by("id", F.struct("created_at", "id")).alias("id"))


@query("win04_cap_per_file", "SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY path ORDER BY score DESC, id) AS r FROM chunks) WHERE r <= 4", "chunks")
def _(chunks):
    return chunks.withColumn("r", F.row_number().over(Window.partitionBy("path").orderBy(F.desc("score"), "id"))).where("r <= 4").select("id")


@query("win05_limit_per_path", "SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY path ORDER BY start_line, id) AS r FROM chunks) WHERE r <= 2", "chunks")
def _(chunks):
    return chunks.withColumn("r", F.row_number().over(Window.partitionBy("path").orderBy("start_line", "id"))).where("r <= 2").select("id")


@query("win06_first_occurrence", "SELECT min(id) AS id FROM chunks GROUP BY text", "chunks")
def _(chunks):
    return chunks.groupBy(F.sha2("text", 256).alias("h")).agg(F.min("id").alias("id")).select("id")


@query("win09_sequence_edges", "SELECT id AS src, n AS dst FROM (SELECT id, lead(id) OVER (PARTITION BY path ORDER BY start_line, id) AS n FROM chunks) WHERE n IS NOT NULL", "chunks")
def _(chunks):
    n = F.lead("id").over(Window.partitionBy("path").orderBy("start_line", "id"))
    return chunks.select(F.col("id").alias("src"), n.alias("dst")).where("dst is not null")


@query("win10_half_split", "SELECT project_id, CAST(sum(total) FILTER (WHERE i <= floor(n / 2)) AS BIGINT) AS first_half, CAST(sum(total) FILTER (WHERE i > floor(n / 2)) AS BIGINT) AS second_half FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY created_at, id) AS i, count(*) OVER (PARTITION BY project_id) AS n FROM analyses) GROUP BY 1", "analyses")
def _(analyses):
    w = Window.partitionBy("project_id")
    rows = analyses.withColumn("i", F.row_number().over(w.orderBy("created_at", "id"))).withColumn("n", F.count("*").over(w))
    first = F.col("i") <= F.floor(F.col("n") / 2)
    return rows.groupBy("project_id").agg(F.sum(F.when(first, F.col("total"))).alias("first_half"), F.sum(F.when(~first, F.col("total"))).alias("second_half"))


@query("win11_tail", "SELECT id, created_at FROM (SELECT * FROM analyses ORDER BY created_at DESC, id DESC LIMIT 30) ORDER BY created_at, id", "analyses")
def _(analyses):
    return analyses.orderBy(F.desc("created_at"), F.desc("id")).limit(30).orderBy("created_at", "id").select("id", "created_at")


@query("win12_preference", "SELECT DISTINCT ON (path) path, id FROM issues ORDER BY path, resolved DESC, (line IS NOT NULL) DESC, id", "issues")
def _(issues):
    return issues.groupBy("path").agg(F.min_by("id", F.struct(~F.col("resolved"), F.col("line").isNull(), F.col("id"))).alias("id"))


@query("win13_versioned_merge", "SELECT path, arg_max(title, pr_version * 1000000 + id) AS title, bool_or(resolved) AS closed FROM issues GROUP BY path", "issues")
def _(issues):
    return issues.groupBy("path").agg(F.max_by("title", F.struct("pr_version", "id")).alias("title"), F.bool_or("resolved").alias("closed"))
