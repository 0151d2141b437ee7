"""Queries of tracking and state."""

from pyspark.sql import functions as F

from ..operators import tracking as K
from .registry import query


def sides(issues):
    h = F.when(F.col("id") % 11 > 0, F.md5("title"))
    cols = [F.col("path").alias("file"), F.col("id").alias("seq"), F.col("reason").alias("fingerprint"), F.col("line"), h.alias("line_hash"), "resolved"]
    return issues.where("id % 2 = 0").select(*cols), issues.where("id % 2 = 1").select(*cols)


@query("jn05_cascading_match", None, "issues")
def _(issues):
    return K.match(*sides(issues))


EXACT = "WITH s AS (SELECT path AS file, id AS seq, reason AS fp, line, CASE WHEN id % 11 > 0 THEN md5(title) END AS h FROM issues WHERE line IS NOT NULL AND id % 11 > 0), r AS (SELECT file, fp, line, h, count(*) AS n, min(seq) AS seq FROM s WHERE seq % 2 = 0 GROUP BY 1, 2, 3, 4), b AS (SELECT file, fp, line, h, count(*) AS n, min(seq) AS seq FROM s WHERE seq % 2 = 1 GROUP BY 1, 2, 3, 4) SELECT r.seq AS raw_seq, b.seq AS base_seq FROM r JOIN b USING (file, fp, line, h) WHERE r.n = 1 AND b.n = 1"


@query("jn05_unique_exact", EXACT, "issues")
def _(issues):
    raws, bases = sides(issues)
    key = ["file", "fingerprint", "line", "line_hash"]
    n = lambda df: df.where("line_hash is not null and line is not null").groupBy(*key).agg(F.count("*").alias("n"))
    unique = n(raws).where("n = 1").drop("n").join(n(bases).where("n = 1").drop("n"), key)
    hit = K.match(raws, bases).where("how = 'EXACT'").join(raws.select(F.col("seq").alias("raw_seq"), *key[1:]), "raw_seq")
    return hit.join(unique, key).select("raw_seq", "base_seq")


@query("str12_iteration", None, "issues")
def _(issues):
    raws, bases = sides(issues)
    lines = raws.where("line_hash is not null").select("file", "line_hash")
    return K.track(bases, raws, lines, raws.select("file").distinct())


@query("str13_classify", "SELECT id, CASE WHEN why = 'anchor_present' THEN 'CONFIRMED' ELSE 'NEEDS_AI' END AS state, why FROM (SELECT id, CASE WHEN id % 7 = 0 THEN 'file_scope' WHEN id % 5 = 0 THEN 'no_anchor' WHEN line IS NULL THEN 'anchor_missing' WHEN id % 3 = 0 AND id % 4 > 1 THEN 'partial_block' WHEN line % 10 <> id % 10 THEN 'context_changed' ELSE 'anchor_present' END AS why FROM issues)", "issues")
def _(issues):
    rows = issues.select("id", F.when(F.col("id") % 7 == 0, "FILE").when(F.col("id") % 3 == 0, "BLOCK").otherwise("LINE").alias("scope"), F.when(F.col("id") % 5 != 0, "h").alias("line_hash"), (F.col("id") % 4).alias("places"), F.col("line").alias("found_line"), (F.col("id") % 10).alias("context"), (F.col("line") % 10).alias("found_context"))
    return K.classify(rows).select("id", "state", "why")


@query("str14_sweep", "SELECT id, false AS resolved, CASE WHEN id % 9 = 0 THEN 'empty_file' WHEN id % 7 = 0 THEN 'file_scope' WHEN id % 5 = 0 THEN 'no_anchor' WHEN line IS NOT NULL THEN 'anchor_present' ELSE 'anchor_gone' END AS why FROM issues", "issues")
def _(issues):
    rows = issues.select("id", (F.col("id") % 9).alias("n_lines"), F.when(F.col("id") % 7 == 0, "FILE").otherwise("LINE").alias("scope"), F.when(F.col("id") % 5 != 0, "h").alias("line_hash"), F.col("line").isNotNull().alias("anchor_there"))
    return K.sweep(rows)


@query("str15_remap", "SELECT id, CAST(CASE WHEN line < s + 2 THEN line ELSE line + 1 END AS BIGINT) AS new_line FROM (SELECT id, line, 90 + 5 * (CAST(regexp_extract(path, 'file([0-9]+)', 1) AS BIGINT) % 60) AS s FROM issues WHERE line IS NOT NULL)", "issues")
def _(issues):
    # each path has a hunk of its own: a line kept, one replaced by two, one kept
    start = (90 + 5 * (F.regexp_extract("path", "file([0-9]+)", 1).cast("int") % 60)).alias("start")
    hunks = issues.select("path", start).distinct().select("path", F.col("start").alias("old_start"), F.lit(3).alias("old_count"), F.col("start").alias("new_start"), F.array(*map(F.lit, (" a", "-b", "+c", "+d", " e"))).alias("lines"))
    return K.remap(issues.where("line is not null").select("id", "path", "line"), hunks)


@query("str16_map_upsert", "WITH b AS (SELECT id AS origin, title AS identity FROM issues WHERE id % 10 = 0), f AS (SELECT id AS origin, CASE WHEN id % 13 > 0 THEN title || author END AS identity, id AS seq FROM issues WHERE id % 10 < 3) SELECT origin FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(identity, '#' || seq) ORDER BY seq) AS r FROM f WHERE origin NOT IN (SELECT origin FROM b) AND (identity IS NULL OR identity NOT IN (SELECT identity FROM b))) WHERE r = 1", "issues")
def _(issues):
    branch = issues.where("id % 10 = 0").select(F.col("id").alias("origin"), F.col("title").alias("identity"))
    found = issues.where("id % 10 < 3").select(F.col("id").alias("origin"), F.when(F.col("id") % 13 > 0, F.concat("title", "author")).alias("identity"), F.col("id").alias("seq"))
    return K.map_upsert(branch, found).select("origin")


STATE = "CASE CAST(floor(value) AS BIGINT) % 6 WHEN 0 THEN 'INGESTED' WHEN 1 THEN 'PLANNED' WHEN 2 THEN 'REVIEWED' WHEN 3 THEN 'VALIDATED' WHEN 4 THEN 'COMPLETED' ELSE 'EXCLUDED' END"


@query("str11_coverage_states", f"WITH e AS (SELECT user_id AS hunk, event_id AS seq, {STATE} AS state, CASE WHEN CAST(floor(value) AS BIGINT) % 6 = 5 THEN 99 ELSE CAST(floor(value) AS BIGINT) % 6 END AS r FROM events), p AS (SELECT *, lag(r) OVER (PARTITION BY hunk ORDER BY seq) AS p FROM e) SELECT hunk, arg_max(state, seq) AS state, CAST(count(*) FILTER (WHERE NOT CASE WHEN p IS NULL THEN r = 0 WHEN r = 99 THEN p < 4 ELSE r = p + 1 END) AS BIGINT) AS illegal FROM p GROUP BY hunk", "t:events")
def _(events):
    return K.coverage_states(events.select(F.col("user_id").alias("hunk"), F.col("event_id").alias("seq"), F.expr(STATE).alias("state")))


@query("str19_terminal_states", "SELECT user_id AS candidate, arg_max(s, event_id) AS state, CASE WHEN count(DISTINCT s) FILTER (WHERE s <> 'open') > 1 THEN 'both_states' WHEN count(DISTINCT w) FILTER (WHERE s <> 'open') > 1 THEN 'conflicting_reasons' WHEN count(DISTINCT s) FILTER (WHERE s <> 'open') = 0 THEN 'not_terminal' END AS fault FROM (SELECT *, CASE event_type WHEN 'purchase' THEN 'published' WHEN 'error' THEN 'rejected' ELSE 'open' END AS s, user_id % 3 AS w FROM events) GROUP BY user_id", "t:events")
def _(events):
    s = F.when(F.col("event_type") == "purchase", "published").when(F.col("event_type") == "error", "rejected").otherwise("open")
    return K.terminal_states(events.select(F.col("user_id").alias("candidate"), F.col("event_id").alias("seq"), s.alias("state"), (F.col("user_id") % 3).alias("reason")))


@query("str08_expired_leases", "SELECT id FROM (SELECT id, received_at + INTERVAL 2 DAYS AS e FROM audit WHERE status = 'RUNNING') WHERE e < TIMESTAMP '2024-01-20' AND id NOT IN (SELECT id FROM audit WHERE event_type = 'click')", "audit")
def _(audit):
    leases = audit.where("status = 'RUNNING'").select("id", (F.col("received_at") + F.expr("INTERVAL 2 DAYS")).alias("expires_at"))
    return K.expired(leases, F.lit("2024-01-20").cast("timestamp"), audit.where("event_type = 'click'")).select("id")


@query("str09_stuck_jobs", "SELECT id FROM audit WHERE status = 'RUNNING' AND received_at < (SELECT max(received_at) FROM audit) - INTERVAL 5 DAYS", "audit")
def _(audit):
    last = F.broadcast(audit.agg(F.max("received_at").alias("last")))
    return audit.where("status = 'RUNNING'").join(last, F.col("received_at") < F.col("last") - F.expr("INTERVAL 5 DAYS")).select("id")


@query("str10_retention", "SELECT CAST(count(*) AS BIGINT) AS kept FROM audit WHERE received_at >= (SELECT max(received_at) FROM audit) - INTERVAL 10 DAYS", "audit")
def _(audit):
    last = F.broadcast(audit.agg(F.max("received_at").alias("last")))
    return audit.join(last, F.col("received_at") >= F.col("last") - F.expr("INTERVAL 10 DAYS")).agg(F.count("*").alias("kept"))


@query("str17_counter_refresh", "SELECT p.project_id, CAST(coalesce(n, 0) AS BIGINT) AS open FROM (SELECT unnest(range(0, 60)) AS project_id) p LEFT JOIN (SELECT project_id, count(*) AS n FROM issues WHERE NOT resolved GROUP BY 1) USING (project_id)", "issues")
def _(issues):
    n = issues.where("not resolved").groupBy("project_id").agg(F.count("*").alias("n"))
    return issues.sparkSession.range(60).withColumnRenamed("id", "project_id").join(n, "project_id", "left").select("project_id", F.coalesce("n", F.lit(0)).alias("open"))
