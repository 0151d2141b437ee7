"""Queries of incremental operators; the streams themselves are in the tests."""

from pyspark.sql import functions as F

from ..streaming import streams as S
from .registry import query


@query("str02_newest_wins", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1", "t:events")
def _(events):
    old, new = events.where("event_id % 2 = 0"), events.where("event_id % 2 = 1")
    return S.merge_newest(S.newest(old, "user_id", "ts", "event_id"), new, "user_id", "ts", "event_id").select("user_id", "event_id", "event_type")


@query("str03_incremental_changes", "SELECT id, path FROM chunks WHERE branch = 'main' AND path NOT IN (SELECT path FROM chunks WHERE id % 7 = 0) UNION ALL SELECT id, path FROM chunks WHERE branch = 'develop' AND path IN (SELECT path FROM chunks WHERE id % 7 = 0) AND CAST(regexp_extract(path, 'part([0-9]+)', 1) AS INTEGER) % 2 = 0", "chunks")
def _(chunks):
    c = chunks.select("id", "path", "branch")
    kind = F.when(F.regexp_extract("path", "part([0-9]+)", 1).cast("int") % 2 == 0, "update").otherwise("delete")
    changes = c.where("id % 7 = 0").select("path", kind.alias("change")).distinct()
    return S.apply_changes(c.where("branch = 'main'").select("id", "path"), changes, c.where("branch = 'develop'").select("id", "path"))


@query("str04_vector_reuse", "SELECT vec_id AS id, vec_id % 3 = 0 AND label % 2 = 0 AS reused FROM embeddings", "t:embeddings")
def _(embeddings):
    cache = embeddings.where("vec_id % 3 = 0").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.lit("a").alias("scope"), F.lit(0).alias("input"))
    new = embeddings.select(F.col("vec_id").alias("id"), F.lit("a").alias("scope"), (F.col("label") % 2).alias("input"))
    return S.reuse_vectors(new, cache, ["scope", "input"]).select("id", "reused")


@query("str05_copy_branches", "SELECT vec_id AS id FROM embeddings WHERE label % 3 <> 0 AND vec_id % 4 <> 0", "t:embeddings")
def _(embeddings):
    points = embeddings.select(F.col("vec_id").alias("id"), F.when(F.col("label") % 3 == 0, "main").otherwise("dev").alias("branch"), F.when(F.col("vec_id") % 4 == 0, F.slice("embedding", 1, 8)).otherwise(F.col("embedding")).alias("vector"))
    return S.copy_branches(points, "main", 64).select("id")


@query("str06_rate_windows", "SELECT user_id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1, 2", "t:events")
def _(events):
    return S.fixed_windows(events, "user_id").withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@query("str06_over_limit", "SELECT user_id, CAST(count(*) AS BIGINT) AS windows FROM (SELECT user_id, date_trunc('day', ts) AS d, count(*) AS n FROM events GROUP BY 1, 2) WHERE n > 3 GROUP BY 1", "t:events")
def _(events):
    return S.over_limit(S.fixed_windows(events, "user_id", size="1 day"), 3).groupBy("user_id").agg(F.count("*").alias("windows"))


@query("extra_sessions", "WITH m AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) <= 7200000000 THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM m) SELECT user_id, CAST(count(DISTINCT s) AS BIGINT) AS sessions FROM s GROUP BY 1", "t:events")
def _(events):
    return S.sessions(events, "user_id", "ts", 7200).groupBy("user_id").agg(F.count("*").alias("sessions"))


@query("str18_seal", "WITH r AS (SELECT CAST(length(CAST(id AS STRING)) AS STRING) || ':' || CAST(id AS STRING) || '=' || sha256('{\"id\":' || id || ',\"branch\":\"' || branch || '\",\"score\":\"' || CAST(score AS DECIMAL(6, 3)) || '\"}') AS f FROM chunks), t1 AS (SELECT substr(a, 1, 4) AS a, sha256(string_agg(f, ';' ORDER BY f)) AS f, count(*) AS n FROM (SELECT *, sha256(f) AS a FROM r) GROUP BY substr(a, 1, 4)), t2 AS (SELECT substr(a, 1, 2) AS a, sha256(string_agg(f, ';' ORDER BY f)) AS f, sum(n) AS n FROM t1 GROUP BY substr(a, 1, 2)) SELECT sha256(string_agg(f, ';' ORDER BY f)) AS seal, CAST(sum(n) AS BIGINT) AS members FROM t2", "chunks")
def _(chunks):
    return S.seal(chunks.select("id", "branch", F.col("score").cast("decimal(6, 3)").cast("string").alias("score")))


@query("str01_admitted_stream", "SELECT event_type, CAST(count(*) AS BIGINT) AS n, CAST(max(event_id) AS BIGINT) AS last FROM events GROUP BY event_type", "t:events")
def _(events):
    """The events as a stream of files, two admitted to a batch; each batch writes its own folder, so one that comes twice counts once."""
    from ..shared import new_path

    spark = events.sparkSession
    queue, done = new_path(spark, "queue"), new_path(spark, "done")
    events.select("event_id", "event_type").repartition(6).write.parquet(queue)
    count = lambda df: df.groupBy("event_type").agg(F.count("*").alias("n"), F.max("event_id").alias("last"))
    S.run_batches(S.read(spark, queue, "event_id long, event_type string", per_trigger=2), lambda df, batch: count(df).write.mode("overwrite").parquet(f"{done}/batch={batch}"))
    parts = spark.read.parquet(done)
    return parts.groupBy("event_type").agg(F.sum("n").alias("n"), F.max("last").alias("last"))
