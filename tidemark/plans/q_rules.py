"""Queries of rules, plug-in selection and the audit table."""

from pyspark.sql import functions as F

from ..operators import rules as R
from ..sources import sinks
from .registry import query

RULES = [R.Rule("no-generated", False, ("pkg1/**",)), R.Rule("null-checks", True, ("**/*.java",)), R.Rule("off", True, (), False), R.Rule("legacy", False, ("pkg2/file?.java", "pkg3/"))]


@query("udf04_custom_rules", r"SELECT id, CASE WHEN path LIKE '%.java' THEN ['null-checks'] ELSE [] END AS enforced, list_filter([CASE WHEN path LIKE 'pkg1/%' THEN 'no-generated' END, CASE WHEN regexp_full_match(path, 'pkg2/file[^/]\.java') OR path LIKE 'pkg3/%' THEN 'legacy' END], lambda x: x IS NOT NULL) AS suppressed FROM issues", "issues")
def _(issues):
    return issues.select("id", R.rules_for(RULES, F.col("path")).alias("r")).select("id", "r.enforced", "r.suppressed")


PLUGINS = [R.Plugin("python", ((("**/*.py", ""),),)), R.Plugin("none", ((("**/*.py", ""), ("**/*.nope", "")),)), R.Plugin("web", ((("**/*.nope", ""),), (("**/*.ts", ""), ("**/*.md", "the"))))]


@query("udf06_plugin_selection", "WITH py AS (SELECT DISTINCT path FROM chunks WHERE path LIKE '%.py'), web AS (SELECT DISTINCT path, c FROM (SELECT path, 0 AS c FROM chunks WHERE path LIKE '%.ts' UNION ALL SELECT path, 1 AS c FROM chunks WHERE path LIKE '%.md' AND contains(text, 'the'))), w AS (SELECT path, row_number() OVER (PARTITION BY c ORDER BY path) AS r FROM web) SELECT 'python' AS plugin, 0 AS alternative, list_sort(list(path))[1:5] AS paths FROM py HAVING count(*) > 0 UNION ALL SELECT 'web', 1, list_sort(list(DISTINCT path))[1:5] FROM w WHERE r <= 5 AND (SELECT count(DISTINCT c) FROM web) = 2", "chunks")
def _(chunks):
    return R.select_plugins(chunks.select("path", "text"), PLUGINS)


@query("udf03_audit_functions", "SELECT status, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE WHEN id % 10 = 3 THEN 'DONE' WHEN id % 2 = 1 THEN 'RECEIVED' ELSE status END AS status FROM audit WHERE received_at >= TIMESTAMP '2024-01-11') GROUP BY status", "audit")
def _(audit):
    there = R.log_event(audit.where("id % 2 = 0"), audit.drop("status"))
    done = R.update_status(there, audit.where("id % 10 = 3").select("id", F.lit("DONE").alias("status")))
    return R.cleanup(done, "received_at", 20, F.lit("2024-01-31").cast("timestamp")).groupBy("status").agg(F.count("*").alias("n"))


@query("snk02_pack_batches", None, "chunks")
def _(chunks):
    return sinks.pack_batches(chunks.select("id", "path", F.octet_length("text").alias("bytes")), "path", "id", "bytes", 65536)


@query("udf01_transforms", "SELECT id, upper(title) AS title FROM issues WHERE NOT resolved", "issues")
def _(issues):
    """Of four transforms one abstains and one fails; the rows go through the other two."""
    plugins = {"open": lambda df: df.where("not resolved"), "upper": lambda df: df.withColumn("title", F.upper("title")), "silent": lambda df: None, "broken": lambda df: df.select("nothing")}
    df, outcomes = R.run_transforms(issues, list(plugins), plugins)
    if [outcomes[n].split(":")[0] for n in plugins] != ["handled", "handled", "abstained", "failed"]:
        raise ValueError(f"unexpected outcomes: {outcomes}")
    return df.select("id", "title")
