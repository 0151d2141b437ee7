"""The test tables seen as the entities that the operators work on.

The statements run unchanged in Spark and in DuckDB.  They stand in for the shape of the
entities, not for their content.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

STANDINS = {
    # findings of a review: one for each order
    "issues": """
        SELECT o_orderkey AS id, o_custkey % 50 AS project_id, o_orderkey % 40 AS pr, 1 + o_custkey % 4 AS pr_version,
               'pkg' || CAST(o_orderkey % 13 AS STRING) || '/file' || CAST(o_orderkey % 97 AS STRING) || '.java' AS path,
               CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_custkey % 400 END AS line,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'HIGH' WHEN '2-HIGH' THEN 'HIGH' WHEN '3-MEDIUM' THEN 'MEDIUM' WHEN '4-NOT SPECIFIED' THEN 'LOW' ELSE 'INFO' END AS severity,
               CASE o_orderkey % 6 WHEN 0 THEN 'security' WHEN 1 THEN 'performance' WHEN 2 THEN 'code_quality' WHEN 3 THEN 'bug_risk' WHEN 4 THEN 'style' ELSE NULL END AS category,
               o_orderstatus = 'F' AS resolved, o_orderdate AS created_at,
               CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 30 DAYS END AS resolved_at,
               'dev' || CAST(o_custkey % 25 AS STRING) AS author,
               'Problem ' || CAST(o_custkey % 9 AS STRING) || ' at line ' || CAST(o_custkey % 400 AS STRING) AS title,
               'The value read here may be null when the record number ' || CAST(o_custkey % 30 AS STRING) || ' is missing' AS reason
        FROM orders""",
    # review runs with their counters: the line items of an order
    "analyses": """
        SELECT l_orderkey AS id, l_orderkey % 20 AS project_id, l_orderkey % 150 AS pr, l_orderkey % 6 AS pr_version, CAST(count(*) AS BIGINT) AS total,
               CAST(count(CASE WHEN l_returnflag = 'R' THEN 1 END) AS BIGINT) AS high, CAST(count(CASE WHEN l_returnflag = 'A' THEN 1 END) AS BIGINT) AS medium,
               CAST(count(CASE WHEN l_returnflag = 'N' THEN 1 END) AS BIGINT) AS low, CAST(count(CASE WHEN l_linestatus = 'F' THEN 1 END) AS BIGINT) AS resolved,
               min(l_shipdate) AS created_at
        FROM lineitem GROUP BY l_orderkey""",
    # indexed chunks: one for each document
    "chunks": """
        SELECT doc_id AS id, CASE doc_id % 3 WHEN 0 THEN 'main' WHEN 1 THEN 'develop' ELSE 'feature/search' END AS branch,
               'src/' || source || '/' || lang || '/part' || CAST(doc_id % 200 AS STRING) || CASE doc_id % 4 WHEN 0 THEN '.py' WHEN 1 THEN '.java' WHEN 2 THEN '.ts' ELSE '.md' END AS path,
               CASE doc_id % 5 WHEN 0 THEN 'functions_classes' WHEN 1 THEN 'simplified_code' WHEN 2 THEN 'fallback' WHEN 3 THEN 'oversized_split' ELSE 'other' END AS content_type,
               lang AS language, source, text, CAST(doc_id % 11 AS DOUBLE) / 10 - 0.1 AS density, CAST((doc_id * 37) % 1000 AS DOUBLE) / 1000 AS score,
               'name' || CAST(doc_id % 120 AS STRING) AS primary_name, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE 'Class' || CAST(doc_id % 30 AS STRING) END AS parent_class,
               'ns' || CAST(doc_id % 12 AS STRING) AS namespace, doc_id % 10 AS start_line, doc_id % 10 + 20 AS end_line
        FROM documents""",
    # webhook audit records
    "audit": """
        SELECT event_id AS id, ts AS received_at, CASE user_id % 3 WHEN 0 THEN 'git_a' WHEN 1 THEN 'git_b' ELSE 'git_c' END AS provider, user_id % 20 AS project_id,
               event_type, CASE event_id % 4 WHEN 0 THEN 'FAILED' WHEN 1 THEN 'RUNNING' ELSE 'DONE' END AS status, value AS ms
        FROM events""",
    # files and the files that they refer to
    "edges": """
        SELECT p_partkey AS src, (p_partkey * 7 + 3) % 2000 AS dst, CASE p_size % 3 WHEN 0 THEN 'imports' WHEN 1 THEN 'calls' ELSE 'extends' END AS kind,
               CASE p_size % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.8 ELSE 1.5 END AS weight
        FROM part""",
}


def standin(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    statement = STANDINS[name]
    table = statement.split("FROM ")[-1].split()[0]
    return spark.sql(statement.replace(f"FROM {table}", "FROM {source_table}"), source_table=spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def with_standins(sql: str, *names: str) -> str:
    """The statement with the stand-ins that it names as common table expressions."""
    head = ",\n".join(f"{n} AS ({STANDINS[n]})" for n in names)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {head},\n{body[14:]}"
    return f"WITH {head},\n{body[4:]}" if body.upper().startswith("WITH ") else f"WITH {head}\n{body}"
