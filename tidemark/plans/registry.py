"""All queries by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .standins import standin, with_standins

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None, *uses: str):
    """Registers f, which takes the stand-ins (or tables, as ``t:orders``) that it uses, as a query."""

    def take(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(*(spark.read.parquet(f"{sf_dir}/{u[2:]}.parquet") if u.startswith("t:") else standin(spark, sf_dir, u) for u in uses))

        if name in QUERIES:
            raise ValueError(f"two queries are named {name}")
        QUERIES[name] = run
        if sql:
            names = [u for u in uses if not u.startswith("t:")]
            SQL[name] = with_standins(sql, *names) if names else sql
        return f

    return take


def _load() -> None:
    from . import q_aggregates, q_chunkers, q_contracts, q_dedup, q_filters, q_inspector, q_joins, q_ranking, q_rules, q_sessions, q_streams, q_text, q_tracking  # noqa: F401


def queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(SQL)


def FLAGSHIP(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["plan_pr_context"](spark, sf_dir)
