"""Scores, top-k search and context selection."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import bounded_batches

#: Fixed values.
TYPE_BOOST = {"functions_classes": 1.1, "simplified_code": 1.0, "fallback": 0.95, "oversized_split": 0.8}
GROUP_SCORE = {"changed_files": 0.95, "definitions": 0.92, "class_context": 0.86, "namespace_context": 0.84}
OVERSIZE = 16000
#: Query vectors that are broadcast at once; more are searched in blocks of so many.
QUERY_BLOCK = 1000
#: Points that a matrix product takes.
POINT_ROWS = 256


def lookup(table: dict, key: Column, default) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key], F.lit(default))


def boost(score: Column, content_type: Column, density: Column) -> Column:
    """Content-type boost, then density penalty, then the cap at 1 (before any later factor)."""
    thin = F.when(density < 0, 0.85).when(density < 0.1, 0.3 + 0.7 * density / 0.1).otherwise(1.0)
    return F.least(score * lookup(TYPE_BOOST, content_type, 1.0) * thin, F.lit(1.0))


def ecosystem_factor(family: Column, wanted: Column) -> Column:
    return F.when(family.isNotNull() & wanted.isNotNull() & (family != wanted), 0.2).otherwise(1.0)


def size_factor(length: Column, limit: int = OVERSIZE) -> Column:
    return F.when(length > limit, F.greatest(F.lit(0.5), 1 - (F.least(length / limit, F.lit(3.0)) - 1) * 0.5 / 2)).otherwise(1.0)


def _query_blocks(queries: DataFrame, block: int):
    """(ids, unit vectors as a matrix) of a stated set of queries (query, q_vector), so many at a time; zero vectors are left out."""
    ids, rows = [], []
    for r in queries.select(F.col("query").cast("long"), "q_vector").where("q_vector is not null").toLocalIterator():
        v = np.array(r[1], float)
        if (size := np.linalg.norm(v)) > 0:
            ids.append(r[0])
            rows.append(v / size)
        if len(ids) == block:
            yield np.array(ids, np.int64), np.array(rows)
            ids, rows = [], []
    if ids:
        yield np.array(ids, np.int64), np.array(rows)


def _searched(queries: DataFrame, points: DataFrame, block: int, found, schema: str) -> DataFrame:
    """found(query ids, an iterator of (point ids, similarities of points by queries)) over all points (point, vector), one block of queries after another.

    The products run on Arrow batches, a matrix for each; zero vectors and vectors of another
    size are like nothing.
    """
    spark, out = queries.sparkSession, None
    bounded_batches(spark)
    names = [x.split()[0] for x in schema.split(", ")]
    for ids, matrix in _query_blocks(queries, block):
        shared = spark.sparkContext.broadcast((ids, matrix))

        def run(batches, shared=shared):
            mine, vectors = shared.value

            def products():
                for whole in batches:
                    for i in range(0, len(whole), POINT_ROWS):
                        batch = whole.slice(i, POINT_ROWS)
                        v = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, vectors.shape[1])
                        size = np.linalg.norm(v, axis=1)
                        some = size > 0
                        yield batch.column(0).to_numpy()[some], np.round((v[some] @ vectors.T) / size[some, None], 6)

            for columns in found(mine, products()):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

        whole = points.where((F.size("vector") == matrix.shape[1]) & ~F.exists("vector", lambda x: x.isNull()))
        part = whole.select(F.col("point").cast("long"), "vector").mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out


def best_similarities(queries: DataFrame, points: DataFrame, block: int = QUERY_BLOCK) -> DataFrame:
    """(point, similarity) with the most similar of the queries (query, q_vector), exactly; one row a point."""

    def found(ids, products):
        for point, s in products:
            yield point, s.max(axis=1)

    each = _searched(queries, points, block, found, "point long, similarity double")
    return each.groupBy("point").agg(F.max("similarity").alias("similarity"))


def top_k(queries: DataFrame, points: DataFrame, k: int, block: int = QUERY_BLOCK) -> DataFrame:
    """(query, point, similarity, rank): the k nearest points of each query by cosine, exactly (recall 1); equal ones by point.

    A task gives out k rows a query at most.
    """

    def found(ids, products):
        points_, best = np.zeros((0, len(ids)), np.int64), np.zeros((0, len(ids)))
        for point, s in products:
            points_, best = np.concatenate((points_, np.repeat(point[:, None], len(ids), axis=1))), np.concatenate((best, s))
            order = np.lexsort((points_, -best), axis=0)[:k]
            points_, best = np.take_along_axis(points_, order, axis=0), np.take_along_axis(best, order, axis=0)
        yield np.repeat(ids, len(best)), points_.T.reshape(-1), best.T.reshape(-1)

    return _k_best(_searched(queries, points, block, found, "query long, point long, similarity double"), k)


def _k_best(scored: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query").orderBy(F.desc("similarity"), "point")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def first_rows(rows: DataFrame, key: list[Column], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def cap_per(rows: DataFrame, key: list[str], n: int, order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def threshold_or_best(rows: DataFrame, score: str, least: float, fallback: int, tie: str) -> DataFrame:
    """Rows that reach the score; if none does, the best few."""
    ok = rows.where(F.col(score) >= least)
    best = rows.orderBy(F.desc(score), tie).limit(fallback)
    none = ok.limit(1).agg((F.count("*") == 0).alias("_none"))
    return ok.unionByName(best.join(F.broadcast(none), F.col("_none")).drop("_none"))


def merge_and_rank(hits: DataFrame, wanted_family: str | None, least: float = 0.7, per_file: int = 4, fallback: int = 5) -> DataFrame:
    """hits (id, path, text, content_type, density, family, score): one row a file and text, adjusted, thresholded and capped by file."""
    one = first_rows(hits.withColumn("_h", F.sha2("text", 256)), [F.col("path"), F.col("_h")], [F.desc("score"), F.col("id")]).drop("_h")
    value = boost(F.col("score"), F.col("content_type"), F.col("density")) * ecosystem_factor(F.col("family"), F.lit(wanted_family).cast("string")) * size_factor(F.length("text"))
    scored = one.withColumn("score", F.round(value, 6))
    return cap_per(threshold_or_best(scored, "score", least, fallback, "id"), ["path"], per_file, [F.desc("score"), F.col("id")])


def rerank(rows: DataFrame, changed: DataFrame, score: str = "score") -> DataFrame:
    """x 1.5 for changed files (whole path, or either a suffix of the other), x 1.3 for files of their directories."""
    from .filters import base_name, path_matches

    directory = lambda c: F.regexp_extract(c, "^(.*)/", 1)
    c = changed.select(F.col("path").alias("_c")).distinct()
    by_name = c.withColumn("_name", base_name(F.col("_c")))
    hit = rows.select("path").distinct().withColumn("_name", base_name(F.col("path"))).join(by_name, "_name").where(path_matches(F.col("path"), F.col("_c"))).select("path", F.lit(True).alias("_hit")).distinct()
    near = c.select(directory(F.col("_c")).alias("_dir"), F.lit(True).alias("_near")).distinct()
    out = rows.join(hit, "path", "left").withColumn("_dir", directory(F.col("path"))).join(near, "_dir", "left")
    factor = F.when(F.col("_hit"), 1.5).otherwise(1.0) * F.when(F.col("_near"), 1.3).otherwise(1.0)
    return out.withColumn(score, F.col(score) * factor).drop("_hit", "_dir", "_near")


def information_density(signals: dict[str, tuple[Column, int, float]], span: Column) -> Column:
    """Weighted counts, each cut at its cap, by line span; at most 1, to 4 places."""
    total = sum((F.least(n, F.lit(cap)) * w for n, cap, w in signals.values()), F.lit(0.0))
    return F.round(F.least(total / F.greatest(span, F.lit(1)), F.lit(1.0)), 4)


def occurrences(text: Column, term: Column) -> Column:
    return F.when(F.length(term) > 0, (F.length(text) - F.length(F.replace(text, term, F.lit("")))) / F.length(term)).otherwise(0).cast("long")


def tiers(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows (tier, …): tier 1 whole; of tier 2 the first 16 and what tier 1 left of 64; of tier 3 the first 8 and what tier 2 left.

    The counts come first, then each tier is a bounded top-n, so none is sorted in one task.
    """
    one, two = rows.agg(*[F.count(F.when(F.col("tier") == t, 1)) for t in (1, 2)]).first()
    room = 16 + max(64 - one, 0)
    first = lambda tier, n: rows.where(F.col("tier") == tier).orderBy(*order).limit(n)
    return rows.where("tier = 1").unionByName(first(2, room)).unionByName(first(3, 8 + max(room - two, 0)))


def completeness(parts: dict[str, float], types: dict[str, str]) -> Column:
    """The sum of the weights of those columns that say something: no nulls, empty texts or empty lists."""
    full = lambda c: F.size(c) > 0 if types[c].startswith("array") else F.length(F.col(c)) > 0
    return sum((F.when(full(c), w).otherwise(0.0) for c, w in parts.items()), F.lit(0.0))
