"""Search by inverted lists against all pairs."""

import numpy as np

from tidemark.operators import ranking
from tidemark.operators.vector_index import VectorIndex


def rows_of(df):
    return sorted((r["query"], r["rank"], r["point"], r["similarity"]) for r in df.collect())


def test_search_equals_all_pairs_and_reads_less(spark):
    rng = np.random.default_rng(3)
    middle = rng.normal(size=(30, 12))
    x = middle[rng.integers(0, 30, 3000)] + rng.normal(size=(3000, 12)) * 0.05
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(5000 + i, [float(v) for v in x[7]]) for i in range(15)]
    points = spark.createDataFrame(rows + [(9001, None), (9002, [0.0] * 12), (9003, [1.0]), (9004, [])], "point long, vector array<double>").repartition(4)
    queries = spark.createDataFrame([r for r in rows if r[0] % 40 == 0 or r[0] == 7] + [(-1, [0.0] * 12), (-2, None)], "query long, q_vector array<double>")
    index = VectorIndex(points, lists=40)
    got = rows_of(index.search(queries, 9))
    assert got == rows_of(ranking.top_k(queries, points.where("size(vector) = 12"), 9))
    assert index.counts.sum() == len(rows) and index.read < 0.3 * index.all
    many = rows_of(index.search(queries.limit(2), 4000))  # more than there are
    assert len(many) == 2 * len(rows)


def test_an_empty_index(spark):
    none = spark.createDataFrame([], "point long, vector array<double>")
    queries = spark.createDataFrame([(1, [1.0])], "query long, q_vector array<double>")
    assert VectorIndex(none).search(queries, 3).collect() == []
