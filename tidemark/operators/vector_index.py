"""Exact top-k search by inverted lists: points lie around centroids, and lists that can't hold a result aren't read.

Centroids are fitted on a bounded sample; every point is in the list of its nearest one, with its
distance from it.  Vectors are of length 1, so similarity falls with distance, and the triangle
inequality bounds it: a point of a list is no nearer to a query than the query's distance from
the centroid less the point's.  A first look into each query's nearest lists gives a distance
within which its results lie; a second reads only the lists, and compares only the points, that
reach into it.  So nothing is missed, whatever the centroids.

Lists are partitions of a written table, which Spark prunes when it reads.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import new_path
from .ranking import QUERY_BLOCK, _query_blocks

#: Points that centroids are fitted on, about, and rounds of the fit.
SAMPLE, ROUNDS = 8192, 8
#: Files of a list at most.
SPREAD = 8
#: Similarities are rounded to so many places, and so compared.
PLACES = 6
FOUND = "query long, point long, similarity double"


def _unit(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of length 1, and which rows have one: of the right number of entries, none of them null, and not zero."""
    right = np.array([v is not None and len(v) == size and None not in v for v in column.to_pylist()], bool)
    flat = column.filter(pa.array(right)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, size)
    long = np.linalg.norm(flat, axis=1)
    good = np.isfinite(long) & (long > 0)
    right[np.flatnonzero(right)[~good]] = False
    return flat[good] / long[good, None], right


def _fitted(sample: np.ndarray, lists: int, seed: int = 7) -> np.ndarray:
    """Centroids of a sample, of length 1."""
    rng = np.random.default_rng(seed)
    centroids = sample[rng.permutation(len(sample))[:lists]].copy()
    for _ in range(ROUNDS):
        nearest = (sample @ centroids.T).argmax(axis=1)
        for c in np.unique(nearest):
            mean = sample[nearest == c].mean(axis=0)
            if (long := np.linalg.norm(mean)) > 0:
                centroids[c] = mean / long
    return centroids


class VectorIndex:
    """Lists of points (point, vector); vectors without a direction, and of another size than most, are in none."""

    def __init__(self, points: DataFrame, lists: int = 64):
        rows = points.select(F.col("point").cast("long").alias("point"), F.col("vector").cast("array<double>").alias("vector")).where("vector is not null")
        most = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
        self.spark, self.size, self.centroids, self.path = points.sparkSession, most["d"] if most else 0, np.zeros((0, 0)), new_path(points.sparkSession, "vector-index")
        if not self.size:
            self.counts, self.radius = np.zeros(0, np.int64), np.zeros(0)
            return
        share = min(1.0, SAMPLE / most["count"])
        sample = rows.where((F.size("vector") == self.size) & (F.shiftrightunsigned(F.xxhash64("point"), 32) < int(share * 2**32))).select("vector").toArrow()["vector"].combine_chunks()
        vectors, _ = _unit(sample, self.size)
        self.centroids = _fitted(vectors, lists) if len(vectors) else np.eye(1, self.size)
        shared, size = self.spark.sparkContext.broadcast(self.centroids), self.size

        def run(batches):
            for batch in batches:
                v, good = _unit(batch.column(1), size)
                near = v @ shared.value.T
                where = near.argmax(axis=1)
                away = np.linalg.norm(v - shared.value[where], axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good)), pa.FixedSizeListArray.from_arrays(pa.array(v.ravel()), size).cast(pa.list_(pa.float64())), pa.array(where.astype(np.int32)), pa.array(away)], ["point", "vector", "list", "away"])

        made = rows.mapInArrow(run, "point long, vector array<double>, list int, away double")
        made.repartition("list", F.pmod(F.xxhash64("point"), F.lit(SPREAD))).write.partitionBy("list").parquet(self.path)
        self.table = self.spark.read.schema("point long, vector array<double>, away double, list int").parquet(self.path)
        known = {r["list"]: (r["n"], r["r"]) for r in self.table.groupBy("list").agg(F.count("*").alias("n"), F.max("away").alias("r")).collect()}  # a row a list
        self.counts = np.array([known.get(c, (0, 0))[0] for c in range(len(self.centroids))], np.int64)
        self.radius = np.array([known.get(c, (0, -np.inf))[1] for c in range(len(self.centroids))])
        #: points compared with queries, and those that all pairs would be
        self.read = self.all = 0

    def _look(self, ids: np.ndarray, queries: np.ndarray, away: np.ndarray, which: np.ndarray, within: np.ndarray, k: int) -> DataFrame:
        """FOUND rows: for each query the best k of each batch of the lists that ``which`` (queries by lists) marks, among points that can be within its distance."""
        wanted = np.flatnonzero(which.any(axis=0))
        shared = self.spark.sparkContext.broadcast((ids, queries, away, which, within))

        def run(batches):
            ids, queries, away, which, within = shared.value
            size = queries.shape[1]
            for batch in batches:
                place, points, far = batch.column(2).to_numpy(), batch.column(0).to_numpy(), batch.column(3).to_numpy()
                vectors = batch.column(1).flatten().to_numpy().reshape(-1, size)
                out: list[tuple] = []
                for c in np.unique(place):
                    mine = np.flatnonzero(place == c)
                    for q in np.flatnonzero(which[:, c]):
                        some = mine[np.abs(far[mine] - away[q, c]) <= within[q]]
                        if not len(some):
                            continue
                        like = np.round(vectors[some] @ queries[q], PLACES)
                        best = np.lexsort((points[some], -like))[:k]
                        out.append((np.full(len(best), ids[q]), points[some][best], like[best]))
                columns = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["query", "point", "similarity"])

        return self.table.where(F.col("list").isin(wanted.tolist())).select("point", "vector", "list", "away").mapInArrow(run, FOUND)

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """(query, point, similarity, rank): the k most similar points of each query (query, q_vector); equal ones by point.  A stated set of queries, block by block."""
        order = Window.partitionBy("query").orderBy(F.desc("similarity"), "point")
        ranked = lambda found: found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        out = None
        for ids, matrix in _query_blocks(queries.where(F.size("q_vector") == self.size), QUERY_BLOCK) if self.size else ():
            away = np.stack([np.linalg.norm(matrix - c, axis=1) for c in self.centroids], axis=1)
            nearest = np.argsort(away, axis=1)
            held = np.cumsum(self.counts[nearest], axis=1)
            enough = held - self.counts[nearest] < 4 * k  # the nearest lists, until they have some more points than wanted
            which = np.zeros(away.shape, bool)
            np.put_along_axis(which, nearest, enough, axis=1)
            which &= self.counts > 0
            first = self._look(ids, matrix, away, which, np.full(len(ids), np.inf), k)
            last = {r["query"]: r["s"] for r in ranked(first).groupBy("query").agg(F.min("similarity").alias("s"), F.count("*").alias("n")).where(F.col("n") == k).collect()}  # a row a query of the block
            within = np.array([np.sqrt(max(2 - 2 * (last[i] - 10.0**-PLACES), 0)) if i in last else np.inf for i in ids.tolist()])
            more = ~which & (self.counts > 0) & (away - self.radius <= within[:, None] + 1e-9)
            self.read += int(((which | more) * self.counts).sum())
            self.all += int(self.counts.sum()) * len(ids)
            both = self._look(ids, matrix, away, which | more, within + 1e-9, k)
            out = ranked(both) if out is None else out.unionByName(ranked(both))
        return out if out is not None else self.spark.createDataFrame([], f"{FOUND}, rank int")
