"""Operator 12: whitening of embeddings.

Every entry c becomes the integer x = floor(64 c) + 1000000.  One aggregation holds a Spark SQL
expression for each pair of dimensions of the upper triangle, the sum of products of values
centred before they are multiplied.  The covariance is assembled on the driver (dimensions
squared, whatever the number of rows) and decomposed by LAPACK; components are its unit
eigenvectors by falling eigenvalue.  Vectors are projected in Arrow batches.

Values are centred at the integer next to the mean, so that products and their sums are exact
in 64 bits wherever the range and number of the values prove that they fit; the rest of the
centring is an exact correction in integers, and the result is the covariance rounded once.
Where they can't be proven to fit the sums are of doubles.

Cases: a vector is left out if it is null, holds a null or non-finite entry, one of 2^44 or
more (it has no place among exact integers), or has another number of entries than most
vectors have (of equally frequent numbers the smaller counts).  Repeated rows and rows
without an id are vectors each.  An empty table, or one of empty vectors, gives no rows.  A
component along which nothing varies (of no more than rounding noise) has a null ``whitened``
and explains 0; if nothing varies at all, ``explained`` is null.  ``deviation`` is null where it
exceeds 64 bits.  Equal eigenvalues share a space in which any basis will do.  Other columns,
whatever their names, are not read.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import saved

#: Pairs of dimensions that one aggregation holds at most; more dimensions are refused.
MAX_DIMENSIONS = 128
COMPONENTS = 32
#: Groups that partial sums meet in: the rows that the driver gets.
MEETING = 64


def integers(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, int]:
    """(id, x) of the vectors that count, and how many entries they have."""
    v = F.col("v")
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = v.isNotNull() & F.forall("v", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float(1 << 44)), F.lit(False)))
    rows = rows.where(fine)
    most = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    d = most["d"] if most else 0
    return rows.where(F.size("v") == d).select("id", F.transform("v", lambda c: F.floor(c * 64) + F.lit(1_000_000).cast("long")).alias("x")), d


def _merged(rows: DataFrame, sums: dict[str, str], most: dict[str, str] | None = None) -> dict:
    """Sums (and largest values) of SQL expressions over all rows: one aggregation, whose partial sums meet in MEETING groups; their rows are added up here."""
    most = most or {}
    sent = [f"sum({e}) AS {k}" for k, e in sums.items()] + [f"max({e}) AS {k}" for k, e in most.items()]
    parts = [r.asDict() for r in rows.groupBy((F.spark_partition_id() % MEETING).alias("_part")).agg(*map(F.expr, sent)).collect()]
    return {k: sum(r[k] for r in parts) for k in sums} | {k: max((r[k] for r in parts), default=None) for k in most}


def pair_sums(values: DataFrame, names: list[str]) -> dict[tuple[int, int], float]:
    """Sums of products of each pair of columns, i <= j: an expression a pair, one aggregation."""
    pairs = {f"p{i}_{j}": f"{names[i]} * {names[j]}" for i in range(len(names)) for j in range(i, len(names))}
    return {tuple(map(int, k[1:].split("_"))): v for k, v in _merged(values, pairs).items()}


class Basis:
    """Number and sums of the fit list, components as columns by falling eigenvalue."""

    def __init__(self, n: int, sums: list[int], reach: int, covariance: np.ndarray):
        self.n, self.sums, self.reach, self.covariance = n, sums, reach, covariance
        values, vectors = np.linalg.eigh(covariance)
        self.values, self.vectors = np.maximum(values[::-1], 0), vectors[:, ::-1]
        noise = len(sums) * np.finfo(float).eps * self.values.max(initial=0)
        self.varies = self.values > noise
        self.trace = float(np.trace(covariance))


def fit(rows: DataFrame, d: int) -> Basis | None:
    """The basis of integer vectors (id, x) of d entries; None if there are none."""
    if d > MAX_DIMENSIONS:
        raise ValueError(f"{d} dimensions; an aggregation of all pairs is built for {MAX_DIMENSIONS} at most")
    if not d:
        return None
    first = _merged(rows, {"n": "1L"} | {f"s{i}": f"cast(x[{i}] AS decimal(20, 0))" for i in range(d)}, {"high": "array_max(x)", "low": "-array_min(x)"})
    if not first["n"]:
        return None
    n, sums = first["n"], [int(first[f"s{i}"]) for i in range(d)]
    mean = [round(Fraction(s, n)) for s in sums]
    reach = first["high"] + first["low"]  # no value is farther from a mean
    bound = n * reach * reach  # doubles are exact below 2^53, and cheaper than longs, which check for overflow
    exact, kind = bound < 1 << 63, "long" if 1 << 53 <= bound < 1 << 63 else "double"
    centred = rows.selectExpr(*(f"cast(x[{i}] - {m}L AS {kind}) AS y{i}" for i, m in enumerate(mean)))
    found = pair_sums(centred, [f"y{i}" for i in range(d)])
    rest = [s - n * m for s, m in zip(sums, mean, strict=True)]  # what is left to centre: less than n / 2 each
    covariance = np.zeros((d, d))
    for (i, j), p in found.items():
        covariance[i, j] = covariance[j, i] = (n * int(p) - rest[i] * rest[j]) / (n * n) if exact else p / n - (rest[i] / n) * (rest[j] / n)
    return Basis(n, sums, reach, covariance)


def project(rows: DataFrame, basis: Basis, components: int = COMPONENTS) -> DataFrame:
    """id, deviation (sum of (n x - S)^2, exact), whitened (array, a value for each component)."""
    n, sums, d = basis.n, basis.sums, len(basis.sums)
    mean = [round(Fraction(s, n)) for s in sums]
    rest = np.array([(s - n * m) / n for s, m in zip(sums, mean, strict=True)])
    shift = np.array(mean)
    take = min(components, d)
    with np.errstate(divide="ignore", invalid="ignore"):
        axes = np.where(basis.varies[:take], basis.vectors[:, :take] / np.sqrt(basis.values[:take]), np.nan)
    fits = d * (n * (basis.reach + 1)) ** 2 < 1 << 63
    whole = [s - n * m for s, m in zip(sums, mean, strict=True)]

    def run(batches):
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, d)
            y = x - shift
            if fits:
                deviation = pa.array(((n * y - np.array(whole, np.int64)) ** 2).sum(axis=1))
            else:
                exact = [sum((n * v - w) ** 2 for v, w in zip(row, whole, strict=True)) for row in y.tolist()]
                deviation = pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())
            out = (y - rest) @ axes
            values = pa.array(out.ravel(), from_pandas=True)  # no variation: null
            yield pa.RecordBatch.from_arrays([batch.column(0), deviation, pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, take, dtype=np.int32)), values)], ["id", "deviation", "whitened"])

    schema = T.StructType([rows.schema["id"], T.StructField("deviation", T.LongType()), T.StructField("whitened", T.ArrayType(T.DoubleType()))])
    return rows.select("id", "x").mapInArrow(run, schema)


def identity_error(projected: DataFrame, basis: Basis, components: int = COMPONENTS) -> float:
    """Largest absolute entry of the covariance of the whitened values, as they came out, minus the identity."""
    places = np.flatnonzero(basis.varies[:components])
    if not len(places):
        return 0.0
    names = [f"w{i}" for i in places]
    values = projected.selectExpr(*(f"whitened[{i}] AS {w}" for i, w in zip(places, names, strict=True)))
    means = _merged(values, {w: w for w in names})
    centred = values.select(*((F.col(w) - means[w] / basis.n).alias(w) for w in names))
    return max(abs(p / basis.n - (i == j)) for (i, j), p in pair_sums(centred, names).items())


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row for each vector that counts and each component: id, component, n, deviation, whitened, explained, identity_error."""
    rows, d = integers(vectors, id_col, vector_col)
    basis = fit(rows, d)
    if basis is None:
        kind = vectors.schema[id_col].dataType.simpleString()
        return vectors.sparkSession.createDataFrame([], f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    projected = saved(project(rows, basis, components), "whitened")
    error = identity_error(projected, basis, components)
    share = F.array(*(F.lit(float(e / basis.trace) if basis.trace and v else 0.0 if basis.trace else None).cast("double") for e, v in zip(basis.values[:components], basis.varies, strict=False)))
    out = projected.select("id", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    return out.select(F.col("id").alias(id_col), (F.col("place") + 1).alias("component"), F.lit(basis.n).cast("long").alias("n"), "deviation", "whitened", F.element_at(share, F.col("place") + 1).alias("explained"), F.lit(error).alias("identity_error"))
