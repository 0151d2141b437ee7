"""Operator 8: mixing sources to target weights by balanced (cube method) sampling.

Every document of a source has the same expected number of copies, target / source size.
Its whole part is taken outright; the fraction is an inclusion probability.  The flight
phase moves these probabilities inside blocks of one source along directions in the null
space of two constraints (tokens, documents), so both totals stay as they are while
probabilities become 0 or 1.  A block ends with two open documents at most; the open ones
of all blocks meet in the next, a thousand times smaller round, and the one or two that a
source has left land on the nearest token total.

Sources are ranked and their targets found by Spark as well (a few aggregations of the table
of sources), so their number is not bounded; the driver holds sums only.

Cases: null text counts as size 0; a null source is a source of its own, last in order;
documents of size 0 take nothing; repeated rows are documents of their own, however many they
are (they go to blocks by parts of PART); rows without an id are mixed like others; other
columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, saved

#: Documents of a block; the open ones after a round are 2 in so many.
BLOCK = 4096
#: Equal rows (id, text) of a source that go to a block together at most.
PART = 1024
#: Documents that the last round leaves to the landing, besides those its flight can't settle.
LANDING = 8


def ranked(stats: DataFrame) -> DataFrame:
    """stats (source, …) with rank: its number by code point, from 0, null last.  Only the number of rows of each range goes to the driver."""
    order = [F.col("source").isNull(), F.col("source")]
    parts = int(stats.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = saved(stats.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "source-ranges")
    before, at = [], 0
    for part, n in sorted(map(tuple, ranges.groupBy("part").count().collect())):
        before.append((part, at))
        at += n
    before = stats.sparkSession.createDataFrame(before, "part int, before long")
    own = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return ranges.join(F.broadcast(before), "part").withColumn("rank", F.col("before") + own - 1).drop("part", "before")


def with_targets(stats: DataFrame, weights, share: float, cap: float) -> DataFrame:
    """stats (source, source_size, …) with target: shares of the total by weight, none above cap times the size; what is cut off is shared anew by weight.

    A source, once cut, stays so, since the others' shares only grow: each round is one
    aggregation, until none is above.
    """
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    plan = saved(ranked(stats).withColumn("weight", weight), "sources")
    total = share * (plan.agg(F.sum("source_size")).first()[0] or 0)
    most, level, cut = F.lit(float(cap)) * F.col("source_size"), 0.0, -1
    while True:
        over = F.lit(level) * F.col("weight") > most
        n, taken, free = plan.agg(F.count_if(over), F.coalesce(F.sum(F.when(over, most)), F.lit(0.0)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0))).first()
        if n == cut or not free:
            break
        cut, level = n, (total - taken) / free
    return plan.withColumn("target", F.when(over, most).otherwise(F.lit(level) * F.col("weight"))).drop("rank", "weight")


def flight(size: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Fast flight: it ends with two open probabilities at most; both totals stay (but for those two documents)."""
    p = p.copy()
    open_ = [i for i in range(len(p)) if 0 < p[i] < 1]
    chance = rng.random(2 * len(open_) + 4)
    live, nxt, step = open_[:3], 3, 0
    while len(live) >= 2:
        if len(live) == 3:
            a, b, c = (float(size[i]) for i in live)
            u = [b - c, c - a, a - b]
            if not any(u):
                u = [1.0, -1.0, 0.0]
        elif size[live[0]] == size[live[1]]:
            u = [1.0, -1.0]
        else:
            break
        up = min((1 - p[i]) / d if d > 0 else p[i] / -d for i, d in zip(live, u) if d)
        down = min(p[i] / d if d > 0 else (1 - p[i]) / -d for i, d in zip(live, u) if d)
        by = up if chance[step % len(chance)] * (up + down) < down else -down
        step += 1
        for i, d in zip(live, u):
            p[i] = p[i] + by * d
            if p[i] < 1e-9:
                p[i] = 0.0
            elif p[i] > 1 - 1e-9:
                p[i] = 1.0
        live = [i for i in live if 0 < p[i] < 1]
        while len(live) < 3 and nxt < len(open_):
            live.append(open_[nxt])
            nxt += 1
    return p


def land(size: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The few open probabilities of a source become 0 or 1: about as many documents as they stand for, nearest to their tokens."""
    open_ = np.flatnonzero((p > 0) & (p < 1))
    pick = np.arange(1 << len(open_))
    take = (pick[:, None] >> np.arange(len(open_)) & 1).astype(float)
    off = np.abs(take @ size[open_] - size[open_] @ p[open_])
    many = take.sum(axis=1)
    best = np.lexsort((pick, many, np.round(off, 6), np.abs(many - p[open_].sum()) > 1))[0]
    p = p.copy()
    p[open_] = take[best]
    return p


def settle(size: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The last flight: LANDING documents of different sizes stay out of it, so that the landing has a choice."""
    open_ = np.flatnonzero((p > 0) & (p < 1))
    _, kinds = np.unique(size[open_], return_index=True)
    stay = kinds[np.unique(np.linspace(0, len(kinds) - 1, LANDING).astype(int))] if len(kinds) else kinds
    flown = np.delete(open_, stay)
    p = p.copy()
    p[flown] = flight(size[flown], p[flown], rng)
    return land(size, p)


def _round(seed: int, level: int, last: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_id", "size", "copy", "part"], kind="stable", na_position="last")
        pdf = pdf.loc[pdf.index.repeat(pdf["many"])].assign(many=1)
        key = zlib.crc32(f"{seed}/{level}/{pdf['source'].iloc[0]}/{pdf['block'].iloc[0]}".encode())
        pdf["p"] = (settle if last else flight)(pdf["size"].to_numpy(float), pdf["p"].to_numpy(float), np.random.default_rng(key))
        return pdf

    return run


def size_column(text: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def mix(docs: DataFrame, weights=(3.0, 1.0, 2.0), share: float = 1.5, cap: float = 2.0, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per document: its id, source, size, source_size, target (of its source), copies and taken words."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("source"), size_column(text_col).alias("size"), F.xxhash64(text_col).alias("copy"))
    base = saved(rows.groupBy("_id", "source", "size", "copy").agg(F.count("*").alias("n")), "mix-sizes")
    stats = base.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("source_size"), F.sum("n").alias("docs"))
    per = F.when(F.col("source_size") > 0, F.least(F.lit(float(cap)), F.col("target") / F.col("source_size"))).otherwise(0.0)
    plan = with_targets(stats, weights, share, cap).select(F.col("source").alias("s"), "source_size", "target", F.floor(per).cast("int").alias("whole"), (per - F.floor(per)).alias("p"), F.ceil(F.col("docs") / BLOCK).alias("blocks"), "docs")
    plan = saved(plan, "mix-plan")
    units = base.join(plan.drop("docs"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    # equal rows by parts, so that not all of them meet in one block
    units = units.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / PART)))).withColumn("many", F.least(F.lit(PART), F.col("n") - F.col("part") * PART).cast("int")).drop("n")
    schema = "_id long, source string, size long, copy long, source_size long, target double, whole int, p double, blocks long, part long, many int, block long"
    names = [x.split()[0] for x in schema.split(", ")]
    left, level, done = plan.agg(F.max("docs")).first()[0] or 0, 0, None
    while True:
        last = left <= BLOCK
        spot = F.lit(0).cast("long") if last else F.pmod(F.xxhash64("_id", "size", "copy", "part", F.lit(level)), F.greatest(F.lit(1), F.ceil(F.col("blocks") / F.lit((BLOCK // 2) ** level))))
        moved = units.withColumn("block", spot).select(names).groupBy("source", "block").applyInPandas(_round(seed, level, last), schema)
        if last:
            done = moved if done is None else done.unionByName(moved)
            break
        moved = saved(moved, "mix-flight")
        fixed = moved.where(~((F.col("p") > 0) & (F.col("p") < 1)))
        done = fixed if done is None else done.unionByName(fixed)
        units = moved.where((F.col("p") > 0) & (F.col("p") < 1)).drop("block")
        left = units.groupBy("source").count().agg(F.max("count")).first()[0] or 0
        level += 1
    copies = F.col("whole") + F.when(F.col("p") >= 0.5, 1).otherwise(0)
    return done.select(F.col("_id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))
