"""Greedy packing in order, without one task for a group.

Whether a row starts a batch depends on where the batch before it began, that is on every row
before.  But a batch has a bounded number of rows, so between two blocks of rows there are few
states: how many rows before the border the open batch began.  Each block tells, for every
such state, the state it ends in and the batches it closes (one pass, by search in prefix sums
from the last row to the first); blocks of these tables are composed, level by level, and on the
way down again every block learns the state that it really begins in.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import saved
from .ordering import placed

#: Rows of a block (more than a batch may have), and blocks that are composed at once.
BLOCK, FAN = 4096, 64


def follow(sizes: np.ndarray, max_bytes: int, max_rows: int) -> np.ndarray:
    """Where the next batch begins, for a batch that begins at each row: past the last if it is still open there."""
    upto = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
    row = np.arange(len(sizes))
    end = np.searchsorted(upto, upto[:-1] + max_bytes, side="right") - 1
    return np.minimum(np.maximum(end, row + 1), row + max_rows)


def transfer(sizes: np.ndarray, halo: int, max_bytes: int, max_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """For batches begun 1, 2, … halo rows before the block (or at its first row, if there is no halo): rows before the block's end at which the last batch begins, batches closed by then."""
    n, after = len(sizes), follow(sizes, max_bytes, max_rows)
    last, closed = np.arange(n), np.zeros(n, np.int64)
    for s in range(n - 1, -1, -1):
        if after[s] < n:
            last[s], closed[s] = last[after[s]], closed[after[s]] + 1
    begun = np.arange(halo - 1, -1, -1) if halo else np.zeros(1, np.int64)
    return n - last[begun], closed[begun]


def composed(tables: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The table of blocks one after another."""
    begun, closed = tables[0]
    for to, more in tables[1:]:
        closed = closed + more[begun - 1]
        begun = to[begun - 1]
    return begun, closed


def pack_batches(rows: DataFrame, by: str, order: str, size: str, max_bytes: int, max_rows: int = 128) -> DataFrame:
    """rows with a batch number within their ``by``: greedy, in order; a batch never exceeds its bytes or rows (a larger row is alone).

    Null sizes are 0, nulls of ``by`` a group, ties in order are broken by all columns.
    """
    if max_rows >= BLOCK:
        raise ValueError(f"a batch of {BLOCK} rows or more")
    kind, fan = rows.schema[by].dataType.simpleString(), FAN
    row = F.struct(*rows.columns)
    told = placed(rows.select(F.col(by).alias("grp"), F.col(order).alias("o"), F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0)).alias("size"), row.alias("row")), "grp", "o", "packing")
    block, inside = F.expr(f"pos div {BLOCK}"), F.expr(f"pos % {BLOCK}")
    # the last rows of a block are seen by the next one, too
    both = F.when((inside >= BLOCK - max_rows) & (F.col("pos") - inside + BLOCK < F.col("n")), F.array(block, block + 1)).otherwise(F.array(block))
    each = told.select("grp", "pos", "size", "row", block.alias("own"), F.explode(both).alias("block"))
    each = each.withColumn("row", F.when(F.col("own") == F.col("block"), F.col("row")))
    blocks = saved(each.groupBy("grp", "block").agg(F.sort_array(F.collect_list(F.struct("pos", "size", "row"))).alias("rows")), "packing-blocks")

    def tables(batches):
        for pdf in batches:
            out = []
            for g, b, sizes in zip(pdf["grp"], pdf["block"], pdf["sizes"]):
                begun, closed = transfer(np.asarray(sizes, np.int64), max_rows if b else 0, max_bytes, max_rows)
                out.append((g, b, begun, closed))
            yield pd.DataFrame(out, columns=["grp", "block", "begun", "closed"])

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        begun, closed = composed([(np.asarray(a), np.asarray(c)) for a, c in zip(pdf["begun"], pdf["closed"])])
        return pd.DataFrame([(pdf["grp"].iloc[0], pdf["block"].iloc[0] // fan, begun, closed)], columns=["grp", "block", "begun", "closed"])

    def states(pdf: pd.DataFrame) -> pd.DataFrame:
        """The state before each block, from that before the first."""
        pdf, out = pdf.sort_values("block"), []
        now, number = int(pdf["state"].iloc[0]), int(pdf["batch"].iloc[0])
        for g, b, begun, closed in zip(pdf["grp"], pdf["block"], pdf["begun"], pdf["closed"]):
            out.append((g, b, now, number))
            now, number = int(begun[max(now, 1) - 1]), number + int(closed[max(now, 1) - 1])
        return pd.DataFrame(out, columns=["grp", "block", "state", "batch"])

    schema = f"grp {kind}, block long, begun array<long>, closed array<long>"
    level = saved(blocks.select("grp", "block", F.col("rows.size").alias("sizes")).mapInPandas(tables, schema), "packing-tables")
    levels = [level]
    while not level.where("block > 0").isEmpty():
        level = saved(level.groupBy("grp", F.expr(f"block div {fan}").alias("_to")).applyInPandas(compose, schema), "packing-tables")
        levels.append(level)
    # state 0: nothing before
    known = levels[-1].select("grp", "block", F.lit(0).alias("state"), F.lit(0).cast("long").alias("batch"))
    for below in reversed(levels[:-1]):
        up = known.select(F.col("grp").alias("_g"), F.col("block").alias("_b"), "state", "batch")
        met = below.join(up, F.col("grp").eqNullSafe(F.col("_g")) & (F.expr(f"block div {fan}") == F.col("_b")))
        known = saved(met.groupBy("_g", "_b").applyInPandas(lambda pdf: states(pdf), f"grp {kind}, block long, state int, batch long"), "packing-states")

    def numbered(batches):
        for pdf in batches:
            out = []
            for b, sizes, state, number in zip(pdf["block"], pdf["sizes"], pdf["state"], pdf["batch"]):
                after = follow(np.asarray(sizes, np.int64), max_bytes, max_rows)
                halo, batch = (max_rows if b else 0), np.zeros(len(sizes), np.int64)
                at = halo - state
                while at < len(sizes):
                    batch[at : after[at]] = number
                    at, number = int(after[at]), number + 1
                out.append(batch[halo:])
            yield pd.DataFrame({"grp": pdf["grp"], "block": pdf["block"], "batches": out})

    up = known.select(F.col("grp").alias("_g"), F.col("block").alias("_b"), "state", "batch")
    met = blocks.join(up, F.col("grp").eqNullSafe(F.col("_g")) & (F.col("block") == F.col("_b"))).drop("_g", "_b")
    numbers = met.select("grp", "block", F.col("rows.size").alias("sizes"), "state", "batch").mapInPandas(numbered, f"grp {kind}, block long, batches array<long>").select(F.col("grp").alias("_g"), F.col("block").alias("_b"), "batches")
    own = F.filter("rows", lambda x: x["row"].isNotNull())
    out = blocks.join(numbers, F.col("grp").eqNullSafe(F.col("_g")) & (F.col("block") == F.col("_b")))
    return out.select(F.explode(F.arrays_zip(F.transform(own, lambda x: x["row"]).alias("row"), F.col("batches").alias("batch"))).alias("x")).select("x.row.*", F.col("x.batch").cast("int").alias("batch"))
