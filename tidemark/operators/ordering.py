"""Positions in a total order without one task for all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import saved


def with_index(rows: DataFrame, *order: str) -> DataFrame:
    """rows with their 0-based place in the order: range partitions are sorted in parallel and offset by the sizes of those before.

    Only one number for each partition is collected by a window.
    """
    ranged = rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    ranged = saved(ranged, "ranged")
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).drop("_n")
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return ranged.join(F.broadcast(before), "_part").withColumn("index", F.col("_before") + inside).drop("_part", "_before")


def placed(rows: DataFrame, by: str, order: str, name: str = "placed") -> DataFrame:
    """rows with their 0-based place (pos) in the order of their ``by`` and the size of that group (n); nulls come first.

    One range sort of all rows; places come from the sizes of the sorted partitions, so a group
    of any size is no single task's.  Rows equal in both columns are ordered by where they were read.
    """
    tied = saved(rows, name).withColumn("_tie", F.monotonically_increasing_id())
    keys = [F.asc_nulls_first(by), F.asc_nulls_first(order), F.asc("_tie")]
    at = saved(tied.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie").withColumn("_at", F.monotonically_increasing_id()), f"{name}-sorted")
    part, whole = F.shiftright("_at", 33), Window.partitionBy(by)  # a group's rows here: the partitions it reaches into
    sizes = at.groupBy(by, part.alias("_part")).agg(F.count("*").alias("_size"), F.min("_at").alias("_first"))
    shift = F.sum("_size").over(whole.orderBy("_part")) - F.col("_size") - F.col("_first")
    starts = saved(sizes.select(F.col(by).alias("_by"), "_part", shift.alias("_shift"), F.sum("_size").over(whole).alias("n")), f"{name}-starts")
    met = at.join(starts, F.col(by).eqNullSafe(F.col("_by")) & (part == F.col("_part")))
    return met.withColumn("pos", F.col("_at") + F.col("_shift")).drop("_at", "_by", "_part", "_shift")
