"""Recurring work as Structured Streaming: file sources, micro-batches, windows, state."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..shared import new_path


def read(spark: SparkSession, path: str, schema, per_trigger: int = 16) -> DataFrame:
    """A stream of parquet files; so many at most are admitted to a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def run_batches(stream: DataFrame, work: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """All that is there, in micro-batches, with its checkpoint in the shared folder; work must stand a batch that comes twice."""
    spark = stream.sparkSession
    stream.writeStream.outputMode(mode).foreachBatch(work).option("checkpointLocation", new_path(spark, "stream")).trigger(availableNow=True).start().awaitTermination()


def newest(events: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """The newest event of each key."""
    last = F.max_by(F.struct(*events.columns), F.struct(at, tie)).alias("last")
    return events.groupBy(key).agg(last).select("last.*")


def merge_newest(state: DataFrame, batch: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    return newest(state.unionByName(batch), key, at, tie)


def fixed_windows(events: DataFrame, key: str, at: str = "ts", size: str = "1 hour", late: str | None = None) -> DataFrame:
    """Events of each key in fixed windows; with late, a stream's late bound."""
    e = events.withWatermark(at, late) if late else events
    return e.groupBy(key, F.window(at, size).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), "n")


def over_limit(windows: DataFrame, limit: int) -> DataFrame:
    return windows.where(F.col("n") > limit)


def sessions(events: DataFrame, key: str, at: str, gap_s: int) -> DataFrame:
    """An extra: runs of events with no gap longer than so many seconds."""
    w = Window.partitionBy(key).orderBy(at)
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    new = F.when(micros - F.lag(micros).over(w) <= gap_s * 1_000_000, 0).otherwise(1)
    marked = events.withColumn("_new", new).withColumn("_s", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(key, "_s").agg(F.min(at).alias("start"), F.max(at).alias("end"), F.count("*").alias("n")).drop("_s")


def apply_changes(index: DataFrame, changes: DataFrame, points: DataFrame) -> DataFrame:
    """index (path, …) after changes (path, change: update or delete) and the new points (path, …) of updated paths.

    All points of a changed path are replaced; a path both updated and deleted is an error.
    """
    both = changes.groupBy("path").agg(F.count_distinct("change").alias("n")).where("n > 1")
    if not both.isEmpty():
        raise ValueError("a path is both updated and deleted")
    updated = changes.where("change = 'update'").select("path").distinct()
    return index.join(changes.select("path").distinct(), "path", "left_anti").unionByName(points.join(updated, "path", "left_semi"))


def reuse_vectors(new: DataFrame, cache: DataFrame, same: list[str]) -> DataFrame:
    """new (id, …) with the vector of the cached point of the same id, if all of ``same`` agree; ``reused`` tells."""
    old = cache.select("id", F.col("vector").alias("_v"), *[F.col(c).alias(f"_{c}") for c in same])
    agree = F.lit(True)
    for c in same:
        agree = agree & (F.col(c) == F.col(f"_{c}"))
    out = new.join(old, "id", "left").withColumn("reused", F.coalesce(agree & F.col("_v").isNotNull(), F.lit(False)))
    return out.withColumn("vector", F.when(F.col("reused"), F.col("_v"))).drop("_v", *[f"_{c}" for c in same])


def copy_branches(points: DataFrame, rebuilt: str, dimension: int) -> DataFrame:
    """Points of other branches for a new generation; vectors of another size aren't taken along."""
    return points.where((F.col("branch") != rebuilt) & (F.size("vector") == dimension))


def seal(points: DataFrame, expected: int | None = None) -> DataFrame:
    """Order-independent digest and count of a generation's members; a wrong count is an error."""
    from ..operators.aggregates import merkle

    out = merkle(points.withColumn("_digest", F.sha2(F.to_json(F.struct(*points.columns)), 256)), "id", "_digest")
    if expected is not None and (n := out.first()["members"]) != expected:
        raise ValueError(f"{n} members, {expected} expected")
    return out


STEPS = {None: {"INGESTED"}, "INGESTED": {"PLANNED", "EXCLUDED"}, "PLANNED": {"REVIEWED", "EXCLUDED"}, "REVIEWED": {"VALIDATED", "EXCLUDED"}, "VALIDATED": {"COMPLETED", "EXCLUDED"}, "COMPLETED": set(), "EXCLUDED": set()}


def _advance(key, parts, state):
    now, bad = state.get if state.exists else (None, 0)
    rows = pd.concat(list(parts)).sort_values("seq")
    for s in rows["state"]:
        if s in STEPS.get(now, set()):
            now = s
        else:
            bad += 1
    state.update((now, bad))
    yield pd.DataFrame({"hunk": [key[0]], "state": [now], "illegal": [bad]})


def coverage_stream(events: DataFrame) -> DataFrame:
    """A stream of (hunk, seq, state): each hunk's state by legal steps alone, and how many were not, after every micro-batch."""
    return events.groupBy("hunk").applyInPandasWithState(_advance, "hunk long, state string, illegal long", "state string, illegal long", "update", GroupStateTimeout.NoTimeout)
