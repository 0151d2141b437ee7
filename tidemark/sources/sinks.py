"""Sinks: upserts, content store, packed batches and tables that are swapped as a whole."""

from __future__ import annotations

import os

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.packing import pack_batches  # noqa: F401
from ..shared import new_path


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of new replace those of old that have their key."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)


def insert_missing(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """old, and the rows of new whose key it hasn't."""
    return old.unionByName(new.join(old.select(*key), key, "left_anti"))


def add_counts(old: DataFrame, new: DataFrame, key: list[str], count: str) -> DataFrame:
    return old.unionByName(new).groupBy(*key).agg(F.sum(count).alias(count))


def content_store(rows: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """(blobs: hash and text, once each; references: rows with hash in place of text)."""
    hashed = rows.withColumn("hash", F.sha2(F.col(text), 256))
    return hashed.groupBy("hash").agg(F.first(text).alias(text)), hashed.drop(text)


class Conflict(RuntimeError):
    """Of two publishers that observed the same generation this one came second."""


class Versions:
    """A table of immutable generations with a pointer to the current one.

    ``publish`` writes a generation, checks its count, and only then moves the pointer; a failed
    check leaves the pointer where it was.  The pointer is itself a one-row table whose last
    version counts, so a reader sees either generation as a whole.
    """

    def __init__(self, spark: SparkSession, where: str | None = None):
        self.spark, self.where = spark, where or new_path(spark, "versions")

    def number(self) -> int:
        """Of the current entry; 0 before the first."""
        return self.history().agg(F.max("number")).first()[0] or 0

    def publish(self, df: DataFrame, expected_rows: int | None = None, observed: int | None = None) -> str:
        """Writes a generation and makes it current, if the current entry is still the one observed (when this began, unless given)."""
        observed = self.number() if observed is None else observed
        path = f"{self.where}/generation-{new_path(self.spark, 'g').rpartition('-')[2]}"
        df.write.parquet(path)
        n = self.spark.read.parquet(path).count()
        if expected_rows is not None and n != expected_rows:
            raise ValueError(f"{n} rows written, {expected_rows} expected; the current generation stays")
        self._swap(observed, path, n)
        return path

    def _swap(self, observed: int, path: str, rows: int) -> None:
        """Compare and swap: the number after the one observed is claimed by a file that only one publisher can create."""
        if self.number() != observed or not self._claim(observed + 1):
            raise Conflict(f"another generation was published after number {observed}; the current one stays")
        self.spark.createDataFrame([(observed + 1, path, rows)], "number long, path string, rows long").coalesce(1).write.mode("append").parquet(f"{self.where}/pointer")

    def _claim(self, number: int) -> bool:
        jvm, name = self.spark._jvm, f"{self.where}/claims/{number}"
        where = jvm.org.apache.hadoop.fs.Path(name)
        system = where.getFileSystem(self.spark._jsc.hadoopConfiguration())
        system.mkdirs(where.getParent())
        if system.getScheme() == "file":  # whose create() is not atomic
            try:
                os.close(os.open(where.toUri().getPath(), os.O_CREAT | os.O_EXCL))
                return True
            except FileExistsError:
                return False
        try:
            system.create(where, False).close()
            return True
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception):
                return False
            raise

    def recover(self) -> None:
        """Gives up the claim of a publisher that is known to have died before it moved the pointer, so others can go on."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.where}/claims/{self.number() + 1}")
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, False)

    def history(self) -> DataFrame:
        schema = "number long, path string, rows long"
        try:
            return self.spark.read.schema(schema).parquet(f"{self.where}/pointer")
        except Exception as e:  # no generation so far
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def current(self) -> DataFrame:
        return self.spark.read.parquet(self.history().orderBy(F.desc("number")).first()["path"])

    def roll_back(self) -> None:
        """The generation before the current one is current again (a new entry; nothing is deleted)."""
        last = self.history().orderBy(F.desc("number")).take(2)
        if len(last) < 2:
            raise ValueError("there is no generation to go back to")
        self._swap(last[0]["number"], last[1]["path"], last[1]["rows"])
