"""Sources: files as rows, checked CSV, identities and bounded scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import filters
from ..operators.aggregates import digest_tree

MAX_BYTES = 1 << 20


def scan_directory(spark: SparkSession, root: str, include=(), exclude=(), max_bytes: int = MAX_BYTES) -> DataFrame:
    """Text files below root: (path, content, size, text)."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).where(F.col("length") <= max_bytes)
    rel = F.regexp_replace("path", "^[a-z]+:/*" + root.strip("/") + "/", "")
    return text_files(raw.select(rel.alias("path"), "content"), include, exclude, max_bytes)


def text_files(files: DataFrame, include=(), exclude=(), max_bytes: int = MAX_BYTES) -> DataFrame:
    """Of (path, content, …) those by globs, size and a decode guard; with size and text."""
    chosen = filters.select_paths(files, list(include), list(exclude))
    sized = chosen.withColumn("size", F.octet_length("content").cast("long")).where(F.col("size") <= max_bytes)
    return sized.where(filters.decodable(F.col("content"))).withColumn("text", F.col("content").cast("string"))


def load_files(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (path, digest or null) with text; ``intact`` tells whether the digest, if given, is that of the content."""
    got = text_files(files).withColumn("found_digest", F.sha2("content", 256))
    return wanted.join(got, "path").withColumn("intact", F.col("digest").isNull() | (F.col("digest") == F.col("found_digest"))).drop("content")


def tree_identity(files: DataFrame, *by: str, path: str = "path", text: str = "text") -> DataFrame:
    """One digest for each tree, whatever the order and number of its files: a digest tree over path:digest."""
    return digest_tree(files, F.concat(F.col(path), F.lit(":"), F.sha2(F.col(text), 256)), *by).withColumnRenamed("seal", "identity").drop("members")


def scroll(df: DataFrame, order: list[str], most: int, after: Column | None = None) -> DataFrame:
    """The first rows by a total order (after a key, if given), with a flag whether there are more."""
    rows = df.where(after) if after is not None else df
    # two top-k plans: neither sorts the table
    first = rows.orderBy(*order).limit(most)
    more = rows.limit(most + 1).agg((F.count("*") > most).alias("truncated"))
    return first.join(F.broadcast(more), F.lit(True), "left")


def read_csv(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """A CSV with a header, all columns as text; missing columns are an error before any row is read."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"')
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"columns missing in {path}: {', '.join(missing)}")
    return df
