"""Operator 7: cross-site boilerplate lines, by the number of distinct sites that carry a line.

A line is what stands between line feeds, compared without blanks around it.  Texts are
split and hashed once; all that follows reads the table of hashed lines.  Per line a
HyperLogLog sketch of its sites is built by partial aggregation, so the most common line
costs one sketch a task.  Lines whose estimate is clear of the threshold are decided by
it; those near it get an exact distinct count, of (line, site) pairs that are combined
before they meet the near lines.  A line found on ``min_sites`` sites or more is removed from
every document but the one with the smallest id that has it.

Native: DataFrame functions alone, no Python on the executors.

Cases: null text has no lines and stays null; blank lines never count and stay; a null
source is no site; repeated lines of a document go or stay together; rows without an id
keep all lines; rows of one id are one document, but each loses its own lines; other columns
are passed on untouched, whatever their names (the struct of the counts is the last column).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

MIN_SITES = 5
#: Estimates within this share of the threshold (and one site at least) are counted exactly.
NEAR = 0.25
_BLANKS = "^[ \t\r\f\u000b]+|[ \t\r\f\u000b]+$"


def lines(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """(id, copy, pos, site, a, b): each line that isn't blank; a and b are two hashes of it, copy one of the whole text."""
    each = docs.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.xxhash64(text_col).alias("copy"), F.col(site_col).alias("site"), F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("pos", "line")
    )
    each = each.select("id", "copy", "site", "pos", F.regexp_replace("line", _BLANKS, "").alias("line")).where("line <> ''")
    return each.select("id", "copy", "pos", "site", F.xxhash64("line").alias("a"), F.xxhash64(F.lit(1), F.col("line")).alias("b"))


def boilerplate(each: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(a, b, first_id, sites): the lines found on min_sites sites or more."""
    spread = each.groupBy("a", "b").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.hll_sketch_agg("site").alias("sketch"))
    spread = saved(spread.where(F.col("n") >= min_sites).select("a", "b", "first_id", F.hll_sketch_estimate("sketch").alias("sites")), "line-sites")
    margin = max(1, round(NEAR * min_sites))
    clear = spread.where(F.col("sites") > min_sites + margin)
    near = spread.where(F.col("sites").between(min_sites - margin, min_sites + margin)).select("a", "b", "first_id")
    pairs = each.where("site is not null").groupBy("a", "b", "site").agg(F.count("*").alias("n"))
    exact = near.join(pairs, ["a", "b"]).groupBy("a", "b", "first_id").agg(F.count("*").alias("sites")).where(F.col("sites") >= min_sites)
    return clear.unionByName(exact)


def remove_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", counts_col: str = "_lines") -> DataFrame:
    """docs with the lines taken out of text; last, and in place of any such column, the struct counts_col of n_lines and n_removed."""
    each = saved(lines(docs, id_col, text_col, site_col), "lines")
    common = saved(boilerplate(each, min_sites), "boilerplate")
    gone = each.join(common, ["a", "b"]).where(F.col("id") > F.col("first_id")).groupBy("id", "copy").agg(F.collect_set("pos").alias("gone"))
    doc = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    every = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("copy"), doc.alias("doc")).join(gone, ["id", "copy"], "left")
    text, gone_at = F.col("doc")[text_col], F.coalesce("gone", F.array().cast("array<int>"))
    parts = F.split(text, "\n", -1)
    kept = F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), gone_at), lambda i: F.get(parts, i)), "\n")
    columns = {c: F.col("doc")[c].alias(c) for c in docs.columns if c != counts_col}
    columns[text_col] = F.when(F.col("gone").isNull(), text).otherwise(kept).alias(text_col)
    n_lines = F.coalesce(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1, F.lit(0))
    return every.select(*columns.values(), F.struct(n_lines.cast("long").alias("n_lines"), F.size(gone_at).cast("long").alias("n_removed")).alias(counts_col))
