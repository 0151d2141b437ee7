"""The corpus pipeline: language ID, line dedup, near-dedup, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again as the next stage's docs.  All but the last return the columns of documents.

Rows without a doc_id can't be named by a decision: they pass the stages that remove whole
documents by id, and are mixed like others.  Columns that the input has beside those of
documents pass all stages but the last, whatever their names.

Cases: an empty table passes all stages empty; null texts, and texts without letters, go in the
first stage; null languages aren't learned from, null sources are a source of their own (the
last); repeated rows are judged alike, and rows that share an id stay or go together where whole
documents are named by it; an empty benchmark, or null items, remove nothing; ties of
near-duplicates go to the smallest id; texts of any length are judged whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, langid, line_dedup, minhash, mixing
from tidemark.llm.common import bounded_batches, saved

#: Posterior of the predicted language under which a document is rejected.
MIN_SCORE = 0.5

#: No SQL expresses the language model, the sketches or the sampling; tests hold the stages against brute force.
ORACLE_SQL = None


def _free(name: str, docs: DataFrame) -> str:
    """The name, or a longer one that no column has."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or with no language that stands out, go; where no row has a language to learn from, only the former."""
    bounded_batches(spark)
    model = langid.fit(docs)
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    pred, score = _free("_lang_pred", docs), _free("_lang_score", docs)
    seen = langid.predict(docs, model, pred_col=pred, score_col=score)
    return seen.where((F.col(pred) != "und") & F.col(score).between(MIN_SCORE, 1)).drop(pred, score)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go, but where they are first; documents that were nothing else go."""
    counts = _free("_lines", docs)
    kept = line_dedup.remove_boilerplate(docs, counts_col=counts)
    some = (F.col(counts)["n_removed"] == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return kept.where(some).drop(counts).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that with the smallest id."""
    bounded_batches(spark)
    gone = minhash.components(docs, k=5, at_least=80).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(saved(gone, "near-duplicates"), "doc_id", "left_anti").select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, unchanged or edited, go."""
    bounded_batches(spark)
    gone = decontaminate.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id").distinct()
    return docs.join(saved(gone, "contaminated"), "doc_id", "left_anti").select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of each document in the mixture of sources."""
    return mixing.mix(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", lines),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
