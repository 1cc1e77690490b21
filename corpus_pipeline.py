"""Corpus pipeline: quality classifier, near duplicates, decontamination, secret redaction, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobatlas.llm.common import read_table, release_earlier, row_key, save
from jobatlas.llm.decontaminate import benchmark_matches
from jobatlas.llm.jaccard_join import jaccard_keepers
from jobatlas.llm.packing import pack
from jobatlas.llm.quality_classifier import quality_scores
from jobatlas.llm.secret_scan import redact_secrets

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be good."""
    release_earlier(spark, docs)
    scores = quality_scores(docs.withColumn("row", row_key()), read_table(spark, sf_dir, "labels"), carry=("row",))
    return _keep(docs, scores.where("predicted = 1").select("row"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies, that of the smallest id: five-word shingles, similarity 0.8 or more."""
    release_earlier(spark, docs)
    keepers = jaccard_keepers(docs, width=5, percent=80)
    keepers = save(keepers.select(row_key(F.col("text_key")).alias("row"), "copies"))
    repeated = _keep(docs, keepers.where("copies > 1").select("row")).dropDuplicates(["doc_id", "text"])
    return _keep(docs, keepers.where("copies = 1").select("row")).unionByName(repeated)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark passage."""
    release_earlier(spark, docs)
    found = benchmark_matches(docs.select(row_key().alias("doc_id"), "text"), read_table(spark, sf_dir, "benchmark"))
    return _keep(docs, found.where("spans is null").select(F.col("doc_id").alias("row")))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a marker; n_chars follows the text."""
    release_earlier(spark, docs)
    return redact_secrets(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences with their places."""
    release_earlier(spark, docs)
    return pack(docs)


def _keep(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose key of id and text is among ``rows``; ids may be null or repeated."""
    return docs.withColumn("row", row_key()).join(rows.distinct(), "row", "left_semi").select(*COLUMNS)


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality),
    ("near duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("secret redaction", secrets),
    ("packing", packing),
]

#: Classifier and tokenizer have no SQL form; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and reread."""
    docs = read_table(spark, sf_dir, "documents").select(*COLUMNS)
    for _, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
