"""A corpus pipeline: each stage reads what the one before it kept.

Every stage is written as Parquet under the shared folder and read again, so a lost
executor never takes more than one stage's work with it.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from wattline.llm import exact, mixing, neardup, packing, quality
from wattline.llm.common import table
from wattline.sources.sinks import stage

# Rows that a Python worker receives at once: texts may be long, and a worker holds a few copies.
BATCH_ROWS = 1_000


def small_batches(function):
    """A stage whose session sends Python workers ``BATCH_ROWS`` rows at a time."""

    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
        return function(spark, docs, sf_dir)

    return run_stage


@small_batches
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose lines are mostly good.

    Null and empty texts have the score of one empty line and go or stay with it; repeated rows are
    scored each; without labels every score is a half, which keeps all; an empty table stays empty.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


@small_batches
def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents whose text, white space aside, one with a smaller id has.

    Null counts as empty, so of all null and empty texts one stays; texts of white space only are
    one space; a missing id sorts after all others; of rows that repeat id and text one stays; an
    empty table stays empty.
    """
    return exact.drop_exact_copies(docs)


@small_batches
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near copies.

    Texts without words, null ones too, are near to nothing and all stay; rows that repeat an id stay
    or go together; rows without an id stay; an empty table stays empty.
    """
    return neardup.drop_near_copies(docs)


@small_batches
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources ask for.

    Rows without a source are one source of their own; texts without words add nothing to any
    target and are taken once; repeated rows are taken each; an empty table stays empty.
    """
    return mixing.repeat(docs)


@small_batches
def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces of the mixed documents in sequences.

    A null or empty text is one piece that holds the end token; repeated rows are packed each;
    an empty table has no pieces.
    """
    # An executor's workers take turns, and earlier stages needed more of them than cores.
    return packing.pack(docs, keep=False)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("best_fit_packing", best_fit_packing),
]

# Trained models and iterations have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last one's rows."""
    docs = table(spark, sf_dir, "documents")
    for _, function in STAGES:
        docs = stage(function(spark, docs, sf_dir))
    return docs
