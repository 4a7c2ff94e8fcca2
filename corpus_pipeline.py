"""A corpus from raw documents: quality, exact copies, near copies, repeated passages, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinspark.llm import exact_dedup, lm_score, ngram_join, packing, quality, suffix_dedup
from twinspark.llm.shared import read_table, shared_folder


#: Bytes that repeated passages have at least: about 50 words.
PASSAGE = 256


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject.

    Each row is judged by its text alone, so equal texts stay or go together; null counts as
    empty.  An empty table gives an empty one.
    """
    scored = quality.score_quality(docs, read_table(spark, sf_dir, "labels"), ~lm_score.sampled_out("doc_id", 5, 0))
    return scored.where("predicted = 1").select(*docs.columns)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group whose texts are equal but for white space.

    Rows that repeat, share an id or have none are told apart by a number of their own; null,
    empty and blank texts are one group.
    """
    return exact_dedup.keep_first_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies; rows are told apart as above, and texts without words all stay."""
    return ngram_join.keep_one_of_each(docs)


def without_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of PASSAGE bytes or more that occur anywhere else; those left blank go.

    Null and empty texts go with them.  The stages before leave no row that repeats another's text
    of five words or more, so no document is emptied for its own copy.
    """
    cut = suffix_dedup.without_passages(docs, length=PASSAGE)
    return cut.where(F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: a row for each piece of a document; every row is packed, repeated and null ones too."""
    return packing.packer()(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("passage_dedup", without_passages),
    ("packing", packed),
]

#: The first stage is a trained model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn, each result written as Parquet in the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = shared_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
