"""Corpus pipeline: quality classifier, language ID, near-duplicate removal, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept.

Cases, of all stages: columns of ``docs`` beyond those of ``documents`` are left out, whatever their names; an empty
table gives an empty one.  A null text is an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwick.llm import langid, near_dups, packing, quality, storage

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A text that takes more bits a byte than this under its language's model is in none of the languages; clean texts take 2 to 3.
MOST_BITS = 4.5
#: A text whose second language is as near as this, in bits a byte, is not in one language; clean texts are 0.3 or more apart.
LEAST_MARGIN = 0.02


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the quality classifier predicts as good.

    Rows that repeat an id are judged each by their own text; a null id is judged too.  An empty text has the score of the bias alone.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = quality.classify(docs.select(*COLUMNS), labels, keep=COLUMNS)
    return scored.where("predicted = 1").select(*COLUMNS)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that are in one of the learned languages: not far from its model, and not as near to another.

    Texts without a letter go, empty ones too.  Rows that repeat an id are judged each; a null id is judged too.  Without any labelled text all go.
    """
    found = langid.identify(docs.select(*COLUMNS), keep=COLUMNS)
    one = (F.col("bits_per_byte") <= MOST_BITS) & (F.col("margin_per_byte") >= LEAST_MARGIN)
    return found.where((F.col("lang_pred") != "und") & one).select(*COLUMNS)


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near-duplicates; documents without words all stay.

    Every row is a document: of rows with one id and equal texts one stays, and a null id comes after all others.
    """
    return near_dups.one_of_each(docs.select(*COLUMNS))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into training sequences: one row for each piece.  Rows that repeat an id are packed each; a null id is one like any other."""
    return packing.pack_documents(docs.select(*COLUMNS))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_stage),
    ("language_id", language_stage),
    ("near_dups", near_dup_stage),
    ("packing", packing_stage),
]

#: The stages train models, so SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = storage.materialise(docs, name)
    return docs
