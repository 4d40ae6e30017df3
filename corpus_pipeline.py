"""The training-data pipeline: stages over ``documents``, each written as Parquet and reread as the next one's input.

Every stage but the last returns the columns of ``documents``; the last returns the kept documents' ids with their pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from annolith.llm import mixing, quality_forest, secret_scan, sentencepiece_codec, simhash_dedup
from annolith.llm.queries import PIECES, table
from annolith.llm.shared import written


#: Multiples of the tokens that a domain has before mixing; the others share the rest, so that clean documents stay.
TARGETS = {"toxic": 0.3}


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the isolation forest rejects go.

    Null, empty and blank texts go; null ids and other nulls don't matter. Repeated rows, ties in the score and texts of any
    length are judged by the same threshold, each row by itself. Without documents the result is empty, without labels nothing
    but blank texts goes. Further columns stay, whatever their names.
    """
    return quality_forest.keep_good(docs, quality_forest.train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays: the one of the least id.

    Rows without an id and texts without words (null, empty) stay. Rows that share an id are one document and stay or go
    together, repeated rows included, so there are no ties. Texts of any length are compared whole. An empty table gives an empty one.
    Further columns stay.
    """
    return simhash_dedup.keep_one(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; secrets in them are redacted, and ``n_chars`` of changed texts is brought up to date.

    Null and empty texts stay as they are; repeated rows are redacted alike; overlapping secrets (ties in place) are cut out
    as one. Long texts are scanned whole. An empty table gives an empty one. Further columns stay.
    """
    return secret_scan.redact(docs)


def target_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are taken as often as their fitted rates say, none or several times, so that ``TARGETS`` are met.

    Null and empty texts have the rate of the classifier's bias; a null id draws as id 0. Repeated rows (ties) are taken
    equally often. Texts count with all their tokens. An empty table gives an empty one; without labels all posteriors, and so all
    rates, are the same. Further columns stay.
    """
    return mixing.mix(docs, table(spark, sf_dir, "labels"), TARGETS, relative=True)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and piece ids of all documents, a row a row, repeated rows too.

    A null text has null pieces, an empty one none; null ids stay null. Of segmentations that tie, the one found first counts.
    Texts are encoded whole. An empty table gives an empty result. Further columns are left out.
    """
    return sentencepiece_codec.encode(docs, PIECES, keep_cols=["doc_id"])


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_duplicates),
    ("secret_scans", secrets),
    ("target_weight_mixing", target_mix),
    ("sentencepiece", pieces),
]

ORACLE_SQL = None  # a random forest, gradient descent and Viterbi are beyond SQL; tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
