"""Corpus pipeline: quality, near-duplicates, repeated passages, mixing, packing.

Each stage works on all that the one before kept. Stages but the last return the
columns of ``documents``, also those that the stages do not know. Texts of any length are
read whole, and an empty table passes as an empty table. Results of the stages but the
last go once the next one is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from linkloom.llm import cotraining, mixing, packing, similar, substrings
from linkloom.llm.common import stage, table, unstage
from linkloom.llm.queries import BYTE_BPE


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the co-trained classifier rejects.

    Null texts are empty; without labels of both classes all documents stay. Repeated rows are judged one by one.
    """
    return cotraining.score(docs, table(spark, sf_dir, "labels")).filter("kept").select(*docs.columns)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, the document of smallest id.

    Texts without words are duplicates of each other; rows without id stay, as do rows of one id whose texts differ.
    """
    return similar.keep_first(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that earlier documents, or earlier lines, hold.

    Documents that lose all their text go; null and empty texts lose nothing and stay.
    """
    return substrings.without_repeats(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as a mix with weights 1, 2, 3 and at most three epochs takes them.

    Null sources are one source; a source without words takes nothing.
    """
    return mixing.mixed_documents(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of 1024 tokens.

    A null or empty text is one piece, its end id; repeated rows are packed once each.
    """
    return packing.pack(docs, BYTE_BPE, end_id=2)


STAGES = [
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", simhash_near_dedup),
    ("suffix-array dedup", suffix_array_dedup),
    ("mixing sources", source_mixing),
    ("best-fit packing", best_fit_packing),
]

#: SQL has neither the tokenizer nor the classifier; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, function) in enumerate(STAGES):
        after = stage(function(spark, docs, sf_dir), f"pipeline-{k}")
        unstage(docs)
        docs = after
    return docs
