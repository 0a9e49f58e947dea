"""Scores with evidence, normalisation, and ranked lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.functions import FIELD, ITEM, NO_TEXT, PART
from linkloom.operators.matrix import _both_ways


def with_evidence(scores: DataFrame, evidence: DataFrame, default: float = 0.48) -> DataFrame:
    """``i, j, v`` off the diagonal, each score times the evidence of the unordered pair.

    Pairs without evidence use ``default``; evidence without a score is dropped.
    """
    pairs = scores.filter("i <> j").select("i", "j", "v", F.least("i", "j").alias("q1"), F.greatest("i", "j").alias("q2"))
    joined = pairs.join(evidence.select("q1", "q2", "e"), ["q1", "q2"], "left")
    return joined.select("i", "j", (F.col("v") * F.coalesce("e", F.lit(default))).alias("v"))


def merge_evidence(scores: DataFrame, evidence: DataFrame) -> DataFrame:
    """As ``with_evidence`` with the fixed default 0.5 and with the diagonal, which has no evidence."""
    pairs = scores.select("i", "j", "v", F.least("i", "j").alias("q1"), F.greatest("i", "j").alias("q2"))
    joined = pairs.join(evidence.select("q1", "q2", "e"), ["q1", "q2"], "left")
    return joined.select("i", "j", (F.col("v") * F.coalesce("e", F.lit(0.5))).alias("v"))


def mirrored(scores: DataFrame) -> DataFrame:
    """Each off-diagonal entry in both orders; the diagonal is dropped."""
    return _both_ways(scores.filter("i <> j"), F.lit(True))


def normalised(scores: DataFrame, mirror: bool = True) -> DataFrame:
    """Scores of a row divided by the largest of the row."""
    rows = mirrored(scores) if mirror else scores
    return rows.withColumn("v", F.col("v") / F.max("v").over(Window.partitionBy("i")))


def query_text(dictionary: DataFrame, normalised_keys: DataFrame) -> DataFrame:
    """``qid, text``: key, raw key if known, and the two attributes, parted by ``^C``.

    An empty key looks nothing up. Of several raw keys of one key the greatest
    counts, of several rows of one query the smallest text.
    """
    raw = normalised_keys.filter("norm_key <> ''").groupBy("norm_key").agg(F.max("raw_key").alias("raw_key"))
    joined = dictionary.join(raw, "norm_key", "left")
    text = F.concat_ws(PART, "norm_key", "raw_key", "f", "p")
    return joined.groupBy("qid").agg(F.min(text).alias("text"))


def with_text(scores: DataFrame, texts: DataFrame) -> DataFrame:
    """``i, j, v, text``: mirrored scores with the text of j; unknown queries get a placeholder."""
    joined = mirrored(scores).join(texts.select(F.col("qid").alias("j"), "text"), "j", "left")
    return joined.select("i", "j", "v", F.coalesce("text", F.lit(NO_TEXT)).alias("text"))


def ranked_lists(scored: DataFrame, number: str | None = None, normalise: bool = True) -> DataFrame:
    """``qid, list``: per row the texts with their scores, best first, as ``{^A text ^B score}``.

    Scores are divided by the row's best, which prints as 1.0, unless ``normalise``
    is false. Ties go to the smaller neighbour. ``number`` is a printf format of
    the others; None prints doubles in full.
    """
    items = F.array_sort(F.collect_list(F.struct((-F.col("v")).alias("k"), "j", "text")))
    show = lambda c: F.format_string(number, c) if number else c.cast("string")

    def item(best: Column):
        def one(x: Column, n: Column) -> Column:
            score = F.when(n == 0, F.lit("1.0")).otherwise(show(x["k"] / best)) if normalise else show(-x["k"])
            return F.concat(F.lit(FIELD), x["text"], F.lit(ITEM), score)

        return one

    lists = scored.groupBy(F.col("i").alias("qid")).agg(items.alias("items"), F.min(-F.col("v")).alias("best"))
    return lists.select("qid", F.array_join(F.transform("items", item(F.col("best"))), "").alias("list"))


def final_lines(lists: DataFrame, texts: DataFrame) -> DataFrame:
    """``qid, value``: text of the query and its list, for queries that have both."""
    return lists.join(texts, "qid").select("qid", F.concat("text", "list").alias("value"))
