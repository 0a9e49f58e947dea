"""Iterated similarity of both sides of a click graph, and the whole pipeline.

Similarities are half stored: entries i >= j. Each update ends in a written
table, so plans stay short and lost executors cost no more than one step.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.config import Params
from linkloom.operators import evidence, matrix, scoring, weights
from linkloom.operators.matrix import SLICE_ROWS
from linkloom.storage import stage


def first_step(p: DataFrame, params: Params, slice_rows: int | None = SLICE_ROWS) -> DataFrame:
    """decay * P'P with unit diagonal: the update from the identity."""
    return matrix.self_product(p, params.threshold, params.decay, params.prune, True, params.float32_scores, slice_rows)


def next_step(similar: DataFrame, p: DataFrame, params: Params, slice_rows: int | None = SLICE_ROWS) -> DataFrame:
    """decay * (S P)' P with unit diagonal, S the half-stored similarity of the other side."""
    m = matrix.product(similar, p, params.threshold, 1.0, params.prune, expand_a=True, float32=params.float32_scores, slice_rows=slice_rows)
    if params.prune == "sum":  # read more than once
        m = stage(m, "half-step")
    return matrix.product(m, p, params.threshold, params.decay, params.prune, transpose_a=True, lower=True, unit_diagonal=True, float32=params.float32_scores, slice_rows=slice_rows)


def iterate(a2q: DataFrame, q2a: DataFrame, params: Params = Params(), slice_rows: int | None = SLICE_ROWS) -> tuple[DataFrame, DataFrame]:
    """Similarities ``(queries, ads)`` of the ads-by-queries and queries-by-ads weights.

    In place, n iterations update each side n - 1 times, ads first; otherwise both
    sides are updated n times from the round before. The newest values are returned.
    """

    def step(other: DataFrame | None, p: DataFrame, name: str) -> DataFrame:
        out = first_step(p, params, slice_rows) if other is None else next_step(other, p, params, slice_rows)
        return stage(out, name)

    queries = ads = None
    if params.in_place:
        ads = step(None, q2a, "similar-ads")
        for k in range(1, params.iterations):
            queries = step(ads, a2q, "similar-queries")
            if k < params.iterations - 1:
                ads = step(queries, q2a, "similar-ads")
    else:
        for _ in range(params.iterations):
            queries, ads = step(ads, a2q, "similar-queries"), step(queries, q2a, "similar-ads")
    return queries, ads


@dataclass
class Result:
    """Staged tables of a run."""

    a2q: DataFrame
    q2a: DataFrame
    queries: DataFrame
    ads: DataFrame
    scores: DataFrame


def similar_queries(edges: DataFrame, params: Params = Params(), slice_rows: int | None = SLICE_ROWS) -> Result:
    """Click edges ``q, a, clicks`` to scores ``i, j, v`` of query pairs, with evidence.

    Evidence counts all edges, also those below the click threshold, and is looked up
    for the pairs that have a score only.
    """
    edges = stage(edges.select("q", "a", "clicks"), "edges")
    a2q, q2a = weight_pair(weights.filter_clicks(edges, params.min_clicks))
    queries, ads = iterate(a2q, q2a, params, slice_rows)
    pairs = queries.filter("i <> j").select(F.least("i", "j").alias("q1"), F.greatest("i", "j").alias("q2"))
    scores = scoring.with_evidence(queries, evidence.evidence_for(pairs, edges), params.evidence_default)
    return Result(a2q, q2a, queries, ads, stage(scores, "scores"))


def weight_pair(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The ads-by-queries and the queries-by-ads weights, from one written table."""
    both = stage(weights.both_weights(edges), "weights")
    return both.select(F.col("a").alias("i"), F.col("q").alias("j"), F.col("a2q").alias("v")), both.select(F.col("q").alias("i"), F.col("a").alias("j"), F.col("q2a").alias("v"))


def ranked_lines(scores: DataFrame, texts: DataFrame, number: str | None = None) -> DataFrame:
    """``qid, value``: output lines of queries with their similar queries, best first."""
    texts = stage(texts, "texts")
    return scoring.final_lines(scoring.ranked_lists(scoring.with_text(scores, texts), number), texts)
