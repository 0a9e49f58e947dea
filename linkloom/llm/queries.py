"""One query per training-data operator, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cotraining, licenses, mixing, outliers, packing, simhash, substrings, tokens, topk, urls
from .common import table

RULES = [
    urls.Rule("com", "/en/", True),
    urls.Rule("example.com", "/en/7", False),
    urls.Rule("net", "/de/", False),
    urls.Rule("example.net", "/de/8", True),
    urls.Rule("org", "/es/", True),
]
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the bytes that 100-byte strings repeat from earlier."""
    return substrings.removed(table(spark, sf_dir, "documents"), kept=False)


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best inner products of every 50th vector with all others."""
    return topk.top_k_of_table(table(spark, sf_dir, "embeddings"), every=50, k=5)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents (end id 2) packed into sequences of at most 1024 tokens.

    The limits on documents and attention cost are those that 1024 tokens imply.
    """
    return packing.pack(table(spark, sf_dir, "documents"), BYTE_BPE, end_id=2)


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents (end id 0), as read back from the files."""
    return tokens.read_tokens(tokens.write_tokens(table(spark, sf_dir, "documents"), BYTE_BPE, end_id=0))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of the base rules and of the robust outlier test for every document."""
    out = outliers.quality_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprint and component of near-duplicates of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of the rules, or else of the path-template tree, on every page."""
    return urls.filter_urls(table(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in all documents: 32 bands, containment of 0.8."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix with weights 1, 2, 3 and at most three epochs takes of every document."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Co-trained quality score and verdict of every document, fitted on ``labels.quality``."""
    found = cotraining.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select(F.col("doc_id").cast("long"), "quality_score", "kept")


def vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed where every limit binds: 1024 tokens, 4 documents, and the attention cost of 640 tokens in one piece."""
    return packing.pack(table(spark, sf_dir, "documents"), BYTE_BPE, end_id=2, shape=packing.Bin(documents=4, attention=640 * 640, weights=(1.0, 0.5, 0.5)))


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and target of every source of operator 9."""
    sizes = table(spark, sf_dir, "documents").groupBy(F.col("source").cast("string").alias("source")).agg(F.sum(mixing.word_count()).alias("source_size"))
    return mixing.source_targets(sizes, (1, 2, 3), 3).withColumn("target", F.round("target", 3))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_exact_top_k": op2_exact_top_k,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_token_output": op4_token_output,
    "op5_quality_rules": op5_quality_rules,
    "op6_simhash_groups": op6_simhash_groups,
    "op7_url_filter": op7_url_filter,
    "op8_license_scan": op8_license_scan,
    "op9_source_mix": op9_source_mix,
    "op10_quality_classifier": op10_quality_classifier,
    "vector_packing": vector_packing,
    "mix_targets": mix_targets,
}

ORACLES: dict[str, str] = {
    "op2_exact_top_k": """
        WITH e AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
            FROM embeddings
            WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, e.vec_id AS vec_id, CAST(list_inner_product(q.v, e.v) AS BIGINT) AS score
            FROM e AS q JOIN e ON q.vec_id % 50 = 0 AND q.vec_id <> e.vec_id
        ), r AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s
        )
        SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM r WHERE k <= 5
    """,
    "mix_targets": mixing.oracle(),
    "op1_suffix_dedup": substrings.oracle(),
    "op5_quality_rules": outliers.oracle(),
    "op7_url_filter": urls.oracle(RULES),
    "op8_license_scan": licenses.oracle(),
}
