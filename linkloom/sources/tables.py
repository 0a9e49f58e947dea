"""The click graph, dictionaries and web graph of the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def click_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``q, a, clicks``: customers, parts, and the lines of orders that join them."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").cast("int").alias("q"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").cast("int").alias("a"))
    return orders.join(lines, orders.o_orderkey == lines.l_orderkey).groupBy("q", "a").agg(F.count(F.lit(1)).alias("clicks"))


CLICKS_SQL = "clicks AS (SELECT CAST(o_custkey AS INT) AS q, CAST(l_partkey AS INT) AS a, count(*) AS clicks FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2)"


def query_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``qid, norm_key, f, p``: customers with segment, nation and region; every tenth segment is empty."""
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    region = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    joined = customer.join(nation, customer.c_nationkey == nation.n_nationkey).join(region, nation.n_regionkey == region.r_regionkey)
    norm = F.when(F.col("c_custkey") % 10 == 0, F.lit("")).otherwise(F.col("c_mktsegment"))
    return joined.select(F.col("c_custkey").cast("int").alias("qid"), norm.alias("norm_key"), F.col("n_name").alias("f"), F.col("r_name").alias("p"))


def normalised_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``norm_key, raw_key``: all segments but one, with their lower-case form."""
    keys = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("norm_key")).distinct()
    return keys.filter("norm_key <> 'MACHINERY'").select("norm_key", F.lower("norm_key").alias("raw_key"))


DICTIONARY_SQL = """dictionary AS (
    SELECT CAST(c_custkey AS INT) AS qid, CASE WHEN c_custkey % 10 = 0 THEN '' ELSE c_mktsegment END AS norm_key, n_name AS f, r_name AS p
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
), normalised AS (
    SELECT DISTINCT c_mktsegment AS norm_key, lower(c_mktsegment) AS raw_key FROM customer WHERE c_mktsegment <> 'MACHINERY'
)"""


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``src, dst, weight``: each page links to that of half its id."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    to = pages.select(F.col("page_id").alias("to_id"), F.col("url").alias("dst"))
    weight = (1 + F.col("page_id") % 5).cast("double")
    return pages.join(to, F.floor(pages.page_id / 2) == to.to_id).select(F.col("url").alias("src"), "dst", weight.alias("weight"))


LINKS_SQL = "links AS (SELECT a.url AS src, b.url AS dst, CAST(1 + a.page_id % 5 AS DOUBLE) AS weight FROM pages AS a JOIN pages AS b ON a.page_id // 2 = b.page_id)"
