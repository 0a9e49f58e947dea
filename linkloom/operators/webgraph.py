"""A directed, weighted web graph as edges ``src, dst, weight`` and its nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.functions import host_of, path_of


def nodes(links: DataFrame) -> DataFrame:
    """``url, host, path`` of every url that occurs, nodes without links (``dst`` null) too."""
    urls = links.select(F.explode(F.array("src", "dst")).alias("url")).filter("url is not null").distinct()
    return urls.select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))


def add_links(links: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """One edge for each pair of urls, of the largest weight seen."""
    every = links if more is None else links.unionByName(more)
    return every.filter("dst is not null").groupBy("src", "dst").agg(F.max("weight").alias("weight"))


def degrees(links: DataFrame) -> DataFrame:
    """``url, n_in, n_out`` of every node."""
    ends = links.select(F.explode(F.array(F.struct(F.col("src").alias("url"), F.lit(0).alias("i"), F.col("dst").isNotNull().cast("int").alias("o")), F.struct(F.col("dst").alias("url"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e"))
    return ends.select("e.*").filter("url is not null").groupBy("url").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))


def out_links(links: DataFrame, url: str) -> DataFrame:
    return links.filter((F.col("src") == url) & F.col("dst").isNotNull()).select("dst", "weight")


def in_links(links: DataFrame, url: str) -> DataFrame:
    return links.filter(F.col("dst") == url).select("src", "weight")


def edge_weights(links: DataFrame, pairs: DataFrame) -> DataFrame:
    """``src, dst, weight`` for asked ``src, dst`` pairs; 0 where there is no edge."""
    return pairs.join(add_links(links), ["src", "dst"], "left").select("src", "dst", F.coalesce("weight", F.lit(0.0)).alias("weight"))


def symmetrised(links: DataFrame) -> DataFrame:
    """Both directions of every edge, each with the larger of the two weights."""
    one = F.struct("src", "dst")
    two = F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))
    both = links.filter("dst is not null").select(F.explode(F.array(one, two)).alias("e"), "weight")
    return both.groupBy("e.src", "e.dst").agg(F.max("weight").alias("weight"))


def without_internal(links: DataFrame) -> DataFrame:
    """Edges between different hosts."""
    return links.filter(F.col("dst").isNotNull() & (host_of(F.col("src")) != host_of(F.col("dst"))))


def without_stop_hosts(links: DataFrame, stop: DataFrame) -> DataFrame:
    """Edges that touch none of the hosts in ``stop`` (``host``)."""
    marked = links.filter("dst is not null").withColumns({"src_host": host_of(F.col("src")), "dst_host": host_of(F.col("dst"))})
    stop = stop.select(F.lower("host").alias("host"))
    kept = marked.join(stop, marked.src_host == stop.host, "left_anti").join(stop, F.col("dst_host") == stop.host, "left_anti")
    return kept.select("src", "dst", "weight")


def host_graph(links: DataFrame) -> DataFrame:
    """Edges between hosts, weights summed, without those inside a host."""
    hosts = without_internal(links).select(host_of(F.col("src")).alias("src"), host_of(F.col("dst")).alias("dst"), "weight")
    return hosts.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
