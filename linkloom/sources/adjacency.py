"""Text formats of the click graph, its dictionaries and the web graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions import FIELD, ITEM, PART


def parse_adjacency(lines: DataFrame, node: str, other: str) -> DataFrame:
    """Edges ``(node INT, other INT, clicks BIGINT)`` of lines ``tag ^A id {^A id ^B clicks}``.

    Lines of fewer than three fields are skipped; a neighbour without ``^B`` is an error.
    """
    fields = F.split("value", FIELD)
    rows = lines.select(fields.alias("f")).filter(F.size("f") >= 3)
    rows = rows.select(F.col("f")[1].cast("int").alias(node), F.explode(F.slice("f", 3, F.size("f"))).alias("x")).filter("x <> ''")
    at = F.instr("x", ITEM)
    checked = F.when(at > 0, F.col("x")).otherwise(F.raise_error(F.concat(F.lit("neighbour without a click count: "), "x")))
    return rows.select(node, F.split(checked, ITEM).alias("x")).select(node, F.col("x")[0].cast("int").alias(other), F.col("x")[1].cast("bigint").alias("clicks"))


def query_side(lines: DataFrame) -> DataFrame:
    """``q, a, clicks`` of query-side adjacency lines."""
    return parse_adjacency(lines, "q", "a").select("q", "a", "clicks")


def ad_side(lines: DataFrame) -> DataFrame:
    """``q, a, clicks`` of ad-side adjacency lines."""
    return parse_adjacency(lines, "a", "q").select("q", "a", "clicks")


def render_adjacency(edges: DataFrame, tag: str, node: str, other: str) -> DataFrame:
    """Adjacency lines of ``node, other, clicks`` edges, neighbours ascending."""
    lists = edges.groupBy(node).agg(F.array_sort(F.collect_list(F.struct(other, "clicks"))).alias("xs"))
    joined = F.array_join(F.transform("xs", lambda x: F.concat(x[other].cast("string"), F.lit(ITEM), x["clicks"].cast("string"))), FIELD)
    return lists.select(F.concat_ws(FIELD, F.lit(tag), F.col(node).cast("string"), joined).alias("value"))


def render_dictionary(words: DataFrame, tag: str) -> DataFrame:
    """Dictionary lines of ``qid, norm_key, f, p`` rows."""
    return words.select(F.concat_ws(FIELD, F.lit(tag), F.col("qid").cast("string"), F.concat_ws(PART, "norm_key", "f", "p")).alias("value"))


def render_normalised(keys: DataFrame, tag: str) -> DataFrame:
    """Lines of ``norm_key, raw_key`` rows."""
    return keys.select(F.concat_ws(FIELD, F.lit(tag), "norm_key", "raw_key").alias("value"))


def render_web_graph(links: DataFrame) -> DataFrame:
    """Web-graph lines of ``src, dst, weight`` rows; a node alone where ``dst`` is null."""
    return links.select(F.when(F.col("dst").isNull(), F.col("src")).otherwise(F.concat("src", F.lit(" -> "), "dst", F.lit(" "), F.col("weight").cast("string"))).alias("value"))


def parse_dictionary(lines: DataFrame) -> DataFrame:
    """``qid, norm_key, f, p`` of lines ``tag ^A id ^A norm ^C f ^C p``; others are skipped."""
    rows = lines.select(F.split("value", FIELD, -1).alias("f")).filter(F.size("f") == 3)
    rows = rows.select(F.col("f")[1].cast("int").alias("qid"), F.split(F.col("f")[2], PART, -1).alias("k")).filter(F.size("k") == 3)
    return rows.select("qid", F.col("k")[0].alias("norm_key"), F.col("k")[1].alias("f"), F.col("k")[2].alias("p"))


def parse_normalised(lines: DataFrame) -> DataFrame:
    """``norm_key, raw_key`` of lines ``tag ^A norm ^A raw``; lines with an empty raw key are skipped."""
    rows = lines.select(F.split(F.rtrim(F.col("value"), F.lit(FIELD)), FIELD, -1).alias("f")).filter(F.size("f") == 3)
    return rows.select(F.col("f")[1].alias("norm_key"), F.col("f")[2].alias("raw_key"))


def parse_web_graph(lines: DataFrame) -> DataFrame:
    """``src, dst, weight`` of lines ``url -> url weight``; ``dst`` null for a node alone.

    After the arrow the url ends at the first space, if all that follows is a number;
    else the url is all of it and the weight 1.
    """
    line = F.trim("value")
    at = F.instr(line, "->")
    right = F.trim(F.substring(line, at + 2, F.length(line)))
    gap = F.instr("right", " ")
    rows = lines.filter(line != "").select(F.when(at > 0, F.trim(F.substring(line, F.lit(1), at - 1))).otherwise(line).alias("src"), F.when(at > 0, right).alias("right"))
    number = F.when(gap > 0, F.trim(F.substring("right", gap + 1, F.length("right"))).try_cast("double"))
    dst: Column = F.when(number.isNotNull(), F.substring("right", F.lit(1), gap - 1)).otherwise(F.col("right"))
    return rows.select("src", dst.alias("dst"), F.coalesce(number, F.lit(1.0)).alias("weight"))


def adjacency_arrays(edges: DataFrame, node: str, other: str) -> DataFrame:
    """``id, neighbours``: ascending arrays of neighbour ids, without weights."""
    return edges.groupBy(F.col(node).alias("id")).agg(F.array_sort(F.collect_set(other)).alias("neighbours"))
