"""Operator 7: URL filter by rules and a path-template tree (DataFrame functions only).

Rules decide the urls they fit, and label them. For the rest a tree of path
templates is grown per host, one level of segments at a time: frequent segments
stay branches, the rest become the wildcard ``*``, and branches of one node whose
labelled shares do not differ significantly are merged into ``+``. A template
is blocked if the smoothed labelled share of blocked urls in it is high enough.
Every level is a partial aggregate by (host, template, segment) and a join with
the branches that stay, of which a node has at most ``1 / share``.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage, unstage


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    block: bool

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def verdict(self) -> str:
        return "block" if self.block else "allow"


@dataclass(frozen=True)
class Tree:
    """``support`` and ``share``: least pages and least part of its node that make a segment a
    branch. ``labelled``: least labelled pages of a branch that is tested; ``z2``: square of the
    largest deviation, in standard deviations, of a branch that is merged. ``prior`` and
    ``strength``: share of blocked urls assumed, and for how many labelled ones it counts.
    ``purity``: least smoothed share that blocks. The tree has as many levels as ``support``
    pages have segments, for deeper ones cannot have a branch."""

    support: int = 5
    share: float = 0.01
    labelled: int = 5
    z2: float = 3.84
    prior: float = 0.1
    strength: float = 4.0
    purity: float = 0.5


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path; both empty for null and for urls without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), path


def matched_rule(rules: list[Rule], host: Column, path: Column) -> Column:
    """Place in ``rules`` of the longest that fits, or null; among equally long the first name."""
    out = F.lit(None).cast("int")
    for i, rule in sorted(enumerate(rules), key=lambda x: (len(x[1].name), [-ord(c) for c in x[1].name])):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        out = F.when(fits, F.lit(i)).otherwise(out)
    return out


def _sums() -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), F.count("label").alias("known"), F.coalesce(F.sum("label"), F.lit(0)).alias("bad")]


def _branches(pages: DataFrame, tree: Tree) -> DataFrame:
    """``host, template, seg, branch``: the segments that stay branches of their node."""
    children = pages.groupBy("host", "template", "seg").agg(*_sums())
    nodes = children.groupBy("host", "template").agg(F.sum("n").alias("all"))
    strong = children.filter((F.col("n") >= tree.support) & F.col("seg").isNotNull()).join(nodes, ["host", "template"]).filter(F.col("n") >= tree.share * F.col("all"))
    strong = stage(strong, "url-branches")
    tested = strong.filter(F.col("known") >= tree.labelled)
    pools = tested.groupBy("host", "template").agg(F.sum("known").alias("pool_known"), F.sum("bad").alias("pool_bad"), F.count(F.lit(1)).alias("tested"))
    joined = strong.join(pools, ["host", "template"], "left")
    d = lambda c: F.col(c).cast("double")
    gap = d("bad") * d("pool_known") - d("known") * d("pool_bad")
    alike = gap * gap <= F.lit(tree.z2) * d("known") * d("pool_bad") * (d("pool_known") - d("pool_bad"))
    merged = F.coalesce((F.col("known") >= tree.labelled) & (F.col("tested") > 1) & alike, F.lit(False))
    return joined.select("host", "template", "seg", F.when(merged, F.lit("+")).otherwise(F.concat(F.lit("="), "seg")).alias("branch"))


def filter_urls(pages: DataFrame, rules: list[Rule], tree: Tree = Tree(), labels: DataFrame | None = None) -> DataFrame:
    """``page_id, host, path, rule, template, purity, verdict`` of every row of ``pages``.

    Labels are what the rules decide, and those of ``labels`` (``page_id, block`` 0 or 1, the
    greater of several) for other pages, whose verdict is the tree's all the same. Empty segments are skipped; a path that ends
    before a level ends its template there; segments below the last level count as
    one wildcard. Urls without host form templates of the empty host like any
    other. Templates without labelled urls have the prior's purity. Null urls have neither host
    nor path; urls of any length are read whole; repeated rows count and are judged one by
    one. An empty table gives no rows; other columns play no part.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("rule_no", matched_rule(rules, F.col("host"), F.col("path")))
    label = F.lit(None).cast("int")
    name = F.lit(None).cast("string")
    for i, rule in enumerate(rules):
        label = F.when(F.col("rule_no") == i, F.lit(int(rule.block))).otherwise(label)
        name = F.when(F.col("rule_no") == i, F.lit(rule.name)).otherwise(name)
    rows = rows.withColumns({"ruled": label, "rule": name, "template": F.lit("")})
    if labels is not None:
        given = labels.filter("page_id is not null and block is not null").groupBy(F.col("page_id").cast("long").alias("page_id")).agg(F.max(F.col("block").cast("int")).alias("given"))
        rows = rows.join(given, "page_id", "left")
    rows = rows.withColumn("label", F.coalesce("ruled", "given") if labels is not None else F.col("ruled")).drop("rule_no", "given")
    rows = stage(rows, "urls")
    segments = F.filter(F.split("path", "/", -1), lambda x: x != "")
    level, before = 0, rows
    while rows.filter(F.size(segments) > level).limit(tree.support).count() == tree.support:
        open_ = rows.withColumn("seg", F.get(segments, F.lit(level)))
        branches = stage(_branches(open_.filter("seg is not null"), tree), "url-tree")
        step = F.when(F.col("seg").isNotNull(), F.concat(F.lit("/"), F.coalesce("branch", F.lit("*")))).otherwise(F.lit(""))
        rows = open_.join(branches, ["host", "template", "seg"], "left").withColumn("template", F.concat("template", step)).select(*rows.columns)
        after = stage(rows, "urls-level")
        unstage(before, branches)
        before = rows = after
        level += 1
    deeper = F.when(F.size(segments) > level, F.concat("template", F.lit("/**"))).otherwise(F.col("template"))
    rows = rows.withColumn("template", deeper)
    found = rows.groupBy("host", "template").agg(*_sums())
    purity = (F.col("bad") + F.lit(tree.prior * tree.strength)) / (F.col("known") + F.lit(tree.strength))
    # Written, so that Spark can split a hot host on the other side of the join.
    found = stage(found.select("host", "template", purity.alias("purity")), "url-templates")
    of_rule = F.when(F.col("ruled") == 1, F.lit("block")).when(F.col("ruled") == 0, F.lit("allow"))
    of_tree = F.when(F.col("purity") >= tree.purity, F.lit("block")).otherwise(F.lit("allow"))
    return rows.join(found, ["host", "template"]).select("page_id", "host", "path", "rule", "template", "purity", F.coalesce(of_rule, of_tree).alias("verdict"))


def oracle(rules: list[Rule], tree: Tree = Tree(), levels: int = 8) -> str:
    """The same as ``filter_urls`` in DuckDB SQL, written independently of it, over ``pages``.

    Written out for ``levels`` levels: an error where ``tree.support`` pages have more segments.
    """
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    fits = " UNION ALL ".join(
        f"SELECT page_id, url, {quote(r.name)} AS rule, {int(r.block)} AS label FROM split WHERE (host = {quote(r.host)} OR ends_with(host, {quote('.' + r.host)})) AND starts_with(path, {quote(r.path)})" for r in rules
    )
    sql = f"""
    WITH cut AS (
        SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
    ), split AS (
        SELECT DISTINCT page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host,
               regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
    ), fits AS ({fits}
    ), best AS (
        SELECT page_id, url, arg_max(rule, length(rule)) AS rule, arg_max(label, length(rule)) AS label FROM fits GROUP BY page_id, url
    ), l0 AS (
        SELECT s.page_id, s.host, s.path, b.rule, b.label, '' AS template, list_filter(string_split(s.path, '/'), lambda x: x <> '') AS segs
        FROM split AS s LEFT JOIN best AS b ON s.page_id = b.page_id AND s.url IS NOT DISTINCT FROM b.url
    ), sizes AS (
        SELECT row_number() OVER (ORDER BY len(segs) DESC) AS k, len(segs) AS n FROM l0
    ), deep AS (
        SELECT CASE WHEN coalesce(max(n), 0) > {levels} THEN error('more levels are needed') ELSE coalesce(max(n), 0) END AS depth FROM sizes WHERE k = {tree.support}
    )"""
    for k in range(levels):
        sql += f""", c{k} AS (
        SELECT host, template, segs[{k + 1}] AS seg, count(*) AS n, count(label) AS known, coalesce(sum(label), 0) AS bad
        FROM l{k}, deep WHERE segs[{k + 1}] IS NOT NULL AND depth > {k} GROUP BY ALL
    ), s{k} AS (
        SELECT * FROM (SELECT *, sum(n) OVER (PARTITION BY host, template) AS everything FROM c{k})
        WHERE n >= {tree.support} AND n >= {tree.share}::DOUBLE * everything
    ), p{k} AS (
        SELECT host, template, sum(known)::DOUBLE AS pk, sum(bad)::DOUBLE AS pb, count(*) AS tested FROM s{k} WHERE known >= {tree.labelled} GROUP BY ALL
    ), b{k} AS (
        SELECT s.host, s.template, s.seg, CASE WHEN s.known >= {tree.labelled} AND p.tested > 1
            AND (s.bad * p.pk - s.known * p.pb) * (s.bad * p.pk - s.known * p.pb) <= {tree.z2}::DOUBLE * s.known * p.pb * (p.pk - p.pb)
            THEN '+' ELSE '=' || s.seg END AS branch
        FROM s{k} AS s LEFT JOIN p{k} AS p USING (host, template)
    ), l{k + 1} AS (
        SELECT l.page_id, l.host, l.path, l.rule, l.label, l.segs,
               l.template || CASE WHEN l.segs[{k + 1}] IS NULL OR depth <= {k} THEN '' ELSE '/' || coalesce(b.branch, '*') END AS template
        FROM l{k} AS l CROSS JOIN deep LEFT JOIN b{k} AS b ON l.host = b.host AND l.template = b.template AND l.segs[{k + 1}] = b.seg
    )"""
    return sql + f""", leaf AS (
        SELECT * REPLACE (CASE WHEN len(segs) > depth THEN template || '/**' ELSE template END AS template) FROM l{levels}, deep
    ), score AS (
        SELECT host, template, (coalesce(sum(label), 0) + {tree.prior * tree.strength}::DOUBLE) / (count(label) + {tree.strength}::DOUBLE) AS purity FROM leaf GROUP BY ALL
    )
    SELECT page_id, host, path, rule, CASE label WHEN 1 THEN 'block' WHEN 0 THEN 'allow' ELSE CASE WHEN purity >= {tree.purity} THEN 'block' ELSE 'allow' END END AS verdict
    FROM leaf JOIN score USING (host, template)
    """
