"""Operator 9: mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stage, text_of

#: A level of buckets has this many bits of a row's key; keys have 63.
BUCKET_BITS = 12
#: Lowest bit of the buckets of each level: of the last, rows themselves are ordered.
LEVELS = (63 - BUCKET_BITS, 63 - 2 * BUCKET_BITS)


def word_count(column: str = "text") -> Column:
    return F.regexp_count(text_of(column), F.lit(WORD)).cast("long")


def _sums_before(rows: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Adds the sums of columns over all rows that come before in an order, whose keys differ.

    Rows are sorted in ranges; each range adds the sums of the ranges before it, of which
    there is one row for each core.
    """
    ranged = rows.repartitionByRange(rows.sparkSession.sparkContext.defaultParallelism, *order).sortWithinPartitions(*order)
    ranged = stage(ranged.withColumns({"range": F.spark_partition_id(), "nth": F.monotonically_increasing_id()}), "mix-ranges")
    inside = Window.partitionBy("range").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("range").agg(*[F.sum(c).alias(f"all_{name}") for name, c in sums.items()])
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("range", *[F.coalesce(F.sum(f"all_{name}").over(before), F.lit(0)).alias(f"base_{name}") for name in sums])
    out = ranged.withColumns({name: F.coalesce(F.sum(c).over(inside), F.lit(0)) for name, c in sums.items()}).join(F.broadcast(bases), "range")
    return out.select(*rows.columns, *[(F.col(name) + F.col(f"base_{name}")).alias(name) for name in sums])


def source_targets(sources: DataFrame, weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    """Targets of ``(source, source_size)`` rows, one a source: adds ``weight, target``.

    Weights repeat over the sources in code-point order, null last. The total
    of all sizes is shared in proportion to weight; a source stops at
    ``max_epochs`` times its size and its excess is shared again by weight.

    Raising the water level stops sources in the order of ``cap / weight``, so
    one sorted pass replaces the rounds: a source is stopped if the level, were
    it and all that stop later still open, lies above its cap. Sizes and weights are
    integers, so sums are exact and reruns agree. An empty table gives no rows.
    """
    by_name = [F.col("source").isNull(), F.col("source")]
    rows = _sums_before(sources, by_name, {"position": F.lit(1).cast("long")})
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("position") % len(weights)).cast("int") + 1).cast("long")
    rows = rows.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * max_epochs).alias("cap"))
    rows = _sums_before(rows, [F.col("cap") / F.col("weight"), *by_name], {"stopped": F.col("cap"), "stopped_weight": F.col("weight")})
    total = lambda found, name: F.lit(int(found[name] or 0)).cast("long")
    all_ = rows.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    height = (total(all_, "size") - F.col("stopped")) / (total(all_, "weight") - F.col("stopped_weight"))
    rows = stage(rows.withColumn("full", F.col("cap") <= height * F.col("weight")), "mix-sources")
    ends = rows.agg(F.sum(F.when(~F.col("full"), F.col("weight"))).alias("rest"), F.sum(F.when(F.col("full"), F.col("cap"))).alias("taken")).first()
    shared = (total(all_, "size") - total(ends, "taken")).cast("double") * F.col("weight") / F.greatest(total(ends, "rest"), F.lit(1))
    return rows.select("source", "source_size", "weight", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(shared).alias("target"))


def _sized(docs: DataFrame, *more: Column) -> DataFrame:
    """``doc_id, source, size, key`` of every row; ``key`` is a hash of 63 bits of the id and the text."""
    key = F.shiftrightunsigned(F.xxhash64(F.lit(9), F.col("doc_id").cast("long"), text_of()), 1)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count().alias("size"), key.alias("key"), *more)


def _row_key(seed: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), "key"), 1)


def mix_plan(sizes: DataFrame, weights: tuple[int, ...], max_epochs: int, seed: int) -> DataFrame:
    """Per source of ``_sized`` rows: ``source, source_size, target, whole, upto, cut_row``.

    Every row is taken ``whole`` times, and once more if its bucket of the last level lies
    before ``upto``, or is ``upto`` and the row is ``cut_row`` or before it. The cut is found
    level by level from sums over at most 4096 buckets a source; rows are ordered only inside
    the one bucket a source, in sixteen million, that the target cuts.
    """
    base = sizes.select("source", "doc_id", "size", _row_key(seed).alias("key"))
    same = lambda a, b: F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))
    bucket = lambda bit: F.shiftright("key", bit).alias("bucket")
    sums = stage(base.groupBy("source", bucket(LEVELS[0])).agg(F.sum("size").alias("words")), "mix-buckets")
    targets = source_targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, max_epochs)
    ratio = F.col("target") / F.greatest(F.col("source_size"), F.lit(1))
    targets = targets.withColumn("whole", F.least(F.floor(ratio), F.lit(max_epochs)).cast("long"))
    targets = targets.withColumn("extra", F.col("target") - F.col("whole") * F.col("source_size"))
    marks = stage(targets.withColumns({"found": F.lit(True), "prefix": F.lit(0).cast("long"), "below": F.lit(0).cast("long")}), "mix-targets")
    running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    for level, bit in enumerate(LEVELS):
        if level:
            inside = base.alias("d").join(marks.filter("found").alias("m"), same("d", "m") & (F.shiftright("key", LEVELS[level - 1]) == F.col("prefix"))).select("d.*")
            sums = stage(inside.groupBy("source", bucket(bit)).agg(F.sum("size").alias("words")), "mix-buckets")
        filled = sums.withColumn("before", F.coalesce(F.sum("words").over(running), F.lit(0))).alias("s").join(marks.alias("m"), same("s", "m"))
        filled = filled.select("s.source", "bucket", (F.col("below") + F.col("before")).alias("below"), "words", "extra")
        cut = filled.filter((F.col("below") <= F.col("extra")) & (F.col("below") + F.col("words") > F.col("extra"))).select("source", "bucket", "below")
        marks = marks.alias("m").join(cut.alias("c"), same("m", "c"), "left").select("m.source", "source_size", "target", "whole", "extra", (F.col("found") & F.col("bucket").isNotNull()).alias("found"), F.col("bucket").alias("prefix"), F.col("c.below").alias("below"))
        marks = stage(marks, "mix-marks")
    rows = base.alias("d").join(marks.filter("found").alias("m"), same("d", "m") & (F.shiftright("key", LEVELS[-1]) == F.col("prefix"))).select("d.*", "below", "extra")
    inside = Window.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    # A row is taken if more than half of it lies below the target.
    rows = rows.withColumn("at", F.col("below") + F.coalesce(F.sum("size").over(inside), F.lit(0))).filter(F.col("at") + F.col("size") / 2 < F.col("extra"))
    last = rows.groupBy("source").agg(F.max(F.struct("key", "doc_id", "size")).alias("cut_row"))
    # Without a cut, all rows are taken once more or none.
    upto = F.when(F.col("found"), F.col("prefix")).when(F.col("extra") > 0, F.lit(1 << (2 * BUCKET_BITS))).otherwise(F.lit(0)).cast("long")
    plan = marks.alias("m").join(last.alias("l"), same("m", "l"), "left").select("m.source", "source_size", "target", "whole", upto.alias("upto"), "cut_row")
    return stage(plan, "mix-plan")


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, seed: int = 9) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies, taken`` for every document.

    Each document of a source is taken whole ``floor(target / source_size)``
    times; a seeded sample gets one copy more, so that the words of the sample
    come as near the rest of the target as whole documents allow.

    Null texts have size 0, and texts of any length are counted whole. Null sources are one
    source. A source of size 0 has target 0 and takes nothing. Rows that repeat are separate
    rows, unless they agree in id and text: then they are taken or left together. An empty
    table gives no rows; other columns play no part.
    """
    sizes = stage(_sized(docs), "mix-sizes")
    plan = mix_plan(sizes, weights, max_epochs, seed)
    planned = _planned(sizes, plan, max_epochs, seed).withColumn("taken", F.col("copies") * F.col("size"))
    return planned.select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


def _planned(rows: DataFrame, plan: DataFrame, max_epochs: int, seed: int) -> DataFrame:
    """``_sized`` rows with ``source_size, target, copies`` and their other columns.

    The plan is one row a source; Spark broadcasts it while it is under its
    limit and else joins by sorting, splitting hot sources.
    """
    joined = rows.withColumn("row_key", _row_key(seed)).alias("d").join(plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")))
    bucket = F.shiftright("row_key", LEVELS[-1])
    within = (bucket == F.col("upto")) & (F.struct(F.col("row_key").alias("key"), "doc_id", "size") <= F.col("cut_row"))
    more = (bucket < F.col("upto")) | F.coalesce(within, F.lit(False))
    copies = F.least(F.col("whole") + more.cast("long"), F.lit(max_epochs)).alias("copies")
    return joined.select(*[F.col(f"d.{c}") for c in rows.columns], "source_size", "target", copies)


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, seed: int = 9) -> DataFrame:
    """The rows of ``docs`` as often as ``mix`` takes them, with the columns of ``docs``."""
    own = _sized(docs, F.struct(*[F.col(c) for c in docs.columns]).alias("document"))
    plan = mix_plan(stage(own.drop("document"), "mix-sizes"), weights, max_epochs, seed)
    taken = _planned(own, plan, max_epochs, seed).filter("copies > 0")
    return taken.select("document", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("document.*")


def oracle(weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, rounds: int = 12) -> str:
    """Sizes and targets of the sources of ``documents`` in DuckDB SQL: rounds of sharing what capped sources leave.

    An error where ``rounds`` do not suffice.
    """
    weight = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(weights))
    sql = f"""
    WITH s AS (
        SELECT source, sum(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')))::BIGINT AS source_size FROM documents GROUP BY source
    ), r0 AS (
        SELECT source, source_size, {max_epochs} * source_size AS cap, false AS capped, (sum(source_size) OVER ())::DOUBLE AS whole,
               CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(weights)} {weight} END AS weight FROM s
    )"""
    for k in range(rounds):
        sql += f""", t{k} AS (
        SELECT *, (whole - coalesce(sum(cap) FILTER (capped) OVER (), 0)) * weight / sum(weight) FILTER (NOT capped) OVER () AS share FROM r{k}
    ), r{k + 1} AS (
        SELECT source, source_size, cap, capped OR share > cap AS capped, whole, weight FROM t{k}
    )"""
    return sql + f""", last AS (
        SELECT *, (whole - coalesce(sum(cap) FILTER (capped) OVER (), 0)) * weight / sum(weight) FILTER (NOT capped) OVER () AS share FROM r{rounds}
    )
    SELECT source, source_size, CAST(weight AS BIGINT) AS weight, round(CASE WHEN capped THEN cap::DOUBLE WHEN share > cap THEN error('more rounds are needed') ELSE share END, 3) AS target FROM last
    """
