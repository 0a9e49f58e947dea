"""Sparse matrices as ``i, j, v`` rows: products, transposition, half-stored symmetry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions import rounded
from linkloom.operators.blocks import BLOCK_ENTRIES, block_sums

#: Rows of one key beyond which a product deals them over several slices: adaptive execution splits
#: partitions by their bytes, not by the pairs that a key makes.
SLICE_ROWS = 20_000


def transpose(m: DataFrame) -> DataFrame:
    return m.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def drop_zeros(m: DataFrame) -> DataFrame:
    return m.filter("v <> 0")


def drop_diagonal(m: DataFrame) -> DataFrame:
    return m.filter("i <> j")


def lower_triangle(m: DataFrame) -> DataFrame:
    return m.filter("i >= j")


def checked_bounds(m: DataFrame, rows: int, columns: int) -> DataFrame:
    """``m``, raising where an index leaves ``rows`` x ``columns``."""
    inside = (F.col("i") >= 0) & (F.col("i") < rows) & (F.col("j") >= 0) & (F.col("j") < columns)
    index = F.when(inside, F.col("i")).otherwise(F.raise_error(F.format_string("index (%d, %d) out of bounds", "i", "j")).cast(dict(m.dtypes)["i"]))
    return m.withColumn("i", index)


def _both_ways(m: DataFrame, again: Column) -> DataFrame:
    one = F.struct(F.col("i").alias("i"), F.col("j").alias("j"))
    two = F.struct(F.col("j").alias("i"), F.col("i").alias("j"))
    return m.select(F.explode(F.when(again, F.array(one, two)).otherwise(F.array(one))).alias("e"), "v").select("e.i", "e.j", "v")


def expand_symmetric(m: DataFrame) -> DataFrame:
    """The whole of a symmetric matrix of which each entry is stored once."""
    return _both_ways(m, F.col("i") != F.col("j"))


def _summed(pairs: DataFrame, threshold: float, decay: float, prune: str, unit_diagonal: bool, float32: bool) -> DataFrame:
    """Sums ``i, j, x, y`` products; see ``product``."""
    if prune == "partial":
        p = F.col("x") * F.col("y") * F.lit(decay)
        sums = pairs.select("i", "j", p.alias("p")).filter(F.col("p") >= threshold).groupBy("i", "j").agg(F.sum("p").alias("s"))
        value = rounded(F.col("s"), float32)
    else:
        sums = pairs.select("i", "j", (F.col("x") * F.col("y")).alias("p")).groupBy("i", "j").agg(F.sum("p").alias("s"))
        return _pruned(sums, threshold, decay, unit_diagonal)
    if unit_diagonal and decay < 1:
        value = F.when(F.col("i") == F.col("j"), F.lit(1.0)).otherwise(value)
    return sums.select("i", "j", value.alias("v"))


def _pruned(sums: DataFrame, threshold: float, decay: float, unit_diagonal: bool) -> DataFrame:
    """Of ``i, j, s`` what exceeds ``threshold``, scaled; see ``product``."""
    keep, value = F.col("s") > threshold, F.col("s") * F.lit(decay)
    if unit_diagonal and decay < 1:
        keep = keep | (F.col("i") == F.col("j"))
        value = F.when(F.col("i") == F.col("j"), F.lit(1.0)).otherwise(value)
    return sums.filter(keep).select("i", "j", value.alias("v"))


def _sliced(left: DataFrame, right: DataFrame, key: str, slice_rows: int | None) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides with the columns to join on; hot keys of ``left`` dealt over several slices.

    A key with more than ``slice_rows`` rows on the left is split into slices; the
    right side's rows of that key are repeated for each. Keys without slices have
    number 0 on both sides. None leaves skew to adaptive execution.
    """
    if slice_rows is None:
        return left, right, [key]
    hot = left.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / slice_rows).cast("int").alias("slices")).filter("slices > 1")
    slices = F.coalesce(F.col("slices"), F.lit(1))
    left = left.join(hot, key, "left").withColumn("slice", F.pmod(F.xxhash64(*left.columns), slices).cast("int")).drop("slices")
    right = right.join(hot, key, "left").withColumn("slice", F.explode(F.sequence(F.lit(0), slices - 1))).drop("slices")
    return left, right, [key, "slice"]


def product(
    a: DataFrame,
    b: DataFrame,
    threshold: float = 0.0,
    decay: float = 1.0,
    prune: str = "partial",
    transpose_a: bool = False,
    lower: bool = False,
    expand_a: bool = False,
    unit_diagonal: bool = False,
    float32: bool = True,
    slice_rows: int | None = SLICE_ROWS,
    block_entries: int = BLOCK_ENTRIES,
) -> DataFrame:
    """Sparse product of ``a`` and ``b``, scaled by ``decay``.

    ``prune="partial"`` drops scaled partial products below ``threshold`` before
    they are summed and rounds sums to single precision if ``float32``;
    ``"sum"`` drops unscaled sums that do not exceed it and rounds nothing.
    ``lower`` keeps i >= j. ``expand_a``: ``a`` is half stored. ``unit_diagonal``
    sets surviving diagonal entries to 1 if ``decay`` is below 1.

    Partial products that are dropped are never shuffled. All those of ``"sum"`` would be, so where indices are
    whole numbers they are summed in blocks of rows of up to ``block_entries``; ``a`` and ``b`` are then read
    more than once and should be written tables.
    """
    if prune not in ("partial", "sum"):
        raise ValueError("prune must be 'partial' or 'sum'")
    a = transpose(a) if transpose_a else a
    a = expand_symmetric(a) if expand_a else a
    left = a.select("i", F.col("j").alias("k"), F.col("v").alias("x"))
    right = b.select(F.col("i").alias("k"), "j", F.col("v").alias("y"))
    if prune == "sum" and {t for m in (left, right) for c, t in m.dtypes if c in "ijk"} <= {"tinyint", "smallint", "int", "bigint"}:
        above = None if unit_diagonal and decay < 1 else threshold
        sums, large = block_sums(left, right, above, "below" if lower else None, block_entries)
        found = _pruned(sums, threshold, decay, unit_diagonal)
        if large.isEmpty():
            return found
        # Rows beyond a block, for which the pairs are shuffled.
        left = left.join(large, F.equal_null(left.i, large.i), "left_semi")
    else:
        found = None
    left, right, on = _sliced(left, right, "k", slice_rows)
    pairs = left.join(right, on)
    if lower:
        pairs = pairs.filter("i >= j")
    rest = _summed(pairs, threshold, decay, prune, unit_diagonal, float32)
    return rest if found is None else found.unionByName(rest)


def self_product(p: DataFrame, threshold: float = 0.0, decay: float = 1.0, prune: str = "partial", unit_diagonal: bool = True, float32: bool = True, slice_rows: int | None = SLICE_ROWS) -> DataFrame:
    """Lower triangle of P'P scaled by ``decay``; see ``product``."""
    return product(transpose(p), p, threshold, decay, prune, False, True, False, unit_diagonal, float32, slice_rows)
