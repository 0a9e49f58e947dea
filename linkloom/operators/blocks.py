"""Sparse products in blocks of rows, without a shuffle of their partial products.

A block of the left rows lies in one task, with the right entries that it needs; these pass
by in order of their column, so that the sums of a column are complete once it has passed.
What is shuffled grows with the entries, and with the blocks that need an entry, but not
with the pairs that the entries make.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.storage import stage

#: Most left entries that a task holds, and pairs that it makes, for one block; a row beyond either is for the caller.
BLOCK_ENTRIES, BLOCK_PAIRS = 1 << 21, 1 << 27
#: Stands for a null index inside a block.
NONE = -(1 << 63)


def _sums(above: float | None, side: str | None, most_pairs: int):
    """The function of a task's batches ``block, right, p, k, v``, sorted by the first three; left entries have
    their row in ``p``, right ones their column. It needs no module of this package on executors."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def prepared(parts):
            """Left entries by key and row: rows, keys, begin of each key, row number and value of each entry, codes."""
            p, k, v = (np.concatenate(x) for x in zip(*parts))
            rows, row = np.unique(p, return_inverse=True)
            order = np.lexsort((row, k))
            keys, begins = np.unique(k[order], return_index=True)
            row, v = row[order], v[order]
            begins = np.r_[begins, len(row)]
            return rows, keys, begins, row, v, np.repeat(np.arange(len(keys)), np.diff(begins)) * (len(rows) + 1) + row

        def products(left, p, k, v):
            """Sums of whole columns, a batch of at most ``most_pairs`` pairs or one column at a time."""
            rows, keys, begins, row, x, codes = left
            at = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
            hit = keys[at] == k
            at, p, v = at[hit], p[hit], v[hit]
            low, high = begins[at], begins[at + 1]
            if side:  # a key's entries ascend by row: those on one side of the diagonal lie together
                cut = np.searchsorted(codes, at * (len(rows) + 1) + np.searchsorted(rows, p))
                low, high = (low, cut) if side == "above" else (cut, high)
            n = high - low
            column = np.cumsum(np.r_[False, p[1:] != p[:-1]]) if len(p) else p
            starts = np.r_[np.flatnonzero(np.r_[True, p[1:] != p[:-1]]), len(p)] if len(p) else np.zeros(1, np.int64)
            total = np.r_[0, np.cumsum(n)][starts]  # pairs before each column
            c = 0
            while c < len(starts) - 1:
                end = max(c + 1, int(np.searchsorted(total, total[c] + most_pairs, side="right")) - 1)
                s = slice(starts[c], starts[end])
                many, made = n[s], int(total[end] - total[c])
                if made:
                    entry = np.repeat(low[s] - (np.cumsum(many) - many), many) + np.arange(made)
                    code = np.repeat((column[s] - c) * len(rows), many) + row[entry]
                    value = x[entry] * np.repeat(v[s], many)
                    order = np.argsort(code)
                    code = code[order]
                    first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
                    sums, code = np.add.reduceat(value[order], first), code[first]
                    if above is not None:
                        keep = ~(sums <= above)
                        sums, code = sums[keep], code[keep]
                    yield pa.record_batch([pa.array(rows[code % len(rows)]), pa.array(p[starts[c + code // len(rows)]]), pa.array(sums)], names=["i", "j", "s"])
                c = end

        block, parts, left, kept = None, [], None, None
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            edges = np.flatnonzero(np.r_[True, (columns[0][1:] != columns[0][:-1]) | (columns[1][1:] != columns[1][:-1])]) if batch.num_rows else []
            for a, b in zip(edges, [*edges[1:], batch.num_rows]):
                here = [c[a:b] for c in columns[2:]]
                if columns[0][a] != block:
                    if left and kept:
                        yield from products(left, *kept)
                    block, parts, left, kept = columns[0][a], [], None, None
                if not columns[1][a]:
                    parts.append(here)
                    continue
                if left is None and parts:
                    left, parts = prepared(parts), []
                if left is None:
                    continue
                here = [np.concatenate(x) for x in zip(kept, here)] if kept else here
                whole = int(np.searchsorted(here[0], here[0][-1]))  # the last column may go on in the next batch
                if whole:
                    yield from products(left, *[x[:whole] for x in here])
                kept = [x[whole:] for x in here]
        if left and kept:
            yield from products(left, *kept)

    return run


def block_sums(
    left: DataFrame, right: DataFrame, above: float | None = None, side: str | None = None, entries: int = BLOCK_ENTRIES, most: int = BLOCK_PAIRS, batch_pairs: int = 1 << 17
) -> tuple[DataFrame, DataFrame]:
    """``i, j, s`` with the sums of x * y over k of ``i, k, x`` and ``k, j, y``, and the ``i`` that are left out.

    Indices are whole numbers of up to 64 bits; both inputs are read more than once, so they should be written
    tables. ``above``: sums that do not exceed it are dropped. ``side``: "above" keeps i < j, "below" i >= j. Rows of more than ``entries``
    entries or ``most`` pairs are left out: they are less than the entries or pairs divided by these. Null
    values count for nothing. A null i or j is an index like others, but on no side; a null k matches nothing.
    """
    spark = left.sparkSession
    types = {"i": dict(left.dtypes)["i"], "j": dict(right.dtypes)["j"]}
    long = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(NONE)).alias("p")
    left = left.filter("k is not null and x is not null").select(long("i"), F.col("k").cast("long").alias("k"), F.col("x").cast("double").alias("v"))
    right = right.filter("k is not null and y is not null").select(long("j"), F.col("k").cast("long").alias("k"), F.col("y").cast("double").alias("v"))
    if side:
        left, right = left.filter(F.col("p") != NONE), right.filter(F.col("p") != NONE)
    degrees = right.groupBy("k").agg(F.count(F.lit(1)).alias("d"))
    rows = stage(left.join(degrees, "k").groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.sum("d").alias("pairs")), "block-rows")
    # Blocks are ranges of ids of the same width, so that rows near each other share what they need.
    many = rows.agg(F.sum("n").alias("n"), F.sum("pairs").alias("pairs"), F.min(F.nullif("p", F.lit(NONE))).alias("low"), F.max("p").alias("high")).first()
    n, pairs = many["n"] or 0, many["pairs"] or 0
    low = many["low"] or 0
    tasks = max(1, -(-n // entries), -(-pairs // most), min(spark.sparkContext.defaultParallelism, n >> 12))
    width = max(1, -(-(max(low, many["high"] or 0) - low + 1) // tasks))
    block = F.when(F.col("p") == NONE, F.lit(0)).otherwise(F.floor((F.col("p").cast("decimal(20,0)") - F.lit(low).cast("decimal(20,0)")) / F.lit(width).cast("decimal(20,0)"))).cast("long")
    is_large = (F.col("n") > entries) | (F.col("pairs") > most)
    large = rows.filter(is_large).select("p")
    # A block of too many entries or pairs is cut further; there are few blocks, for their number follows the entries and pairs.
    cuts = F.ceil(F.greatest(F.sum("n") / entries, F.sum("pairs") / most)).cast("long")
    blocks = stage(rows.filter(~is_large).groupBy(block.alias("block")).agg(F.greatest(cuts, F.lit(1)).alias("cuts")), "blocks")
    few = left.join(F.broadcast(large), "p", "left_anti").withColumn("block", block).join(F.broadcast(blocks), "block")
    held = few.select((F.col("block") * (1 << 20) + F.pmod(F.xxhash64("p"), "cuts")).alias("block"), "p", "k", "v")
    needed = stage(held.select("block", "k").distinct(), "block-keys")
    sent = right.join(needed, "k").select("block", F.lit(True).alias("right"), "p", "k", "v")
    dealt = held.select("block", F.lit(False).alias("right"), "p", "k", "v").unionByName(sent).repartition(4 * tasks, "block").sortWithinPartitions("block", "right", "p")
    sums = dealt.mapInArrow(_sums(above, side, batch_pairs), "i long, j long, s double")
    back = lambda c: F.nullif(c, F.lit(NONE)).cast(types[c]).alias(c)
    return sums.select(back("i"), back("j"), "s"), large.select(F.nullif("p", F.lit(NONE)).cast(types["i"]).alias("i"))
