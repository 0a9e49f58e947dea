"""Operator 3: vector best-fit packing of token sequences.

A piece of a document is an item with three sizes: tokens, documents (one) and
attention cost (tokens squared). A bin has a capacity for each. The sizes follow
from the number of tokens alone, so the corpus is packed as a histogram: at most
``capacity`` different items, whatever the number of documents. The fill of a
bin found for the histogram is repeated for as many bins as the counts allow.
Pieces then find their bin and place by their rank among the pieces of their
length; no task or driver ever holds the pieces.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import frugal, stage, text_of
from .tokens import encoder_for, text_blocks


@dataclass(frozen=True)
class Bin:
    """Capacities of a bin, the weight of each dimension, and the rule that selects.

    ``rule``: "dot" takes the item of the largest weighted dot product with what
    is left of the bin, "norm" that which leaves the smallest weighted norm.
    """

    tokens: int = 1024
    documents: int = 1024
    attention: int = 1024 * 1024
    weights: tuple[float, float, float] = (1.0, 0.05, 0.05)
    rule: str = "norm"

    @property
    def longest(self) -> int:
        """Tokens of the longest piece that fits a bin alone."""
        return min(self.tokens, math.isqrt(self.attention)) if self.documents > 0 else 0


@dataclass
class Plan:
    """Where the pieces of each length go: interval arrays, ordered by (length, first rank)."""

    length: list[int] = field(default_factory=list)
    first_rank: list[int] = field(default_factory=list)
    first_bin: list[int] = field(default_factory=list)
    per_bin: list[int] = field(default_factory=list)
    offset: list[int] = field(default_factory=list)
    bins: int = 0

    def arrays(self) -> tuple[np.ndarray, ...]:
        columns = [np.asarray(x, np.int64) for x in (self.length, self.first_rank, self.first_bin, self.per_bin, self.offset)]
        order = np.lexsort((columns[1], columns[0]))
        return tuple(c[order] for c in columns)


def best_fit(histogram: dict[int, int], shape: Bin) -> Plan:
    """Packs ``histogram`` (length -> pieces). Lengths must be 1 to ``shape.tokens`` and fit alone.

    Opens a bin, adds the selected item until none fits, then repeats that fill
    while the counts last. Ties go to the longer item.
    """
    lengths = np.asarray(sorted((n for n, c in histogram.items() if c), reverse=True), np.int64)
    left = np.asarray([histogram[int(n)] for n in lengths], np.int64)
    caps = np.asarray([shape.tokens, shape.documents, shape.attention], np.float64)
    items = np.stack([lengths, np.ones_like(lengths), lengths * lengths], axis=1).astype(np.float64).reshape(-1, 3)
    if (items > caps).any():
        raise ValueError("an item is larger than a bin")
    items, weights = items / caps, np.asarray(shape.weights)
    plan, next_rank = Plan(), np.zeros(len(lengths), np.int64)
    while left.any():
        rest, slots, spare = np.ones(3), np.zeros(len(lengths), np.int64), left.copy()
        while True:
            fits = np.flatnonzero((spare > 0) & (items <= rest + 1e-12).all(axis=1))
            if not len(fits):
                break
            if shape.rule == "dot":
                pick = fits[np.argmax(items[fits] @ (weights * rest))]
            else:
                pick = fits[np.argmin(((rest - items[fits]) ** 2) @ weights)]
            slots[pick] += 1
            spare[pick] -= 1
            rest = rest - items[pick]
        used = np.flatnonzero(slots)
        times = int((left[used] // slots[used]).min())
        offset = 0
        for i in used:
            plan.length.append(int(lengths[i]))
            plan.first_rank.append(int(next_rank[i]))
            plan.first_bin.append(plan.bins)
            plan.per_bin.append(int(slots[i]))
            plan.offset.append(offset)
            offset += int(slots[i] * lengths[i])
            next_rank[i] += slots[i] * times
            left[i] -= slots[i] * times
        plan.bins += times
    return plan


PIECES = "part int, doc_id long, piece int, start long, length long, ids_crc32 long, rank long"


def pieces_of(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """Rows of ``PIECES``: documents as token ids and an end id, cut only where longer than ``capacity``.

    Of a longer document the first piece may be shorter, the others are full.
    ``rank`` counts the pieces of one length in one partition. Null texts are empty.
    """

    def run(batches):
        encoder = encoder_for(tokenizer)
        part, counts, rows = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64), []

        def batch():
            kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            columns = list(zip(*rows)) or [()] * 7
            return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in PIECES.split(", ")])

        for doc_ids, texts in text_blocks(batches):
            ids, bounds = encoder.encode(texts, end_id)
            data = memoryview(ids.tobytes())
            for doc_id, first, last in zip(doc_ids.to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist()):
                n, at, piece = last - first, 0, 0
                while at < n:
                    size = n if n <= capacity else ((n - at) % capacity or capacity)
                    crc = zlib.crc32(data[4 * (first + at) : 4 * (first + at + size)])
                    rows.append((part, doc_id, piece, at, size, crc, int(counts[size])))
                    counts[size] += 1
                    at, piece = at + size, piece + 1
            if len(rows) >= 20_000:
                yield batch()
                rows.clear()
        if rows:
            yield batch()

    return docs.select(F.col("doc_id").cast("long"), text_of().cast("binary").alias("text")).mapInArrow(frugal(run), PIECES)


def pack(docs: DataFrame, tokenizer: str, end_id: int, shape: Bin = Bin()) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of every piece.

    Sequences are filled without gaps from offset 0. Documents are cut only where they are longer
    than ``shape.longest``. With 1024 tokens and no narrower limits on documents and attention
    tokens alone bind, since n pieces of 1024 tokens together have no more than 1024 pieces and
    1024 ** 2 attention. Rows that repeat are packed once each; null texts are empty, and texts of
    any length are encoded whole. An empty table gives no rows; other columns play no part.
    """
    pieces = stage(pieces_of(docs, tokenizer, end_id, shape.longest), "pieces")
    counts = stage(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    # At most one row for each length a bin can hold.
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    length, first_rank, first_bin, per_bin, offset = best_fit(histogram, shape).arrays()
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(bases, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("rank")).alias("rank"))
    codes = (length << 44) + first_rank

    def place(batches):
        for batch in batches:
            size, rank = np.asarray(batch.column(3)), np.asarray(batch.column(5))
            i = np.searchsorted(codes, (size << 44) + rank, side="right") - 1
            nth = rank - first_rank[i]
            sequence = first_bin[i] + nth // per_bin[i]
            yield pa.record_batch([*batch.columns[:5], pa.array(sequence), pa.array(offset[i] + nth % per_bin[i] * size)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(frugal(place), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
