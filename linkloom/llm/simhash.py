"""Operator 6: SimHash near-duplicates, found in BK-trees.

Fingerprints are cut into five blocks of bits. Two that differ in at most three
bits agree on two blocks at least, so every fingerprint goes to ten shards, one
for each pair of blocks and their value, and each shard is searched with its own
BK-tree. A shard's trees live where the shard's rows are: trees of a whole
corpus have no size bound, so they are dealt out instead of broadcast.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bktree import linked
from .common import frugal, stage, text_of
from .components import connected_components

SEED, RADIUS = 42, 3
#: (lowest bit, bits) of the five blocks.
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """SimHash of a UTF-8 text: per bit, the majority over the hashes of its word shingles.

    A-Z are lower-cased; words are split at ASCII white space. Fewer words than a
    shingle count as one shingle; a text without words has fingerprint zero.
    """
    words = text.lower().split()  # on bytes, both are ASCII only
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(joined, SEED)
    ends = list(accumulate(map(len, words), lambda at, n: at + 1 + n))
    begins = [0, *(e + 1 for e in ends)]
    n, step = len(words) - shingle + 1, 1 << 16
    # A very long text, a block at a time.
    return majority(np.asarray([digest(joined[a:b], SEED) for a, b in zip(begins[k : min(k + step, n)], ends[k + shingle - 1 :])], np.uint64) for k in range(0, n, step))


def majority(blocks) -> int:
    """The bits that are set in over half of the hashes, of which ``blocks`` are arrays."""
    counts, n = np.zeros(64, np.int64), 0
    for block in blocks:
        bits = np.unpackbits(block.astype("<u8", copy=False).view(np.uint8), bitorder="little").reshape(-1, 64)
        counts += bits.sum(axis=0, dtype=np.int32)
        n += len(block)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fp``: the fingerprint's 64 bits as a signed long. Null texts are empty."""

    def run(batches):
        for batch in batches:
            fp = np.fromiter((fingerprint(x.as_buffer().to_pybytes()) for x in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.record_batch([batch.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), text_of().cast("binary").alias("text")).mapInArrow(frugal(run), "doc_id long, fp long")


#: (lowest bit, bits) of the four parts of the bits outside two blocks, 38 or 39 of them.
PARTS = ((0, 10), (10, 10), (20, 10), (30, 9))


def _shard_keys() -> list[Column]:
    """For each pair of blocks the shard of a fingerprint, and the bits of the other blocks side by side."""
    block = lambda at, bits: F.shiftrightunsigned("fp", at).bitwiseAND((1 << bits) - 1)
    out = []
    for k, (a, b) in enumerate(combinations(range(5), 2)):
        rest, at = F.lit(0).cast("long"), 0
        for c in range(5):
            if c not in (a, b):
                rest, at = rest + F.shiftleft(block(*BLOCKS[c]), at), at + BLOCKS[c][1]
        shard = F.lit(k << 26) + F.shiftleft(block(*BLOCKS[a]), 13) + block(*BLOCKS[b])
        out.append(F.struct(shard.alias("shard"), rest.alias("rest")))
    return out


def shard_links(distinct: DataFrame, most: int = 1 << 14) -> DataFrame:
    """Edges ``(u, v)`` between fingerprints that links of up to three bits join inside a shard.

    Not all pairs: a forest that joins the same fingerprints, so a shard of n
    gives less than n edges. A shard of more than ``most`` is dealt out further: its fingerprints
    may differ in three of the bits that are left, so they agree on one of four parts of these.
    """
    shards = distinct.select("fp", F.explode(F.array(*_shard_keys())).alias("s")).select("fp", "s.shard", "s.rest")
    hot = shards.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).select("shard", F.lit(True).alias("hot"))
    hot = stage(hot, "fingerprints-hot")
    if not hot.isEmpty():
        parts = [F.lit(1 << 62) + F.shiftleft("shard", 12) + F.lit(j << 10) + F.shiftrightunsigned("rest", at).bitwiseAND(F.lit((1 << bits) - 1)) for j, (at, bits) in enumerate(PARTS)]
        shards = shards.join(hot, "shard", "left").select("fp", F.explode(F.when(F.col("hot"), F.array(*parts)).otherwise(F.array("shard"))).alias("shard"))
    shards = shards.select("fp", "shard")

    def run(batches):
        kept_s, kept_f = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def links(s, f):
            repeated = np.r_[s[1:] == s[:-1], False]
            repeated[1:] |= s[1:] == s[:-1]  # shards of one fingerprint have no links
            s, f = s[repeated], f[repeated]
            first = linked(s, f.view(np.uint64), RADIUS)
            other = np.flatnonzero(first != np.arange(len(first)))
            return pa.record_batch([pa.array(f[other]), pa.array(f[first[other]])], names=["u", "v"])

        for batch in batches:
            s = np.concatenate([kept_s, np.asarray(batch.column(1))])
            f = np.concatenate([kept_f, np.asarray(batch.column(0))])
            if not len(s):
                continue
            whole = int(np.searchsorted(s, s[-1]))  # the last shard may go on in the next batch
            if whole:
                yield links(s[:whole], f[:whole])
            kept_s, kept_f = s[whole:], f[whole:]
        if len(kept_s):
            yield links(kept_s, kept_f)

    return shards.repartition("shard").sortWithinPartitions("shard", "fp").mapInArrow(frugal(run), "u long, v long")


def near_duplicates(docs: DataFrame, most: int = 1 << 14) -> DataFrame:
    """``doc_id, fp, component_id`` for every row of ``docs``.

    ``component_id`` is the smallest ``doc_id`` that links reach, own id included;
    texts with equal fingerprints are linked. Rows without ``doc_id`` are linked
    like others but never name a component; a component of such rows alone has a
    null one. Ties cannot arise; repeated rows each get their row; null texts are empty, and
    texts of any length are read whole. An empty table gives no rows; other columns play no part.
    ``most``: fingerprints of a shard beyond which it is dealt out further.
    """
    prints = stage(fingerprints(docs), "fingerprints")
    distinct = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "fingerprints-distinct")
    roots = stage(connected_components(shard_links(distinct, most)), "fingerprints-roots").withColumnRenamed("node", "fp")
    # Both sides of each join are written tables, so that Spark can split a hot component or fingerprint.
    lows = stage(roots.join(distinct, "fp").groupBy("root").agg(F.min("low").alias("component_id")), "fingerprints-lows")
    named = stage(roots.join(lows, "root").select("fp", "component_id", F.lit(True).alias("joined")), "fingerprints-named")
    each = distinct.join(named, "fp", "left").select("fp", F.when(F.col("joined"), F.col("component_id")).otherwise(F.col("low")).alias("component_id"))
    return prints.join(stage(each, "fingerprints-each"), "fp").select("doc_id", "fp", "component_id")
