"""Operator 6 for wide radii: near-duplicates of Jaccard similarity 0.8 of five-word shingles.

Fingerprints meet as in operator 6: dealt by pairs of bit blocks and searched in BK-trees, those
that three differing bits join make one bucket. SimHash fingerprints of such texts differ in 10 of
64 bits in the mean, though, and in more than ``RADIUS`` once in a million. No blocks of bits deal out
pairs so far apart, so for the rest MinHash values do: two sets of Jaccard similarity 0.8 share none of the ``BANDS`` buckets with
probability (1 - 0.8 ** ROWS) ** BANDS, under one in ten thousand. In a bucket the
fingerprints hang in a BK-tree, which is searched within the radius, and the links found
are verified on the whole sets. Shingles and equal sets are told apart by 64-bit hashes.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bktree import Forest
from .common import frugal, keyed_texts, stage, unstage
from .components import connected_components
from .simhash import majority, shard_links

SEED, SHINGLE, SIMILARITY, BANDS, ROWS = 42, 5, 0.8, 25, 5
#: Bits in which linked fingerprints may differ.
RADIUS = 24
_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, (2, BANDS * ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: bytes) -> np.ndarray:
    """Sorted distinct hashes of the word shingles, with the words of operator 6.

    Fewer words than a shingle count as one shingle; no words give an empty set.
    """
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = list(accumulate(map(len, words), lambda at, n: at + 1 + n))
    begins = [0, *(e + 1 for e in ends)]
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in zip(begins, ends[SHINGLE - 1 :])), np.uint64))


def buckets_of(shingles: np.ndarray) -> list[int]:
    """One signed long a band."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(shingles), 4096):
        mixed = shingles[k : k + 4096, None] * _FACTORS[0] + _FACTORS[1]
        np.minimum(low, (mixed ^ (mixed >> np.uint64(32))).min(axis=0), out=low)
    return [xxhash.xxh64_intdigest(v.tobytes(), b) - (1 << 63) for b, v in enumerate(low.reshape(BANDS, ROWS))]


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets have the similarity that links."""
    if min(len(a), len(b)) < SIMILARITY * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= SIMILARITY * (len(a) + len(b) - both)


def _links(nodes: list[int], prints: np.ndarray, sets: list[np.ndarray], most_pairs: int = 1 << 18) -> list[tuple[int, int]]:
    """A forest with the components of all links inside a bucket.

    The BK-tree names pairs within the radius, a block of queries at a time; those that are
    not joined yet are verified, nearest first, and no more than one a query at once.
    """
    label, out = np.arange(len(nodes)), []

    def verify(pairs: np.ndarray) -> None:
        """``pairs``: columns of two members, the greater first, and their distance."""
        while True:
            pairs = pairs[:, label[pairs[0]] != label[pairs[1]]]
            if not pairs.shape[1]:
                return
            pairs = pairs[:, np.lexsort((pairs[2], pairs[0]))]
            first = np.r_[True, pairs[0, 1:] != pairs[0, :-1]]
            for i, j in pairs[:2, first].T.tolist():
                if label[i] != label[j] and alike(sets[i], sets[j]):
                    out.append((nodes[i], nodes[j]))
                    label[label == label[i]] = label[j]
            pairs = pairs[:, ~first]

    values, which = np.unique(prints, return_inverse=True)
    members = np.argsort(which, kind="stable")
    begins = np.r_[np.searchsorted(which[members], np.arange(len(values))), len(members)]

    def crossed(p: np.ndarray, q: np.ndarray, distance: np.ndarray) -> np.ndarray:
        """Pairs of members of pairs of fingerprints."""
        many = np.diff(begins)
        n = many[p] * many[q]
        pair = np.repeat(np.arange(len(p)), n)
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        a, b = members[begins[p[pair]] + nth // many[q[pair]]], members[begins[q[pair]] + nth % many[q[pair]]]
        both = np.stack([np.maximum(a, b), np.minimum(a, b), distance[pair]])
        return both[:, a != b]

    forest, step = Forest(np.zeros(len(values), np.int64), values), max(1, most_pairs // len(values))
    for k in range(0, len(values), step):
        own = np.arange(k, min(k + step, len(values)))
        p, q = forest.within(own, RADIUS)
        p, q = np.r_[own, p[q < p]], np.r_[own, q[q < p]]
        distance = np.bitwise_count(values[p] ^ values[q]).astype(np.int64)
        verify(crossed(p, q, distance))
    return out


def _described(texts: DataFrame) -> DataFrame:
    """``doc, named, node, fp, buckets``: the set's hash, its fingerprint and its buckets."""

    def run(batches):
        for batch in batches:
            sets = [shingle_set(x.as_buffer().to_pybytes()) for x in batch.column(2)]
            node = [xxhash.xxh64_intdigest(s.tobytes(), SEED) - (1 << 63) for s in sets]
            prints = np.array([majority([s]) if len(s) else 0 for s in sets], np.uint64).view(np.int64)
            buckets = pa.array([buckets_of(s) for s in sets], pa.list_(pa.int64()))
            yield pa.record_batch([*batch.columns[:2], pa.array(node, pa.int64()), pa.array(prints), buckets], names=["doc", "named", "node", "fp", "buckets"])

    return texts.select("doc", "named", "text").mapInArrow(frugal(run), "doc long, named boolean, node long, fp long, buckets array<long>")


#: Rows up to which a table of sets to be made is broadcast.
MOST_BROADCAST = 200_000


def _sets_of(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """``node, fp, shingles`` of ``wanted`` rows ``doc, node, fp``, the shingles as bytes."""

    def run(batches):
        for batch in batches:
            sets = [shingle_set(x.as_buffer().to_pybytes()).tobytes() for x in batch.column(2)]
            yield pa.record_batch([*batch.columns[:2], pa.array(sets, pa.binary())], names=["node", "fp", "shingles"])

    few = wanted.count() <= MOST_BROADCAST
    joined = texts.select("doc", "text").join(F.broadcast(wanted) if few else wanted, "doc").select("node", "fp", "text")
    return joined.mapInArrow(frugal(run), "node long, fp long, shingles binary")


def _bucket_links(members: DataFrame) -> DataFrame:
    """Edges ``(u, v)`` inside the buckets of ``bucket, node, fp, shingles``."""

    def run(batches):
        bucket, held = None, []

        def links():
            nodes, prints, sets = zip(*held)
            found = _links(list(nodes), np.array(prints, np.int64).view(np.uint64), list(sets))
            return pa.record_batch([pa.array([u for u, _ in found], pa.int64()), pa.array([v for _, v in found], pa.int64())], names=["u", "v"])

        for batch in batches:
            for b, n, f, s in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2)), batch.column(3)):
                if b != bucket:
                    if len(held) > 1:
                        yield links()
                    bucket, held = b, []
                held.append((n, f, np.frombuffer(s.as_buffer().to_pybytes(), np.uint64)))
        if len(held) > 1:
            yield links()

    dealt = members.select("bucket", "node", "fp", "shingles").repartition("bucket").sortWithinPartitions("bucket", "node")
    return dealt.mapInArrow(frugal(run), "u long, v long")


def _members(distinct: DataFrame) -> DataFrame:
    """``node, bucket`` of ``node, fp, buckets``: operator 6's component of the fingerprint, and the MinHash buckets."""
    near = stage(connected_components(shard_links(distinct.select("fp").distinct())), "similar-near").withColumnRenamed("node", "fp")
    component = F.xxhash64(F.lit("component"), F.coalesce("root", "fp"))
    joined = stage(distinct.select("node", "fp").join(near, "fp", "left").select("node", component.alias("bucket")), "similar-joined")
    return distinct.select("node", F.explode("buckets").alias("bucket")).unionByName(joined)


def similar_texts(texts: DataFrame) -> DataFrame:
    """``doc, named, first`` for every row of ``doc, named, text``: the smallest key of a named row that links
    reach, the own one included.

    Equal sets are linked, empty ones too. Rows that are not named are linked like others, but
    are first of none; ``first`` is null where links reach no other rows. Keys differ. An empty table gives no rows.
    """
    described = stage(_described(texts), "similar-described")
    distinct = stage(described.groupBy("node").agg(F.min(F.when(F.col("named"), F.col("doc"))).alias("low"), F.min("doc").alias("doc"), F.first("fp").alias("fp"), F.first("buckets").alias("buckets")), "similar-distinct")
    members = _members(distinct)
    # Buckets of the same members are searched once.
    shared = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("c"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("s"), F.sum(F.col("node").cast("decimal(20,0)")).alias("t"))
    shared = stage(shared.filter("c > 1").groupBy("c", "s", "t").agg(F.min("bucket").alias("bucket")), "similar-buckets")
    wanted = stage(members.join(shared.select("bucket"), "bucket"), "similar-members")
    # Sets are made again where they share a bucket, so that the others are never written.
    meeting = stage(distinct.select("doc", "node", "fp").join(wanted.select("node").distinct(), "node", "left_semi").select("doc", "node", "fp"), "similar-meeting")
    sets = stage(_sets_of(texts, meeting), "similar-sets")
    links = stage(_bucket_links(wanted.join(sets, "node")), "similar-links")
    # Both sides of each join are written tables, so that Spark can split a hot component or set.
    roots = stage(connected_components(links), "similar-roots")
    lows = stage(roots.join(distinct, roots.node == distinct.node).groupBy("root").agg(F.min("low").alias("first")), "similar-lows")
    grouped = stage(roots.join(lows, "root").select("node", "first"), "similar-grouped")
    each = stage(distinct.join(grouped, "node", "left").select("node", F.coalesce("first", "low").alias("first")), "similar-each")
    out = stage(described.select("doc", "named", "node").join(each, "node").select("doc", "named", "first"), "similar-components")
    unstage(described, distinct, shared, wanted, meeting, sets, links, roots, lows, grouped, each)
    return out


def keep_first(docs: DataFrame) -> DataFrame:
    """The first row of each group of near-duplicates, with all columns.

    Rows are ordered as ``keyed_texts`` tells; rows of one id that are no near-duplicates all
    stay. Rows without ``doc_id`` stay. Null texts are empty, texts without words are
    duplicates of each other, and texts of any length are read whole. An empty table gives no rows.
    """
    texts = keyed_texts(docs)
    found = similar_texts(texts.select("doc", F.col("document.doc_id").isNotNull().alias("named"), "text"))
    first = found.filter(~F.col("named") | (F.col("doc") == F.col("first"))).select("doc")
    return texts.join(first, "doc", "left_semi").select("document.*")
