import random

import numpy as np

from linkloom.llm import similar

from .helpers import ODD_ROWS, docs_of, table
from .test_simhash import print_of


def sets_of(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_similar(rows):
    """Smallest ids of the components of exact Jaccard 0.8 links."""
    sets, group = [sets_of(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both) and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    low = {}
    for (d, _), g in zip(rows, group):
        if d is not None:
            low[g] = min(d, low.get(g, d))
    return set(low.values())


def test_stage_against_exact_similarity(spark):
    rng, rows = random.Random(4), []
    for i in range(40):
        base = [f"w{rng.randint(0, 5000)}" for _ in range(200)]
        rows.append((4 * i, " ".join(base)))
        for k, edits in enumerate((2, 4, 9)):
            words = base[:]
            for _ in range(edits):
                words[rng.randrange(200)] = "new"
            rows.append((4 * i + k + 1, " ".join(words)))
    rows += [(1000 + d, t) for d, t in [r[:2] for r in ODD_ROWS] if d is not None]
    kept = {r["doc_id"] for r in similar.keep_first(docs_of(spark, rows, 5)).collect()}
    assert kept == brute_similar(rows)
    apart = sum((print_of(rows[4 * i][1]) ^ print_of(rows[4 * i + 2][1])).bit_count() > 3 for i in range(40))
    assert apart > 20 and len(kept) < 110  # most of these links are beyond three bits


def test_stage_on_table(spark):
    docs = table(spark, "documents")
    kept = {r["doc_id"] for r in similar.keep_first(docs).select("doc_id").collect()}
    assert kept == brute_similar([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_rows_of_one_id(spark):
    """Rows of one id stay unless their texts are alike; of equal rows one stays."""
    say = lambda k: " ".join(f"{k}w{i}" for i in range(60))
    rows = [(1, say("a")), (1, say("b")), (1, say("b")), (2, say("a")), (None, say("c")), (None, say("d")), (None, say("d")), (3, say("c"))]
    kept = similar.keep_first(docs_of(spark, rows))
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == sorted([(1, say("a")), (1, say("b")), (3, say("c")), (None, say("c")), (None, say("d")), (None, say("d"))], key=repr)
    assert kept.columns == docs_of(spark, rows).columns


def test_links_of_a_bucket_against_all_pairs():
    rng = np.random.default_rng(5)
    base = [np.unique(rng.integers(0, 1 << 63, 120, dtype=np.uint64)) for _ in range(4)]
    sets = []
    for i in range(160):
        own = base[i % 4].copy()
        own[rng.choice(len(own), int(rng.integers(0, 25)), replace=False)] = rng.integers(0, 1 << 63, 1, dtype=np.uint64)
        sets.append(np.unique(own))
    prints = np.array([similar.majority([s]) for s in sets], np.uint64)
    prints[7] = prints[11]  # one fingerprint of two sets

    def joined(edges):
        label = list(range(160))
        for i, j in edges:
            label = [label[j] if x == label[i] else x for x in label]
        return {frozenset(i for i in range(160) if label[i] == x) for x in label}

    near = [(i, j) for i in range(160) for j in range(i) if similar.alike(sets[i], sets[j]) and (int(prints[i]) ^ int(prints[j])).bit_count() <= similar.RADIUS]
    for most in (100, 2_000_000):
        links = similar._links(list(range(160)), prints, sets, most)
        assert joined(links) == joined(near) and all(similar.alike(sets[i], sets[j]) for i, j in links) and len(links) < 160


def test_near_fingerprints_meet_without_a_common_bucket(spark):
    """Fingerprints joined by three bits, or equal, share a bucket whatever MinHash says; others do not."""
    rows = [(1, 0b1, [11]), (2, 0b1110, [12]), (3, (0b1110 << 40) | 0b1110, [13]), (4, 0b1, [14]), (5, 0x5555_5555_5555_5555, [15])]
    found = similar._members(spark.createDataFrame(rows, "node long, fp long, buckets array<long>")).collect()
    own = {r["node"]: r["bucket"] for r in found if r["bucket"] not in range(11, 16)}
    assert len(found) == 10 and own[1] == own[4] and own[2] == own[3] and len(set(own.values())) == 3
