import random

import numpy as np
import xxhash

from linkloom.llm import bktree, simhash, similar
from linkloom.llm.components import connected_components

from .helpers import ODD_ROWS, docs_of, table


def print_of(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    prints = [(d, print_of(t)) for d, t in rows]
    group = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 3 and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    low = {}
    for (d, _), g in zip(prints, group):
        if d is not None:
            low[g] = min(d, low.get(g, d))
    return sorted(((d, p, low.get(g)) for (d, p), g in zip(prints, group)), key=repr)


def found(df, **kw):
    return sorted(((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in simhash.near_duplicates(df, **kw).collect()), key=repr)


def near_copies(seed):
    rng = random.Random(seed)
    base = [" ".join(rng.choice("alpha beta gamma delta eps zeta".split()) + str(rng.randint(0, 99)) for _ in range(120)) for _ in range(6)]
    rows = []
    for i in range(120):
        words = rng.choice(base).split()
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = "new"
        rows.append((1000 - i, " ".join(words)))
    return rows


def test_against_brute_force(spark):
    rows = near_copies(1) + [r[:2] for r in ODD_ROWS]
    got = found(docs_of(spark, rows, 5))
    assert got == brute(rows) and len({c for _, _, c in got}) < len(got) - 60


def test_hot_shards(spark):
    """Shards of two and more are dealt out further, and no link is lost."""
    rows = near_copies(4) + [r[:2] for r in ODD_ROWS]
    assert found(docs_of(spark, rows, 5), most=1) == found(docs_of(spark, rows), most=6) == brute(rows)
    rng = random.Random(1)
    prints = [rng.getrandbits(64)]
    while len(prints) < 60:  # each up to three bits from another
        prints = sorted({*prints, rng.choice(prints) ^ sum(1 << b for b in rng.sample(range(64), 3))})
    distinct = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p, 0) for p in prints], "fp long, low long")
    for most in (1, 1000):
        roots = {r["root"] for r in connected_components(simhash.shard_links(distinct, most)).collect()}
        assert len(roots) == 1


def test_table_and_empty(spark):
    docs = table(spark, "documents")
    assert found(docs) == brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert found(docs.limit(0)) == []


def test_keep_first(spark):
    rows = [(3, "a b c d"), (2, "a b c d"), (2, "a b c d"), (9, "x y z w"), (None, "a b c d")]
    assert sorted((r["doc_id"] for r in similar.keep_first(docs_of(spark, rows)).collect()), key=repr) == [2, 9, None]


def test_forest_against_all_pairs():
    rng = np.random.default_rng(3)
    for _ in range(10):
        group, base = np.sort(rng.integers(0, 5, 250)), rng.integers(0, 2**63, 15, dtype=np.uint64)
        value = base[rng.integers(0, 15, 250)]
        for _ in range(4):
            value = value ^ ((np.uint64(1) << rng.integers(0, 64, 250).astype(np.uint64)) * (rng.random(250) < 0.6).astype(np.uint64))
        both = np.unique(np.stack([group.astype(np.uint64), value], 1), axis=0)
        group, value = both[:, 0].astype(np.int64), both[:, 1]
        forest = bktree.Forest(group, value)
        q, v = forest.within(np.arange(len(value)), 3)
        near = (np.bitwise_count(value[:, None] ^ value[None, :]) <= 3) & (group[:, None] == group[None, :])
        np.fill_diagonal(near, False)
        assert set(zip(q.tolist(), v.tolist())) == set(zip(*map(list, np.nonzero(near))))
        label = bktree.linked(group, value, 3, most_pairs=300)
        assert (label[q] == label[v]).all() and (label <= np.arange(len(label))).all()


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 540)] + [(7, 7)]
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for u, v in edges:
        if u != v:
            a, b = find(u), find(v)
            parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "u long, v long")).collect() == []
