import math
import random

import numpy as np
import pytest

from linkloom.llm import topk
from linkloom.llm.queries import ORACLES, QUERIES

from .helpers import as_rows, duck_over, table


def brute(rows, every, k):
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, x in whole:
        if q % every == 0:
            near = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in whole if i != q and len(y) == len(x))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(near)]
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 40)
    rng = random.Random(seed)
    rows = [(i, [rng.choice([-1.5, -0.25, 0.0, 0.125, 0.25, 3.0]) for _ in range(6)]) for i in range(300)]
    rows += [(301, None), (302, [None] * 6), (303, [float("nan")] * 6), (304, [float("inf")] * 6), (None, [1.0] * 6), (350, [0.0] * 6), (360, [1.0] * 3), (400, [2.0] * 3), (500, [1.0]), (500, [1.0] * 6), (500, [1.0] * 6), (600, [1e9] * 6)]
    df = spark.createDataFrame([(*r, 7, 1) for r in rows], "vec_id long, embedding array<double>, rank int, score int")
    parts = topk.quantized(df)
    queries = parts.filter("vec_id % 50 = 0")
    ranked = lambda df: sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect())
    once = [r for r in rows if r[0] != 500]
    assert ranked(topk.top_k(parts.filter("vec_id <> 500"), queries.filter("vec_id <> 500"), 5, 40, 3)) == brute(once, 50, 5)
    # Ids that repeat are candidates once each, and no candidates of their own.
    got = topk.top_k(parts, queries, 400, 40, 3).collect()
    assert sum(r["vec_id"] == 500 and r["query_id"] == 100 for r in got) == 2
    assert not [r for r in got if r["vec_id"] == r["query_id"]] and [r for r in got if r["query_id"] == 500]


def test_stops_before_the_end():
    rng = np.random.default_rng(0)
    rows = rng.integers(-20, 20, (5000, 3))
    lists = topk.SortedLists(np.arange(5000), rows)
    best, seen = lists.search(-1, np.array([5, -3, 1]), 5)
    scores = rows @ np.array([5, -3, 1])
    want = sorted(zip(-scores, range(5000)))[:5]
    assert [(-s, i) for s, i in best] == want and seen < 4000


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k_of_table(df, 50, 5).collect() == []


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.001"
    want = duck_over(embeddings=table(spark, "embeddings")).execute(ORACLES["op2_exact_top_k"]).to_arrow_table()
    assert as_rows(QUERIES["op2_exact_top_k"](spark, sf).toArrow()) == as_rows(want)


def test_block_search_stops_and_finds_all():
    rng = np.random.default_rng(6)
    rows, queries = rng.integers(-30, 30, (6000, 3)), rng.integers(-9, 9, (40, 3))
    queries[0], queries[1] = 0, [1, 0, 0]
    ids = rng.permutation(6000) * 3
    lists = topk.SortedLists(ids, rows)
    own = np.r_[ids[:20], np.full(20, -1)]
    scores = queries @ rows.T
    for low in (np.full(40, topk.NO_BOUND), np.partition(scores, -9, axis=1)[:, -9]):
        q, at, got = lists.search_all(own, queries, 5, low)
        for i in range(40):
            want = sorted((-s, v) for s, v in zip(scores[i], ids) if v != own[i])[:5]
            assert [(-s, v) for s, v in zip(got[q == i], lists.ids[at[q == i]])] == want
    depth = lists.depths(queries.astype(float), np.partition(scores, -5, axis=1)[:, -5].astype(float))
    assert (depth[2:] < 3000).mean() > 0.9 and all(len(lists.seen(queries[i].astype(float), int(depth[i]))) < 6000 for i in range(2, 40) if depth[i] < 1000)


@pytest.mark.parametrize("shard_rows, block", [(100, 7), (5000, 1000), (37, 3)])
def test_shards_and_blocks_agree(spark, shard_rows, block):
    rng = random.Random(9)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(700)]
    parts = topk.quantized(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = topk.top_k(parts, parts.filter("vec_id % 50 = 0"), 5, shard_rows, block).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == brute(rows, 50, 5)
