import numpy as np
import pytest

from linkloom.config import Params, single
from linkloom.operators import evidence, scoring, weights
from linkloom.plans import classic, similarity

from .test_matrix import frame

GRAPH = [(0, 0), (0, 1), (1, 0), (1, 1), (2, 0), (2, 1), (2, 2), (3, 3), (3, 4), (4, 5), (4, 6), (5, 5), (5, 6)]


def six_by_seven():
    edges = np.zeros((6, 7))
    for q, a in GRAPH:
        edges[q, a] = 1
    return edges / edges.sum(0), (edges / edges.sum(1, keepdims=True)).T


def off(df):
    return {(r["i"], r["j"]): r["v"] for r in df.collect() if r["i"] != r["j"]}


def run(spark, q2a, a2q, **kw):
    q, a = similarity.iterate(frame(spark, a2q), frame(spark, q2a), Params(**kw))
    return off(q), off(a)


@pytest.mark.parametrize(
    "kw, queries, ads",
    [
        (dict(iterations=2), {(1, 0): 0.36, (2, 0): 0.28, (2, 1): 0.28, (5, 4): 0.39}, {(1, 0): 0.2, (2, 0): 0.2, (2, 1): 0.2, (4, 3): 0.6, (6, 5): 0.3}),
        (dict(iterations=3), {(1, 0): 0.3968, (2, 0): 0.326933, (2, 1): 0.326933, (5, 4): 0.4251}, {(1, 0): 0.322667, (2, 0): 0.312, (2, 1): 0.312, (4, 3): 0.6, (6, 5): 0.417}),
        (dict(iterations=1, in_place=False), {(1, 0): 0.3, (2, 0): 0.2, (2, 1): 0.2, (5, 4): 0.3}, {(1, 0): 0.2, (2, 0): 0.2, (2, 1): 0.2, (4, 3): 0.6, (6, 5): 0.3}),
        (dict(iterations=3, in_place=False), {(1, 0): 0.388, (2, 0): 0.314667, (2, 1): 0.314667, (5, 4): 0.417}, {(1, 0): 0.322667, (2, 0): 0.312, (2, 1): 0.312, (4, 3): 0.6, (6, 5): 0.417}),
    ],
)
def test_golden_six_by_seven(spark, kw, queries, ads):
    got_q, got_a = run(spark, *six_by_seven(), **kw)
    assert got_q == {k: pytest.approx(v, abs=1e-6) for k, v in queries.items()}
    assert got_a == {k: pytest.approx(v, abs=1e-6) for k, v in ads.items()}


def test_golden_three_by_two(spark):
    q2a, a2q = np.full((3, 2), 1 / 3), np.full((2, 3), 1 / 2)
    q, a = run(spark, q2a, a2q, iterations=3)
    assert q == {k: pytest.approx(0.4032, abs=1e-6) for k in [(1, 0), (2, 0), (2, 1)]} and a == {(1, 0): pytest.approx(0.344, abs=1e-6)}


EDGES = [(0, 0, 4), (0, 1, 2), (1, 0, 1), (2, 0, 3), (2, 1, 3)]


@pytest.fixture()
def edges(spark):
    return spark.createDataFrame(EDGES, "q int, a int, clicks bigint")


def test_node_stats_and_weights(edges):
    stats = {r["q"]: (r["total"], r["spread"]) for r in weights.node_stats(edges, "q").collect()}
    assert stats == {0: (6, pytest.approx(0.36787944)), 1: (1, 1.0), 2: (6, pytest.approx(1.0))}
    wqa = {(r["i"], r["j"]): r["v"] for r in weights.weight_matrix(edges, "a", "q").collect()}
    assert wqa == {(0, 0): pytest.approx(0.14071473), (0, 1): pytest.approx(0.21107209), (0, 2): pytest.approx(0.10553604), (1, 0): pytest.approx(0.25960026), (1, 2): pytest.approx(0.38940039)}
    assert weights.filter_clicks(edges, 3).count() == 3
    assert tuple(weights.max_ids(edges).first()) == (2, 1)


def test_end_to_end(spark, edges):
    result = similarity.similar_queries(edges)
    scores = {frozenset((r["i"], r["j"])): r["v"] for r in result.scores.collect()}
    assert scores == {frozenset((0, 1)): pytest.approx(0.01154172, abs=1e-7), frozenset((0, 2)): pytest.approx(0.05809324, abs=1e-7), frozenset((1, 2)): pytest.approx(0.01062986, abs=1e-7)}
    texts = spark.createDataFrame([(0, "zero"), (1, "one")], "qid int, text string")
    lines = {r["qid"]: r["value"] for r in similarity.ranked_lines(result.scores, texts, "%.6f").collect()}
    assert lines == {0: "zero\x01No query text exist.\x021.0\x01one\x020.198676", 1: "one\x01zero\x021.0\x01No query text exist.\x020.920995"}


def test_evidence(spark, edges):
    got = {(r["q1"], r["q2"]): r["e"] for r in evidence.evidence(edges).collect()}
    assert got == {(0, 1): 0.5, (0, 2): 0.75, (1, 2): 0.5}
    assert {(r["q1"], r["q2"]): r["e"] for r in evidence.evidence(edges, slice_rows=1).collect()} == got


def test_scores_without_evidence_use_the_default(spark):
    scores = spark.createDataFrame([(1, 0, 0.5), (1, 1, 1.0)], "i int, j int, v double")
    none = spark.createDataFrame([(7, 8, 1, 0.5)], "q1 int, q2 int, n int, e double")
    assert [tuple(r) for r in scoring.with_evidence(scores, none).collect()] == [(1, 0, 0.24)]
    assert {(r["i"], r["j"]): r["v"] for r in scoring.normalised(scores).collect()} == {(1, 0): 1.0, (0, 1): 1.0}


def test_query_text(spark):
    words = spark.createDataFrame([(1, "k", "f", "p"), (2, "", "f", "p"), (3, "x", "f", "p")], "qid int, norm_key string, f string, p string")
    raw = spark.createDataFrame([("k", "raw"), ("", "never")], "norm_key string, raw_key string")
    assert {r["qid"]: r["text"] for r in scoring.query_text(words, raw).collect()} == {1: "k\x03raw\x03f\x03p", 2: "\x03f\x03p", 3: "x\x03f\x03p"}


def test_params():
    assert Params().decay == single(0.6) != 0.6
    for bad in (dict(decay=0), dict(iterations=1), dict(evidence_default=0.6), dict(prune="x")):
        with pytest.raises(ValueError):
            Params(**bad)


@pytest.mark.parametrize("denominator", ["sum", "product"])
def test_classic_against_loops(spark, denominator):
    pairs = [("a", "c"), ("b", "c"), ("a", "d"), ("b", "d"), ("c", "a"), ("d", "b")]
    links = spark.createDataFrame([(x, y, 1.0) for x, y in pairs] + [("a", "e", 0.0)], "src string, dst string, weight double")
    got = {(r["x"], r["y"]): r["s"] for r in classic.classic_simrank(links, iterations=3, denominator=denominator).collect()}
    nodes = "abcd"
    fans = {v: [x for x, y in pairs if y == v] for v in nodes}
    s = {(x, y): float(x == y) for x in nodes for y in nodes}
    for _ in range(3):
        new = dict(s)
        for x in nodes:
            for y in nodes:
                if x != y:
                    d = len(fans[x]) + len(fans[y]) if denominator == "sum" else len(fans[x]) * len(fans[y])
                    new[x, y] = 0.8 / d * sum(s[i, j] for i in fans[x] for j in fans[y]) if d else 0.0
        s = new
    for (x, y), v in got.items():
        assert v == pytest.approx(s[x, y])
    assert all((x, y) in got for (x, y), v in s.items() if v > 0 and x >= y)
    asked = spark.createDataFrame([("c", "d"), ("d", "c"), ("a", "a"), ("a", "zz")], "x string, y string")
    found = {(r["x"], r["y"]): r["s"] for r in classic.similarity_of(classic.classic_simrank(links, iterations=3, denominator=denominator), asked).collect()}
    assert found["c", "d"] == found["d", "c"] == pytest.approx(s["c", "d"]) and found["a", "a"] == 1 and found["a", "zz"] == 0
