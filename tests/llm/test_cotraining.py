import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkloom.llm import cotraining

from .helpers import ODD_ROWS, docs_of, table


def test_held_out_accuracy(spark):
    docs, labels = table(spark, "documents", "sf0.1"), table(spark, "labels", "sf0.1")
    seen = labels.filter(F.col("doc_id") % 2 == 0)
    scored = cotraining.score(docs, seen, cotraining.Fit(labelled=1500)).select("doc_id", "kept")
    rows = scored.join(labels.filter(F.col("doc_id") % 2 == 1), "doc_id").collect()
    good, bad = [r["kept"] for r in rows if r["quality"] == 1], [r["kept"] for r in rows if r["quality"] == 0]
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.2 and scored.count() == docs.count()


def test_odd_rows(spark):
    docs, labels = table(spark, "documents"), table(spark, "labels")
    odd = docs_of(spark, ODD_ROWS).select(F.col("doc_id") + 10_000, *docs.columns[1:]).toDF(*docs.columns).withColumn("kept", F.lit("clash")).withColumn("quality_score", F.lit("x"))
    both = docs.withColumns({"kept": F.lit(""), "quality_score": F.lit("")}).unionByName(odd)
    odd_labels = spark.createDataFrame([(10_001, None, 0), (None, 1, 0), (999_999, 0, 0), (10_002, 1, 0), (10_002, 0, 0)], "doc_id long, quality int, toxic int")
    got = cotraining.score(both, labels.unionByName(odd_labels, allowMissingColumns=True))
    assert got.columns == both.columns and got.count() == both.count()
    assert got.filter("quality_score is null or quality_score < 0 or quality_score > 1").count() == 0
    same = cotraining.score(both.repartition(5), labels.unionByName(odd_labels, allowMissingColumns=True))
    assert same.select("doc_id", "kept").exceptAll(got.select("doc_id", "kept")).count() == 0


def test_without_labels(spark):
    docs, labels = docs_of(spark, ODD_ROWS), spark.createDataFrame([], "doc_id long, quality int")
    got = cotraining.score(docs, labels).collect()
    assert len(got) == len(ODD_ROWS) and all(r["kept"] and r["quality_score"] is None for r in got)
    one = spark.createDataFrame([(4, 1), (5, 1)], "doc_id long, quality int")
    assert all(r["kept"] for r in cotraining.score(docs, one).collect())
    assert cotraining.score(docs.limit(0), one).collect() == []


def test_each_view_teaches_the_other():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 900)
    clear, weak = rng.normal(0, 0.2, (900, 4)) + y[:, None], rng.normal(0, 1.0, (900, 30)) + np.where(np.arange(30) < 5, 1.0, 0.0) * y[:, None]
    ids = np.arange(40, 900)

    def model(fit):
        find = lambda models, taught: (cotraining.surest(models, (clear[40:], weak[40:]), ids, taught, fit), {i: (clear[i], weak[i]) for i in ids})
        return cotraining.co_train((clear[:40], weak[:40]), y[:40], fit, find)

    with_rounds, without = model(cotraining.Fit(rounds=3, sure=0.9)), model(cotraining.Fit(rounds=0))
    right = lambda m, x: np.mean((m.score(x)[40:] > 0) == (y[40:] == 1))
    assert right(with_rounds.metadata, weak) > right(without.metadata, weak) + 0.03
    assert np.mean((with_rounds.probability(clear, weak) > 0.5) == (y == 1)) > 0.9


def plain_features(text):
    """Features of one text, character by character and word by word."""
    b = (text or "").encode()
    kinds = dict.fromkeys(cotraining.KINDS, 0)
    for c in b:
        ch = chr(c)
        kind = "wide" if c > 127 else "upper" if ch.isupper() else "lower" if ch.islower() else "digit" if ch.isdigit() else "feed" if ch == "\n" else "space" if ch in " \t\x0b\x0c\r" else "stop" if ch in ".,;:?'\"()-" else "symbol" if ch in "#*$%&<>@^~" else "bang" if ch == "!" else "bar" if ch == "|" else "mark"
        kinds[kind] += 1
    words, full = b.split(), (1 << 64) - 1
    odd, buckets, seen = 0x9E3779B97F4A7C15, [0] * cotraining.BUCKETS, set()
    for w in words:
        h = 0
        for k, c in enumerate(w):
            m = (c + 1) * (2 * k + 1) * odd & full
            h = h + (m ^ (m >> 29)) & full
        h = (h ^ (h >> 31)) * odd & full
        buckets[h >> 56] += 1
        seen.add(h)
    n = max(len(words), 1)
    dense = [math.log1p(100 * v / max(len(b), 1)) for v in kinds.values()] + [len(b) / n / 10, len(seen) / n, math.log1p(len(words)), float(len(words) < 10)]
    return np.array(dense + [x / n for x in buckets], np.float32)


def brute_scores(rows, labels, fit):
    """Scores of (doc_id, text, lang, source, n_chars) rows: the rounds over plain lists of all documents."""
    text = {r[0]: plain_features(r[1]) for r in rows}
    meta = {r[0]: cotraining.metadata_features([r[2]], [r[3]], [r[4]])[0] for r in rows}
    views = (text, meta)
    known = sorted((d for d in labels if d in text), key=lambda d: (zlib.crc32(str(d).encode()), d))
    held = known[:: fit.hold]
    sets = [[(d, labels[d]) for d in known if d not in set(held)] for _ in (0, 1)]
    share = np.mean([y for _, y in sets[0]])
    model = lambda v: cotraining.Linear.fit(np.array([views[v][d] for d, _ in sets[v]]), np.array([float(y) for _, y in sets[v]]), fit.ridge)
    models = [model(0), model(1)]
    for _ in range(fit.rounds):
        sure = [{d: round(float(cotraining.sigmoid(models[v].score(views[v][d][None]))[0]), 9) for d in text if d not in labels} for v in (0, 1)]
        for v in (0, 1):
            learnt = {d for d, _ in sets[1 - v]}
            for label, most in ((1, round(fit.each * share)), (0, round(fit.each * (1 - share)))):
                ranked = sorted((-(p if label else 1 - p), d) for d, p in sure[v].items() if d not in learnt)
                sets[1 - v] += [(d, label) for s, d in ranked[:most] if -s >= fit.sure]
        models = [model(0), model(1)]
    both = lambda ds: np.column_stack([models[v].score(np.array([views[v][d] for d in ds])) for v in (0, 1)])
    last = cotraining.Linear.fit(both(held), np.array([float(labels[d]) for d in held]), fit.ridge)
    ids = list(text)
    return dict(zip(ids, cotraining.sigmoid(last.score(both(ids)))))


@pytest.mark.parametrize("sf, fit", [("sf0.001", cotraining.Fit(each=30, sure=0.8)), ("sf0.01", cotraining.Fit())])
def test_scores_against_brute_force(spark, sf, fit):
    docs = table(spark, "documents", sf)
    labels = {r["doc_id"]: r["quality"] for r in table(spark, "labels", sf).collect()}
    want = brute_scores([(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in docs.collect()], labels, fit)
    got = {r["doc_id"]: r for r in cotraining.score(docs, table(spark, "labels", sf), fit).collect()}
    assert set(got) == set(want)
    assert max(abs(got[d]["quality_score"] - want[d]) for d in want) < 1e-4
    assert all(got[d]["kept"] == (want[d] >= fit.keep) for d in want if abs(want[d] - fit.keep) > 1e-4)


def test_text_features():
    texts = ["", "A b\nb", "é! ###"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    bounds = np.cumsum([0, *(len(t.encode()) for t in texts)])
    got = cotraining.text_features(data, bounds)
    assert got.shape == (3, cotraining.DENSE + cotraining.BUCKETS) and got.dtype == np.float32
    kinds = dict(zip(cotraining.KINDS, got[1]))
    share = lambda x: np.float32(np.log1p(100 * x))
    assert kinds["space"] == kinds["feed"] == kinds["upper"] == share(0.2) and kinds["lower"] == share(0.4)
    # Words A, b, b: two of three are distinct. Seven bytes with three symbols.
    assert got[1, len(cotraining.KINDS) + 1] == np.float32(2 / 3) and got[2, cotraining.KINDS.index("symbol")] == share(3 / 7)
    alone = cotraining.text_features(data[: bounds[2]], bounds[:3])
    assert np.array_equal(alone, got[:2])
