"""Texts of about a megabyte pass every operator of texts whole."""

import random

import pytest

from linkloom.llm import cotraining, licenses, mixing, outliers, packing, similar, simhash, tokens

from .helpers import BPE, docs_of
from .test_native_operators import counts_of
from .test_simhash import print_of
from .test_tokens_packing import check_packing, crc, ids_of


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    words = [f"{rng.choice('abcdefgh')}{rng.randint(0, 40_000)}" for _ in range(150_000)]
    long = " ".join(words[:100_000]) + "\n" + " ".join(words[100_000:])
    other = long[: len(long) - 4] + " Released under the MIT License. end"
    return [(1, long), (2, other), (3, "short text"), (4, None), (5, "x" * 700_000)]


def test_counts_sizes_and_fingerprints(spark, rows):
    df = docs_of(spark, rows)
    columns = "n_words word_chars n_symbols n_dup_lines n_repeat_words".split()
    assert {r["doc_id"]: tuple(r[c] for c in columns) for r in outliers.quality_rules(df).collect()} == {d: counts_of(t) for d, t in rows}
    assert {r["doc_id"]: r["size"] for r in mixing.mix(df).collect()} == {d: counts_of(t)[0] for d, t in rows}
    found = {r["doc_id"]: r for r in simhash.near_duplicates(df).collect()}
    assert all(found[d]["fp"] % (1 << 64) == print_of(t) for d, t in rows) and found[2]["component_id"] == 1
    assert sorted(r["doc_id"] for r in similar.keep_first(df).collect()) == [1, 3, 4, 5]
    assert [(r["doc_id"], r["license"]) for r in licenses.scan(df).collect()] == [(2, "mit-line")]


def test_tokens_and_scores(spark, rows):
    df = docs_of(spark, rows)
    got = {r["doc_id"]: r for r in tokens.read_tokens(tokens.write_tokens(df, BPE, 0)).collect()}
    assert all((got[d]["n_tokens"], got[d]["ids_crc32"]) == (len(ids_of(t, 0)), crc(ids_of(t, 0))) for d, t in rows)
    check_packing(rows, packing.pack(df, BPE, 2).collect(), 1024)
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 0), (4, 0), (5, 0)], "doc_id long, quality int")
    assert cotraining.score(df, labels, cotraining.Fit(hold=2)).count() == 5
