from collections import Counter

import corpus_pipeline as pipeline
from linkloom.llm import cotraining, mixing
from linkloom.storage import stage

from .helpers import BPE, ODD_ROWS, docs_of, table
from .test_similar import brute_similar
from .test_substrings import brute as brute_removal
from .test_tokens_packing import check_packing

SF = "/root/testdata/sf0.001"


def test_names_and_order():
    assert [n for n, _ in pipeline.STAGES] == ["quality classifier", "SimHash near-dedup", "suffix-array dedup", "mixing sources", "best-fit packing"]


def test_every_stage_against_brute_force(spark):
    docs = table(spark, "documents")
    labels = table(spark, "labels")
    columns, given, results = docs.columns, docs, []
    for k, (_, function) in enumerate(pipeline.STAGES):
        given = stage(function(spark, given, SF), f"test-{k}")
        results.append(given)
        assert k == 4 or given.columns == columns
    texts = [{(r["doc_id"], r["text"]) for r in d.collect()} for d in [docs, *results[:4]]]
    kept = {r["doc_id"] for r in cotraining.score(docs, labels).filter("kept").collect()}
    assert {d for d, _ in texts[1]} == kept
    first = brute_similar(sorted(texts[1]))
    assert texts[2] == {(d, t) for d, t in texts[1] if d in first}
    left = {d: rows[0][4].decode("utf-8", "ignore") for d, rows in brute_removal(sorted(texts[2])).items()}
    assert texts[3] == {(d, t) for d, t in left.items() if t or not dict(texts[2])[d]}
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(results[2]).collect()}
    mixed = [(r["doc_id"], r["text"]) for r in results[3].collect()]
    assert Counter(d for d, _ in mixed) == +Counter(copies)
    assert all(r["n_chars"] == len(r["text"]) for r in results[2].collect())
    check_packing(mixed, results[4].collect(), 1024)
    assert BPE


def test_run_equals_the_stages(spark):
    got = pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and got.count() > 0


def test_odd_rows_pass_all_stages(spark):
    docs = docs_of(spark, ODD_ROWS).select("doc_id", "text", "lang", "source", "n_chars")
    for given in (docs, docs.limit(0)):
        for k, (_, function) in enumerate(pipeline.STAGES):
            given = stage(function(spark, given, SF), f"odd-{k}")
        assert given.columns[0] == "doc_id"
