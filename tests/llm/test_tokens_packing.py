import glob
import json
import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from linkloom.llm import packing, tokens
from linkloom.llm.queries import QUERIES

from .helpers import BPE, ODD_ROWS, docs_of, table

TOKENIZER = Tokenizer.from_file(BPE)


def ids_of(text, end):
    return np.asarray([*TOKENIZER.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def test_encoder_on_odd_strings():
    rng = random.Random(1)
    parts = ["a", "Z", "é", " ", "  ", "\n", "\n\n", " \n", "\t", " ", " ", "　", "'s", "'", "12", "!", "漢", "\x85", "\x1c", "­", "🙂", "<|endoftext|>", "don't", "\r\n", "́", " b", "\nx"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    encoder = tokens.Encoder(BPE, limit=50)
    ids, bounds = encoder.encode(pa.array([t.encode() for t in texts], pa.binary()), 3)
    for text, a, b in zip(texts, bounds[:-1], bounds[1:]):
        assert ids[a:b].tolist() == ids_of(text, 3).tolist(), repr(text)


def token_rows(rows):
    start, out = 0, []
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = ids_of(text, 0)
        out.append((doc, start, len(ids), crc(ids)))
        start += len(ids)
    return sorted(out, key=repr)


@pytest.mark.parametrize("rows", [[r[:2] for r in ODD_ROWS], []])
def test_token_files(spark, rows):
    written = tokens.write_tokens(docs_of(spark, rows), BPE, 0, row_group_bytes=1 << 16)
    got = sorted((tuple(r) for r in tokens.read_tokens(written).select("doc_id", "start", "n_tokens", "ids_crc32").collect()), key=repr)
    assert got == token_rows(rows)


def test_token_files_of_table(spark):
    docs = table(spark, "documents")
    written = tokens.write_tokens(docs, BPE, 0)
    got = sorted((tuple(r) for r in tokens.read_tokens(written).select("doc_id", "start", "n_tokens", "ids_crc32").collect()), key=repr)
    assert got == token_rows([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert "ids" not in written.select("doc_id", "n_tokens").filter("doc_id = 5")._jdf.queryExecution().executedPlan().toString()


def test_encodings_and_indexes(spark):
    written = tokens.write_tokens(table(spark, "documents", "sf0.01"), BPE, 0, row_group_bytes=1 << 18, page_bytes=1 << 14, page_rows=100)
    paths = glob.glob(written._staged_path.removeprefix("file://") + "/*.parquet")
    groups = [pq.ParquetFile(p).metadata.row_group(i) for p in paths for i in range(pq.ParquetFile(p).metadata.num_row_groups)]
    assert paths and len(groups) > len(paths)
    for group in groups:
        columns = {group.column(i).path_in_schema: group.column(i) for i in range(group.num_columns)}
        ids = columns.pop("ids.list.element")
        assert "RLE_DICTIONARY" in ids.encodings and ids.has_dictionary_page
        for name, column in columns.items():
            assert "DELTA_BINARY_PACKED" in column.encodings and not column.has_dictionary_page, name
        assert all(c.has_offset_index and c.has_column_index for c in [ids, *columns.values()])


def test_other_tokenizers_encode_whole_texts(tmp_path):
    spec = json.loads(TOKENIZER.to_str())
    assert tokens.breaks_at_spaces(spec)
    texts = ["Don't  stop.\n\nNow! ", "", "a b\tc", " x  y"]
    for change in ({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": spec["pre_tokenizer"] | {"add_prefix_space": True}}, {"pre_tokenizer": spec["pre_tokenizer"] | {"use_regex": False}}):
        path = tmp_path / "other.json"
        path.write_text(json.dumps(spec | change))
        encoder, other = tokens.Encoder(str(path)), Tokenizer.from_file(str(path))
        assert not encoder.cuts
        ids, bounds = encoder.encode(pa.array([t.encode() for t in texts], pa.binary()), 3)
        assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == [[*other.encode(t, add_special_tokens=False).ids, 3] for t in texts]


def test_token_files_of_one_hot_id(spark):
    rows = [(None, f"text {i % 7} of no id") for i in range(400)] + [(5, "same")] * 300 + [(i, f"w{i}") for i in range(40)]
    written = tokens.write_tokens(docs_of(spark, rows), BPE, 0)
    got = sorted(((r["start"], r["doc_id"], r["n_tokens"]) for r in tokens.read_tokens(written).collect()), key=lambda r: r[0])
    assert len(got) == len(rows) and all(a + n == b for (a, _, n), (b, _, _) in zip(got, got[1:])) and got[0][0] == 0
    assert [d for _, d, _ in got] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d or 0))


def check_packing(rows, got, capacity, longest=None):
    longest = longest or capacity
    texts = {}
    for doc, text in rows:
        texts.setdefault(doc, []).append(ids_of(text, 2))
    pieces = {}
    for r in got:
        pieces.setdefault(r["doc_id"], []).append(r)
    assert set(pieces) == set(texts)
    for doc, own in pieces.items():
        want = []
        for ids in texts[doc]:
            n, at, k = len(ids), 0, 0
            while at < n:
                size = n if n <= longest else ((n - at) % longest or longest)
                want.append((k, at, size, crc(ids[at : at + size])))
                at, k = at + size, k + 1
        assert sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in own) == sorted(want)
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), sum(r["length"] for r in got)


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_packing(spark, rule):
    rows = [r[:2] for r in ODD_ROWS]
    got = packing.pack(docs_of(spark, rows), BPE, 2, packing.Bin(rule=rule)).collect()
    check_packing(rows, got, 1024)
    assert packing.pack(docs_of(spark, []), BPE, 2).collect() == []


def test_packing_of_table(spark):
    docs = table(spark, "documents")
    got = packing.pack(docs, BPE, 2).collect()
    bins, total = check_packing([(r["doc_id"], r["text"]) for r in docs.collect()], got, 1024)
    assert bins <= 1.03 * total / 1024 + 2


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_every_constraint_holds(rule):
    rng = random.Random(2)
    histogram = {n: rng.randint(1, 40) for n in range(1, 101, 3)}
    shape = packing.Bin(tokens=100, documents=3, attention=6000, rule=rule, weights=(1, 1, 1))
    with pytest.raises(ValueError):
        packing.best_fit({80: 1}, shape)
    histogram = {n: c for n, c in histogram.items() if n * n <= 6000}
    length, first, start, per, offset = packing.best_fit(histogram, shape).arrays()
    bins = {}
    for n, count in histogram.items():
        for rank in range(count):
            i = max(k for k in range(len(length)) if length[k] == n and first[k] <= rank)
            bins.setdefault(start[i] + (rank - first[i]) // per[i], []).append(n)
    assert all(sum(b) <= 100 and len(b) <= 3 and sum(x * x for x in b) <= 6000 for b in bins.values())
    assert sum(map(len, bins.values())) == sum(histogram.values())


def test_packing_under_every_limit(spark):
    got = QUERIES["vector_packing"](spark, "/root/testdata/sf0.001").collect()
    rows = [(r["doc_id"], r["text"]) for r in table(spark, "documents").collect()]
    n_bins, _ = check_packing(rows, got, 1024, 640)
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append(r["length"])
    used = np.array([(sum(b), len(b), sum(x * x for x in b)) for b in bins.values()])
    assert (used <= [1024, 4, 640 * 640]).all()
    lengths, fewest = sorted(r["length"] for r in got), {}
    for name, shape in (("tokens", packing.Bin()), ("documents", packing.Bin(documents=4)), ("attention", packing.Bin(attention=640 * 640))):
        fewest[name] = packing.best_fit({n: lengths.count(n) for n in set(lengths)}, shape).bins
    # Each limit makes a difference of its own.
    assert fewest["tokens"] < fewest["attention"] < n_bins and (used[:, 1] == 4).any() and (used[:, 0] > 1000).any() and (used[:, 2] > 0.99 * 640 * 640).any()
