import hashlib
import random
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from linkloom.llm import substrings
from linkloom.llm.suffixes import suffix_order

from .helpers import ODD_ROWS, docs_of, table


def brute(rows):
    """Per id, sorted (n_bytes, n_removed, n_spans, sha256, kept) of its rows."""
    seen, out = set(), {}
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode())):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 99):
            window = b[i : i + 100]
            if window in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(window)
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.setdefault(doc, []).append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept))
    return {k: sorted(v) for k, v in out.items()}


def found(df):
    out = {}
    for r in substrings.removed(df).collect():
        out.setdefault(r["doc_id"], []).append((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"], bytes(r["kept"])))
    return {k: sorted(v) for k, v in out.items()}


def passages(seed):
    rng = random.Random(seed)
    words = ["ab", "cde", "f", "gh é", "zz\n", "x\0y", "漢字"]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    known = [say(rng.randint(5, 80)) for _ in range(12)]
    return [(i, rng.choice(known)[rng.randint(0, 30) :] + say(rng.randint(0, 40)) + rng.choice(known)) for i in range(150)], known


@pytest.mark.parametrize("seed", range(2))
def test_against_brute_force(spark, seed):
    rows, known = passages(seed)
    rows += [(None, known[0] * 3), (None, known[0] * 3), (5, known[1] + known[2]), (5, known[1] + known[2]), (7, None), (902, "q" * 99), (903, "q" * 100), (904, "q" * 101)]
    # Repetitions of every period up to beyond the reach of a minimizer.
    rows += [(1000 + p, "".join(chr(97 + (i * 7 + p) % 26) + str(i) for i in range(p))[:p] * (600 // p)) for p in range(1, 130, 4)]
    rows += [(1130, "".join(chr(33 + i) for i in range(61)) * 5), (1131, "".join(chr(34 + i) for i in range(60)) * 5)]
    df = docs_of(spark, rows, 5)
    assert found(df) == brute(rows)


def test_odd_rows_and_empty(spark):
    assert found(docs_of(spark, ODD_ROWS)) == brute([r[:2] for r in ODD_ROWS])
    assert found(docs_of(spark, ODD_ROWS).limit(0)) == {}


def test_real_texts(spark):
    docs = table(spark, "documents")
    assert found(docs) == brute([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_without_repeats(spark):
    twice = "abcdefghij" * 12
    rows = [(1, "start " + twice, "en", "s"), (2, twice + " end é", "en", "t"), (3, "start " + twice, "de", "u"), (4, None, "de", "u"), (4, None, "de", "u")]
    df = docs_of(spark, rows)
    got = {(r["doc_id"], r["source"]): (r["text"], r["n_chars"]) for r in substrings.without_repeats(df).collect()}
    assert set(got) == {(1, "s"), (2, "t"), (4, "u")} and got[2, "t"] == (" end é", 6) and got[4, "u"] == (None, None)
    assert substrings.without_repeats(df).columns == df.columns and substrings.without_repeats(df).count() == 4


@pytest.mark.parametrize("memory", [8, 50, 1 << 20])
@pytest.mark.parametrize("cap", [4, 100])
def test_suffix_order(tmp_path, memory, cap):
    rng = np.random.default_rng(memory + cap)
    for _ in range(25):
        x = rng.integers(0, int(rng.integers(1, 5)) + 1, int(rng.integers(1, 220))).astype(np.uint8)
        x = np.concatenate([x, x[: len(x) // 2], x])
        b = x.tobytes()
        blocks = list(suffix_order(x, cap, memory, Path(tmp_path)))
        at = np.concatenate([p for p, _ in blocks])
        common = np.concatenate([c for _, c in blocks])
        assert sorted(at) == list(range(len(b)))
        want = sorted(range(len(b)), key=lambda i: b[i:])
        assert [b[i : i + cap] for i in at] == [b[i : i + cap] for i in want]
        for k in range(1, len(at)):
            u, v = b[at[k - 1] :][:cap], b[at[k] :][:cap]
            assert common[k] == next((i for i, (p, q) in enumerate(zip(u, v)) if p != q), min(len(u), len(v)))


def test_small_memory_gives_the_same(spark, monkeypatch):
    rows, _ = passages(9)
    whole = substrings.sort_regions
    monkeypatch.setattr(substrings, "sort_regions", lambda r: whole(r, memory=500))
    assert found(docs_of(spark, rows)) == brute(rows)


def test_texts_that_share_minimizers_only(spark):
    """Blocks of one string of a low hash, a filler and a letter: no 100 bytes are equal."""
    rng = random.Random(3)
    candidates = ["".join(rng.choice("abcdefghijklmnop") for _ in range(40)) for _ in range(3000)]
    gram = min(candidates, key=lambda c: int(substrings.runs(np.frombuffer((c + "~" * 60).encode(), np.uint8), np.array([0, 100]))[3].view(np.uint64)[0]))
    filler = [f"{i:05d}" + "".join(rng.choice("qrstuvwxyz") for _ in range(13)) for i in range(1024)]
    letter = [i.bit_count() % 2 for i in range(1024)]
    texts = ["".join(gram + f + "XY"[c ^ flip] for f, c in zip(filler, letter)) for flip in (0, 1)]
    got = found(docs_of(spark, list(enumerate(texts))))
    assert [got[i][0][:3] for i in (0, 1)] == [(len(texts[0]), 0, 0)] * 2


def test_hot_groups(spark):
    rng = random.Random(8)
    say = lambda n: " ".join(f"{rng.choice('abcdef')}{rng.randint(0, 9999)}" for _ in range(n))
    copy, line = say(300), say(25)
    rows = [(i, copy) for i in range(400)] + [(1000 + i, say(10) + " " + line + " " + say(12)) for i in range(300)]
    near = copy.split()
    for i in range(150):
        words = near[:]
        for _ in range(6):
            words[rng.randrange(300)] = "new"
        rows.append((2000 + i, " ".join(words)))
    rng.shuffle(rows)
    assert found(docs_of(spark, rows, 2)) == brute(rows)


def test_long_text(spark):
    rng = random.Random(5)
    part = "".join(rng.choice("abcdefgh ") for _ in range(700_000))
    long = part + "".join(rng.choice("abcdefgh ") for _ in range(800_000)) + part[100_000:160_000] + "zz"
    rows = [(2, long), (1, part[500_000:500_400]), (3, None), (4, long[1_400_000:1_400_099])]
    assert found(docs_of(spark, rows, 2)) == brute(rows)


def test_slices_of_a_long_text(monkeypatch):
    rng = np.random.default_rng(1)
    text = pa.array([rng.integers(97, 101, 5000).astype(np.uint8).tobytes()], pa.binary())

    def windows(rows):
        _, at, until, gram, before, after, _ = rows
        assert np.array_equal(before[1:], gram[:-1]) and np.array_equal(after[:-1], gram[1:]) and before[0] == after[-1] == 0
        return {p: g for a, b, g in zip(at, until, gram) for p in range(a, b - substrings.LENGTH + 1)}

    whole = windows(substrings._runs_of(text))
    assert len(whole) == 4901
    for size in (300, 777, 4900, 4901):
        monkeypatch.setattr(substrings, "SLICE", size)
        assert windows(substrings._runs_of(text)) == whole


def test_sort_on_disk(tmp_path):
    """A text far larger than the memory of the queues, with levels of names below."""
    rng = np.random.default_rng(4)
    words = [rng.integers(97, 123, int(rng.integers(2, 9))).astype(np.uint8).tobytes() for _ in range(400)]
    x = np.frombuffer(b" ".join(words[int(i)] for i in rng.integers(0, 400, 30_000)), np.uint8)
    x = np.concatenate([x, x[20_000:60_000], np.full(3000, 97, np.uint8)])
    order = lambda memory: np.concatenate([at for at, _ in suffix_order(x, 100, memory, tmp_path)])
    b, small, large = x.tobytes(), order(2000), order(1 << 22)
    assert np.array_equal(np.sort(small), np.arange(len(x))) and not list(tmp_path.iterdir())
    assert [b[i : i + 100] for i in small] == [b[i : i + 100] for i in large] == sorted(b[i : i + 100] for i in range(len(b)))
