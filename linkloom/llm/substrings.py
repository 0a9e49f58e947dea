"""Operator 1: exact substring dedup by suffix arrays of shards.

A byte is removed if it lies in a string of ``LENGTH`` bytes that also starts
earlier, in a document of smaller id or before in the same one.

1. Every window of ``LENGTH`` bytes has a minimizer: the least hash of the
   ``GRAM``-byte strings in it. Equal windows have equal minimizers. Neighbouring
   windows of one minimizer form a run; the bytes that they cover are its region.
   A run whose minimizer occurs once in the corpus holds no repeat and is left out.
2. Runs that always stand next to each other, wherever they occur, are joined into
   one region, so that long copies are dealt out once and not run by run.
3. All regions that share minimizers meet in a shard, and each shard's suffixes are
   sorted by external induced sorting. Suffixes that agree on ``LENGTH`` bytes are
   the equal windows; all but the earliest are repeats. Hashes only choose what
   meets: no byte goes unless its window was found equal in the sorted order, or in
   a comparison of bytes (4).
4. A minimizer or region that one task sees very often is pre-aggregated there: of
   more than ``OFTEN`` regions with the same bytes only the earliest goes on.
5. The repeats found, merged into intervals, are joined with the texts.
"""

from __future__ import annotations

import functools
import hashlib
import tempfile
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, give_back, keyed_texts, stage, unstage
from .suffixes import suffix_order
from .tokens import text_blocks

LENGTH, GRAM = 100, 40
#: Strings of ``GRAM`` bytes in a window.
REACH = LENGTH - GRAM + 1
#: Most window starts in a piece of a region that goes to a shard.
PIECE = 1024
#: Rows of one minimizer, and equal regions, that a task passes on one by one.
HOT, OFTEN = 64, 16
#: Longest part of a text that is searched for runs at once.
SLICE = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


@functools.lru_cache(maxsize=1)
def _values() -> np.ndarray:
    return _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


@functools.lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2 ** 64, ``n`` of each."""
    up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    up[:1] = down[:1] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _window(op, x: np.ndarray, width: int) -> np.ndarray:
    """``op`` over ``width`` neighbours from each place on; the last width - 1 places are missing."""
    step, out = 1, x
    while 2 * step <= width:
        out = op(out[:-step], out[step:])
        step *= 2
    return op(out[: len(x) - width + 1], out[width - step :]) if width > step else out


def runs(data: np.ndarray, bounds: np.ndarray):
    """Runs of windows that share a minimizer, of texts one after the other, at ``bounds``.

    Per run: text number, first place and end of its region, minimizer, and whether the
    region may hold its minimizer twice.
    """
    n = len(data)
    empty = np.zeros(0, np.int64)
    if n < LENGTH:
        return empty, empty, empty, empty, np.zeros(0, bool)
    up, down = _powers(1 << max(19, (n + 1).bit_length()))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_values()[data] * up[:n])])
    grams = _mix((sums[GRAM:] - sums[: n - GRAM + 1]) * down[: n - GRAM + 1]) | np.uint64(1)
    least = _window(np.minimum, grams, REACH)  # one for each window start
    for end in bounds[1:-1]:  # windows that reach into the next text
        least[max(0, int(end) - LENGTH + 1) : int(end)] = 0
    first = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    last = np.r_[first[1:], len(least)] - 1
    real = least[first] > 0
    first, last = first[real], last[real]
    # Places of minimizers, and those whose next equal one lies in the same run.
    edge = np.zeros(REACH - 1, np.uint64)
    at = np.flatnonzero(_window(np.maximum, np.concatenate([edge, least, edge]), REACH) == grams)
    at = at[np.argsort(grams[at], kind="stable")]
    pair = np.flatnonzero((grams[at[1:]] == grams[at[:-1]]) & (at[1:] - at[:-1] <= REACH))
    twice = np.zeros(len(least) + 1, np.int64)
    np.add.at(twice, np.maximum(at[pair + 1] - REACH, 0), 1)
    np.add.at(twice, np.minimum(at[pair] + 1, len(least)), -1)
    doubled = np.concatenate([[0], np.cumsum(np.cumsum(twice)[:-1] > 0)])
    own = doubled[last + 1] > doubled[first]
    text, until = np.searchsorted(bounds, first, side="right") - 1, last + LENGTH
    return text, first - bounds[text], until - bounds[text], least[first].view(np.int64), own


def _merged(doc: np.ndarray, first: np.ndarray, last: np.ndarray):
    """Intervals [first, last) of documents, sorted, with those that touch made one."""
    order = np.lexsort((first, doc))
    doc, first, last = doc[order], first[order], last[order]
    if not len(doc):
        return doc, first, last
    change = np.r_[True, doc[1:] != doc[:-1]]
    # Running maximum of the ends inside a document; places are below 2 ** 62.
    reach = last.copy()
    for a, b in zip(np.flatnonzero(change), np.r_[np.flatnonzero(change)[1:], len(doc)]):
        reach[a:b] = np.maximum.accumulate(last[a:b])
    fresh = change | np.r_[True, first[1:] > reach[:-1]]
    begins = np.flatnonzero(fresh)
    return doc[begins], first[begins], reach[np.r_[begins[1:], len(doc)] - 1]


#: ``until``: twice the end of the region, plus 1 if it may hold its minimizer twice; less than
#: zero if the row is known to be open. ``at`` is -1 in a row that only says that other rows of
#: its minimizer are known to be open.
MARKS = "gram long, before long, after long, doc long, at long, until long"
#: ``joins``: 1 if the run before is the same at all rows of the minimizer, 2 if the one after is.
OPEN = "gram long, doc long, at long, until long, joins int"


def _batch(schema: str, columns) -> pa.RecordBatch:
    names, kinds = zip(*(c.split() for c in schema.split(", ")))
    of = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.record_batch([pa.array(x, of[k]) for x, k in zip(columns, kinds)], names=list(names))


def _runs_of(texts: pa.Array):
    """``runs`` of a block of texts, with the minimizers of the runs before and after (0 at the ends)."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    size, begin = int(offsets[-1] - offsets[0]), int(offsets[0])
    data = np.frombuffer(texts.buffers()[2], np.uint8, size, offset=begin) if size else np.zeros(0, np.uint8)
    if len(texts) > 1 or size <= SLICE:
        text, at, until, gram, own = runs(data, offsets - begin)
    else:  # one long text: slices of window starts
        parts = [(k, runs(data[k : k + SLICE + LENGTH - 1], np.array([0, min(SLICE + LENGTH - 1, size - k)]))) for k in range(0, size - LENGTH + 1, SLICE)]
        text, at, until, gram, own = (np.concatenate([x[i] + (k if i in (1, 2) else 0) for k, x in parts]) for i in range(5))
    edge = np.r_[True, text[1:] != text[:-1]][: len(text)]
    before, after = np.r_[0, gram[:-1]][: len(gram)], np.r_[gram[1:], 0][: len(gram)]
    before[edge], after[np.r_[edge[1:], True][: len(edge)]] = 0, 0
    return text, at, until, gram, before, after, own


def mark_runs(texts: DataFrame, most_rows: int = 250_000) -> DataFrame:
    """``MARKS`` of the runs of ``doc, text``.

    Of a minimizer that ``HOT`` rows or more of a buffer hold, the rows are known to be open and
    can be dealt out at will; one row alone tells the others of the minimizer so.
    """

    def run(batches):
        held: list[tuple] = []

        def flush():
            gram, before, after, doc, at, until = map(np.concatenate, zip(*held))
            held.clear()
            order = np.argsort(gram, kind="stable")
            sorted_ = gram[order]
            begins = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]][: len(order)])
            counts = np.diff(np.r_[begins, len(order)])
            often = counts >= HOT
            hot = order[np.repeat(often, counts)]
            until[hot] = -until[hot]
            if often.any():
                told = sorted_[begins[often]]
                none = np.zeros(len(told), np.int64)
                yield _batch(MARKS, (told, none, none, none, none - 1, none))
            for k in range(0, len(gram), 100_000):
                yield _batch(MARKS, [x[k : k + 100_000] for x in (gram, before, after, doc, at, until)])

        for batch in batches:
            for docs, some in text_blocks([batch], 1 << 17):
                text, at, until, gram, before, after, own = _runs_of(some)
                held.append((gram, before, after, np.asarray(docs)[text], at, 2 * until + own))
                if sum(len(x[0]) for x in held) > most_rows:
                    yield from flush()
        if held:
            yield from flush()

    return texts.mapInArrow(frugal(run), MARKS)


def open_runs(marks: DataFrame, most_rows: int = 1 << 16) -> DataFrame:
    """``OPEN`` rows of the runs that can hold repeats.

    Of a minimizer of more than ``most_rows`` rows the rows pass as they come, joined to nothing.
    """

    def run(batches):
        held = [np.zeros(0, np.int64)] * 6
        passing = None

        def as_they_come(gram, before, after, doc, at, until):
            real = at >= 0
            return _batch(OPEN, (gram[real], doc[real], at[real], np.abs(until[real]) >> 1, np.zeros(real.sum(), np.int32)))

        def settle(gram, before, after, doc, at, until):
            begins = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]])
            counts = np.diff(np.r_[begins, len(gram)])
            same = lambda x: np.minimum.reduceat(x, begins) == np.maximum.reduceat(x, begins)
            told = np.minimum.reduceat(at, begins) < 0
            joins = np.where(told, 0, same(before) + 2 * same(after)).astype(np.int32)
            wanted = (counts > 1) | (np.maximum.reduceat(until & 1, begins) > 0)
            rows = np.repeat(wanted, counts) & (at >= 0)
            return _batch(OPEN, (gram[rows], doc[rows], at[rows], until[rows] >> 1, np.repeat(joins, counts)[rows]))

        for batch in batches:
            new = [np.asarray(x) for x in batch.columns]
            at_once = new[5] < 0
            if passing is not None:
                at_once |= new[0] == passing
            if at_once.any():
                yield as_they_come(*(x[at_once] for x in new))
                new = [x[~at_once] for x in new]
            held = [np.concatenate(x) for x in zip(held, new)]  # from here on by minimizer
            if len(held[0]):
                whole = int(np.searchsorted(held[0], held[0][-1]))  # the last minimizer may go on
                if whole:
                    yield settle(*[x[:whole] for x in held])
                held = [x[whole:] for x in held]
            if len(held[0]) > most_rows:
                passing = held[0][0]
                yield as_they_come(*held)
                held = [x[:0] for x in held]
        if len(held[0]):
            yield settle(*held)

    # Rows known to be open go anywhere, the others by minimizer; one long sorts fastest.
    dealt = F.when(F.col("until") < 0, F.xxhash64("doc", "at")).otherwise(F.col("gram"))
    return marks.repartition(dealt).sortWithinPartitions("gram").mapInArrow(frugal(run), OPEN)


#: A region's bytes, or no bytes and the end of an interval that is known to repeat.
REGIONS = "part long, doc long, at long, until long, region binary"


def regions_of(texts: DataFrame, open_: DataFrame) -> DataFrame:
    """``REGIONS`` of open runs; ``at`` is where a region starts, ``part`` the minimizer that its shard goes by.

    Runs are joined where each is the only neighbour of the other, so every occurrence
    of a minimizer is joined in the same way and all go by the first one's.
    """
    per_text = open_.groupBy("doc").agg(F.collect_list(F.struct("gram", "at", "until", "joins")).alias("marks"))
    joined = texts.select("doc", "text").join(per_text, "doc").select("doc", "text", "marks")

    def stretches(marks: pa.ListArray):
        """Text number, minimizer, first place and end of joined runs."""
        at = np.asarray(marks.offsets)
        fields = marks.values.slice(at[0], at[-1] - at[0])
        gram, first, until, joins = (np.asarray(fields.field(i)) for i in range(4))
        text = np.repeat(np.arange(len(marks)), np.diff(at))
        order = np.lexsort((first, text))
        text, gram, first, until, joins = (x[order] for x in (text, gram, first, until, joins))
        on = (text[1:] == text[:-1]) & (first[1:] == until[:-1] - LENGTH + 1) & (joins[1:] & 1 > 0) & (joins[:-1] & 2 > 0)
        begins = np.flatnonzero(np.r_[True, ~on])
        return text[begins], gram[begins], first[begins], until[np.r_[begins[1:], len(text)] - 1]

    def run(batches):
        rows, size = [], 0

        def flush():
            by_bytes: dict[tuple, list[int]] = {}
            for i, row in enumerate(rows):
                by_bytes.setdefault((row[0], row[4]), []).append(i)
            for same in by_bytes.values():
                if len(same) > OFTEN:
                    for i in sorted(same, key=lambda i: rows[i][1:3])[1:]:
                        _, doc, at, until, _ = rows[i]
                        rows[i] = ((doc * 31 + at) * _BASE & (1 << 63) - 1, doc, at, until, None)
            out = _batch(REGIONS, zip(*rows))
            rows.clear()
            return out

        for batch in batches:
            if not len(batch):
                continue
            docs, texts = batch.column(0).to_pylist(), batch.column(1)
            last, view = None, None
            for t, gram, a, b in zip(*(x.tolist() for x in stretches(batch.column(2)))):
                if t != last:
                    last, view = t, memoryview(texts[t].as_buffer())
                for start in range(a, b - LENGTH + 1, PIECE):
                    end = min(b, start + PIECE + LENGTH - 1)
                    rows.append((gram, docs[t], start, end, bytes(view[start:end])))
                    size += end - start
                if size > 4 << 20:
                    yield flush()
                    size = 0
        if rows:
            yield flush()

    return joined.mapInArrow(frugal(run), REGIONS)


INTERVALS = "doc long, at long, until long"


def _mark_repeats(order, age: np.ndarray, begins: np.ndarray, ends: np.ndarray, marks: np.ndarray, most: int = 1 << 18) -> None:
    """Sets ``marks`` at the windows of a sorted shard that also start earlier, a block at a time.

    ``age`` tells for each region where it would begin if regions lay in the order of their
    documents and places. Equal windows are neighbours; of a group that goes on over blocks
    only the earliest window is kept in mind.
    """
    first = None  # age and place of the earliest window of the last group

    def settle(place: np.ndarray, common: np.ndarray) -> None:
        nonlocal first
        same = common >= LENGTH
        if not same[0]:
            first = None
        # Windows that equal a neighbour, and the last group, which may go on.
        some = same | np.r_[same[1:], True]
        place, same = place[some], same[some]
        region = np.searchsorted(begins, place, side="right") - 1
        fits = ends[region] - place >= LENGTH
        group = np.cumsum(~same)
        last = group[-1]
        place, region, group = place[fits], region[fits], group[fits]
        old = age[region] + place - begins[region]
        if first is not None:
            place, old, group = np.r_[first[1], place], np.r_[first[0], old], np.r_[0, group]
        if not len(place):
            return
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        least = np.minimum.reduceat(old, starts)
        marks[place[old != np.repeat(least, np.diff(np.r_[starts, len(place)]))]] = True
        first = None
        if group[-1] == last:
            i = int(starts[-1] + np.argmin(old[starts[-1] :]))
            first = int(old[i]), int(place[i])

    held, size = [], 0
    for block in order:
        held.append(block)
        size += len(block[0])
        if size >= most:
            settle(*(np.concatenate([b[i] for b in held]) for i in (0, 1)))
            held, size = [], 0
    if held:
        settle(*(np.concatenate([b[i] for b in held]) for i in (0, 1)))


class Shard:
    """Regions of a shard; beyond 16 times ``memory`` bytes, as a queue's tuples have, they lie in scratch files."""

    def __init__(self, folder: Path, memory: int):
        self.folder, self.memory = folder, memory
        self.size = self.held = 0
        self.parts: list[tuple] = []
        self.files: list = []

    def add(self, doc: np.ndarray, at: np.ndarray, regions: pa.Array) -> None:
        if not len(regions):
            return
        offsets = np.frombuffer(regions.buffers()[1], np.int32)[regions.offset : regions.offset + len(regions) + 1].astype(np.int64)
        data = np.frombuffer(regions.buffers()[2], np.uint8, int(offsets[-1] - offsets[0]), offset=int(offsets[0]))
        # A byte that UTF-8 never has makes room for the separator, which sorts first.
        text = np.insert(data + np.uint8(1), offsets[1:] - offsets[0], 0)
        length = np.diff(offsets)
        self.parts.append((text, doc, at, self.size + np.cumsum(length + 1) - length - 1, length))
        self.size += len(text)
        self.held += len(text)
        if self.held > 16 * self.memory:
            self.files = self.files or [open(self.folder / name, "wb") for name in ("text", "doc", "at", "begins", "length")]
            self._write()

    def _write(self) -> None:
        for file, x in zip(self.files, zip(*self.parts)):
            file.write(np.concatenate(x).tobytes())
        self.parts, self.held = [], 0

    def repeats(self):
        """``INTERVALS`` found by sorting all suffixes."""
        if not self.size:
            return
        if self.files:
            if self.parts:
                self._write()
            for file in self.files:
                file.close()
            symbols, doc, at, begins, length = (np.memmap(f.name, k, "r") for f, k in zip(self.files, (np.uint8, *[np.int64] * 4)))
        else:
            symbols, doc, at, begins, length = map(np.concatenate, zip(*self.parts))
        self.parts = []
        by_age = np.lexsort((at, doc))
        age = np.empty(len(at), np.int64)
        age[by_age] = np.cumsum(length[by_age]) - length[by_age]
        # One byte a symbol.
        marks = np.memmap(self.folder / "marks", bool, "w+", shape=self.size) if self.files else np.zeros(self.size, bool)
        _mark_repeats(suffix_order(symbols, LENGTH, self.memory, self.folder), age, begins, begins + length, marks)
        for k in range(0, len(begins), 1 << 14):
            low, high = int(begins[k]), int(begins[min(k + (1 << 14), len(begins)) - 1] + length[min(k + (1 << 14), len(begins)) - 1]) + 1
            edges = np.flatnonzero(np.diff(np.r_[False, marks[low:high], False])) + low
            first, last = edges[::2], edges[1::2]
            if len(first):  # a region's last windows reach its end, so marks of two regions never touch
                region = np.searchsorted(begins, first, side="right") - 1
                start = at[region] + first - begins[region]
                yield _batch(INTERVALS, (doc[region], start, start + (last - first) + LENGTH - 1))


def sort_regions(regions: DataFrame, shard_bytes: int = 2 << 20, memory: int = 3 << 18) -> DataFrame:
    """``INTERVALS`` found by sorting the suffixes of shards of ``REGIONS``, and those known before.

    A shard holds all regions of whole parts, of ``shard_bytes`` together, or of a single one of
    any size. Its sort holds at most ``memory`` tuples in each queue, so those of a usual shard
    go to disk too. The scratch folder is private to the task and goes when the shard is done,
    however it ends.
    """

    def run(batches):
        known = []

        def sort(rows):
            with tempfile.TemporaryDirectory(prefix="shard-") as folder:
                shard = Shard(Path(folder), memory)
                for row in rows:
                    shard.add(*row)
                yield from shard.repeats()
            if known:
                yield from known
                known.clear()

        def cut():
            """Per shard, a stream of its (doc, at, regions)."""
            # Few rows at once, so that a shard ends close to its size.
            left = (batch.slice(k, 512) for batch in batches for k in range(0, len(batch), 512))
            rest, last = None, None
            while True:
                batch = rest if rest is not None else next(left, None)
                if batch is None:
                    return
                size = 0

                def rows(batch=batch):
                    nonlocal rest, last, size
                    while batch is not None:
                        rest, part = None, np.asarray(batch.column(0))
                        if size >= shard_bytes and len(part):
                            change = np.flatnonzero(part != last)
                            if len(change):
                                at = int(change[0])
                                rest = batch.slice(at)
                                batch = batch.slice(0, at)
                        settled = batch.filter(batch.column(4).is_null())
                        if len(settled):
                            known.append(_batch(INTERVALS, [np.asarray(settled.column(i)) for i in (1, 2, 3)]))
                            own = batch.filter(batch.column(4).is_valid())
                        else:
                            own = batch
                        yield np.asarray(own.column(1)), np.asarray(own.column(2)), own.column(4)
                        if rest is not None:
                            return
                        size += own.column(4).nbytes
                        last = part[-1] if len(part) else last
                        batch = next(left, None)

                yield rows()
                if rest is None:
                    return

        for rows in cut():
            yield from sort(rows)

    return regions.repartition("part").sortWithinPartitions("part").mapInArrow(frugal(run), INTERVALS)


def repeated_intervals(texts: DataFrame) -> DataFrame:
    """``doc, spans``: intervals of each text that repeat earlier ones."""
    texts = texts.select("doc", "text")
    open_ = stage(open_runs(mark_runs(texts)), "repeat-runs")
    found = stage(sort_regions(regions_of(texts, open_)), "repeat-intervals")
    unstage(open_)
    out = stage(found.groupBy("doc").agg(F.collect_list(F.struct("at", "until")).alias("spans")), "repeats")
    unstage(found)
    return out


def _kept(text: memoryview, spans) -> tuple[bytes, int, int]:
    """What is left of a text, bytes removed and maximal runs removed."""
    size = len(text)
    if spans is None or not size:
        return bytes(text), 0, 0
    first, last = np.asarray(spans.field(0)), np.minimum(np.asarray(spans.field(1)), size)
    _, first, last = _merged(np.zeros(len(first), np.int64), first, last)
    edges = [0, *np.stack([first, last], 1).ravel().tolist(), size]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])), int((last - first).sum()), len(first)


def removed(docs: DataFrame, kept: bool = True) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every document, and ``kept``, the remaining bytes, if asked for.

    Null texts are empty. Documents without id come before all others; rows that share an
    id are ordered as ``keyed_texts`` tells, so of equal rows one keeps its bytes. Strings
    are judged on the input. Texts of any length are searched a slice at a time; an empty
    table gives no rows, and columns besides ``doc_id`` and ``text`` play no part.
    """
    texts = keyed_texts(docs.select("doc_id", "text"))
    joined = texts.join(repeated_intervals(texts), "doc", "left").select(F.col("document.doc_id").cast("long").alias("doc_id"), "text", "spans")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if kept else "")
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())

    def result(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[c.split()[0] for c in schema.split(", ")])

    def run(batches):
        for batch in batches:
            rows, held = [], 0
            for doc_id, text, spans in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                view = memoryview(text.as_buffer())
                left, n_removed, n_spans = _kept(view, spans.values if spans.is_valid else None)
                rows.append((doc_id, len(view), n_removed, n_spans, hashlib.sha256(left).hexdigest(), left)[: 5 + kept])
                held += len(left) if kept else 0
                if held > 4 << 20:
                    yield result(rows)
                    rows, held = [], 0
            if rows:
                yield result(rows)

    return joined.mapInArrow(frugal(run), schema)


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the text that ``removed`` keeps and, where there is such a column, its ``n_chars``; other columns stay.

    Characters that lost some of their bytes go. Documents of which nothing is
    left go; those that lost nothing are unchanged, null texts included. Nulls, repeated
    rows, long texts and empty tables are as in ``removed``.
    """
    texts = keyed_texts(docs)
    joined = texts.join(repeated_intervals(texts), "doc", "left")

    @F.arrow_udf("string")
    def kept(text: pa.Array, spans: pa.Array) -> pa.Array:
        out = [_kept(memoryview(t.as_buffer()), s.values if s.is_valid else None) for t, s in zip(text, spans)]
        out = pa.array([None if n == 0 else b.decode("utf-8", "ignore") for b, n, _ in out], pa.string())
        give_back()
        return out

    text = F.when(F.col("spans").isNull(), F.lit(None)).otherwise(kept("text", "spans"))
    found = joined.select("document", text.alias("left")).filter(F.col("left").isNull() | (F.col("left") != ""))
    new = {"text": F.coalesce("left", "document.text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("left").isNull(), F.col("document.n_chars")).otherwise(F.length("left").cast("long"))
    return found.select(*[new[c].alias(c) if c in new else F.col("document").getField(c).alias(c) for c in docs.columns])


def oracle(chunk: int = 400) -> str:
    """The rows of ``removed`` in DuckDB SQL over ``documents`` with differing ids: every window, numbered among its equals.

    Texts are cut into chunks of window starts first, so that a window is no cut from a whole text.
    """
    return f"""
    WITH d AS MATERIALIZED (
        SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST) AS r, doc_id, hex(encode(coalesce(text, ''))) AS h, length(h) // 2 AS n FROM documents
    ), chunks AS (
        SELECT r, n, c, substr(h, 2 * c + 1, {2 * (chunk + LENGTH - 1)}) AS s FROM (SELECT *, unnest(range(0, n - {LENGTH - 1}, {chunk})) AS c FROM d WHERE n >= {LENGTH})
    ), windows AS (
        SELECT r, c + i AS i, sha256(substr(s, 2 * i + 1, {2 * LENGTH})) AS g FROM (SELECT *, unnest(range(least({chunk}, n - {LENGTH - 1} - c))) AS i FROM chunks)
    ), repeats AS (
        SELECT r, i FROM (SELECT r, i, row_number() OVER (PARTITION BY g ORDER BY r, i) AS k FROM windows) WHERE k > 1
    ), marked AS (
        SELECT r, i, coalesce(i > lag(i) OVER (PARTITION BY r ORDER BY i) + {LENGTH}, true)::INT AS fresh FROM repeats
    ), spans AS (
        SELECT r, min(i) AS a, max(i) + {LENGTH} AS b FROM (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS k FROM marked) GROUP BY r, k
    ), pieces AS (
        SELECT r, lag(b, 1, 0) OVER (PARTITION BY r ORDER BY a) AS a, a AS b FROM spans UNION ALL SELECT r, max(b), any_value(n) FROM spans JOIN d USING (r) GROUP BY r
    ), kept AS (
        SELECT r, string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS h FROM pieces JOIN d USING (r) GROUP BY r
    ), counts AS (
        SELECT r, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans FROM spans GROUP BY r
    )
    SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept.h, d.h))) AS kept_sha256
    FROM d LEFT JOIN kept USING (r) LEFT JOIN counts USING (r)
    """
