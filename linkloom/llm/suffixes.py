"""Suffix sorting of a shard by external induced sorting, with common prefixes.

Left-most S suffixes are ranked first: the substrings between them are sorted by
induction and named, and where names repeat the string of names is sorted by the
same method, level by level. All other suffixes are induced: every scanned suffix
puts its predecessor into a priority queue, which gives tuples back by first
symbol and, among equal ones, in order of arrival, which is their order. A tuple
holds a position, preceding symbols and, on the lowest level, the common prefix
with the tuple before. Preceding symbols travel in the tuple, so the text is read
at random only when they run out. Common prefixes are capped: callers need no more
than whether two suffixes agree on ``cap`` symbols.

Memory is bounded by the number of tuples asked for. A queue that holds more moves
all of them to one scratch file in a single append, an extent for each bucket of
symbols. Positions of left-most S suffixes, their ranks and the names are written
and read in blocks; beyond the bound they lie in mapped files.

A bucket is a symbol, or on the levels of names a range of names of about a block
of suffixes, of which all chains inside the range are ordered together. Work is
done on blocks of tuples in arrays.
"""

from __future__ import annotations

import heapq
import mmap
import os
import shutil
import tempfile
from collections import deque
from collections.abc import Iterator
from pathlib import Path

import numpy as np

#: Most tuples worked on at once.
BLOCK = 1 << 17


class Fifos:
    """First-in-first-out queues of tuples, one a bucket; beyond ``memory`` tuples in a scratch file."""

    def __init__(self, path: Path, kinds: tuple, memory: int):
        self.path, self.kinds, self.memory = path, [np.dtype(k) for k in kinds], memory
        self.queues: dict[int, deque] = {}
        self.held = self.end = 0
        self.file = None

    def put(self, bucket: int, columns: tuple[np.ndarray, ...]) -> None:
        self.queues.setdefault(bucket, deque()).append(columns)
        self.held += len(columns[0])
        if self.held > self.memory:
            self.spill()

    def spill(self) -> None:
        """One append of all that is in memory; it is younger than what a queue has on file."""
        if self.file is None:
            self.file = open(self.path, "w+b", buffering=0)
        begin, parts = self.end, []
        for queue in self.queues.values():
            young = []
            while queue and isinstance(queue[-1][0], np.ndarray):
                young.append(queue.pop())
            if young:
                columns = [np.concatenate(c).astype(k, copy=False) for c, k in zip(zip(*reversed(young)), self.kinds)]
                queue.append((self.end, len(columns[0])))
                for x in columns:
                    parts.append(x.tobytes())
                    self.end += x.nbytes
        os.lseek(self.file.fileno(), begin, os.SEEK_SET)
        data = memoryview(b"".join(parts))
        while data:
            data = data[os.write(self.file.fileno(), data) :]
        self.held = 0

    def _load(self, block: tuple) -> tuple[np.ndarray, ...]:
        if isinstance(block[0], np.ndarray):
            return block
        at, n = block
        out = []
        for kind in self.kinds:
            out.append(np.frombuffer(os.pread(self.file.fileno(), n * kind.itemsize, at), kind))
            at += n * kind.itemsize
        return tuple(out)

    def take(self, bucket: int, most: int) -> Iterator[tuple[np.ndarray, ...]]:
        """All there is of a bucket, some ``most`` tuples at a time, also what is put meanwhile."""
        queue = self.queues.get(bucket, ())
        while queue:
            some, n = [], 0
            while queue and n < most:
                block = queue.popleft()
                if isinstance(block[0], np.ndarray):
                    self.held -= len(block[0])
                some.append(self._load(block))
                n += len(some[-1][0])
            yield some[0] if len(some) == 1 else tuple(map(np.concatenate, zip(*some)))
        self.queues.pop(bucket, None)

    def read(self, bucket: int, back: bool = False) -> Iterator[tuple[np.ndarray, ...]]:
        """The blocks of a bucket, which stay; the last one first if ``back``."""
        blocks = self.queues.get(bucket, ())
        for block in reversed(blocks) if back else blocks:
            yield self._load(block)

    def close(self) -> None:
        self.queues.clear()
        if self.file is not None:
            self.file.close()
            self.path.unlink()


def _column(path: Path, kind, n: int, memory: int) -> np.ndarray:
    """An array of ``n`` values, in a mapped file if they are more than ``memory``."""
    return np.empty(n, kind) if n <= memory else np.memmap(path, kind, "w+", shape=n)


def _release(*columns: np.ndarray) -> None:
    """Give back the memory of mapped pages; what was written stays in the file."""
    for x in columns:
        if isinstance(x, np.memmap):
            x._mmap.madvise(mmap.MADV_DONTNEED)


def _blocks(values: np.ndarray, most: int) -> Iterator[np.ndarray]:
    for k in range(0, len(values), most):
        yield np.array(values[k : k + most])
        _release(values)


def _range_minima(values: np.ndarray):
    """Function of arrays (first, last): minima of ``values`` between, both included."""
    tables = [values]
    while len(tables[-1]) > 1 << (len(tables) - 1):
        step = 1 << (len(tables) - 1)
        tables.append(np.minimum(tables[-1][:-step], tables[-1][step:]))
    logs = (np.frexp(np.arange(1, len(values) + 1))[1] - 1).astype(np.int8)

    def minima(first: np.ndarray, last: np.ndarray) -> np.ndarray:
        level = logs[last - first]
        out = np.empty(len(first), values.dtype)
        for k in range(len(tables)):
            at = np.flatnonzero(level == k)
            if len(at):
                out[at] = np.minimum(tables[k][first[at]], tables[k][last[at] - (1 << k) + 1])
        return out

    return minima


class Text:
    """Symbols of a level: bytes of the shard, or names of 4 bytes with the first names of their buckets."""

    def __init__(self, symbols: np.ndarray, cuts: np.ndarray | None = None):
        self.symbols, self.n, self.cuts = symbols, len(symbols), cuts
        self.bits = 8 * symbols.dtype.itemsize
        self.mask, self.carried = np.uint64((1 << self.bits) - 1), 64 // self.bits
        self.place = np.int32 if self.n < 1 << 31 else np.int64
        #: For bytes, the eight from each place on as one little-endian number.
        self.words = np.ndarray((self.n - 7,), "<u8", symbols, strides=(1,)) if self.bits == 8 and self.n > 7 and symbols.flags["C_CONTIGUOUS"] else None

    def bucket(self, symbols: np.ndarray) -> np.ndarray:
        return symbols if self.cuts is None else np.searchsorted(self.cuts, symbols, side="right") - 1

    def span(self, bucket: int) -> tuple[int, int]:
        """Least and greatest symbol of a bucket."""
        if self.cuts is None:
            return bucket, bucket
        return int(self.cuts[bucket]), int(self.cuts[bucket + 1]) - 1 if bucket + 1 < len(self.cuts) else int(self.mask)

    def before(self, at: np.ndarray) -> np.ndarray:
        """The symbols before each place, the nearest in the lowest bits."""
        at = at.astype(np.int64, copy=False)
        if self.words is not None:
            packed = self.words[np.minimum(np.maximum(at - 8, 0), self.n - 8)].byteswap()
            near = np.flatnonzero(at < 8)
        else:
            packed, near = np.zeros(len(at), np.uint64), np.arange(len(at))
        if len(near):
            few, out = at[near], np.zeros(len(near), np.uint64)
            for k in range(self.carried):
                out |= self.symbols[np.maximum(few - 1 - k, 0)].astype(np.uint64) << np.uint64(self.bits * k)
            packed[near] = out
        return packed

    def common(self, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
        """Length of the common prefix of the suffixes at ``a`` and ``b``, at most ``cap``."""
        a, b = a.astype(np.int64, copy=False), b.astype(np.int64, copy=False)
        out = np.zeros(len(a), np.int64)
        live, done = np.arange(len(a)), 0
        if self.words is not None:
            while len(live) and done < cap:
                x, y = a[live] + done, b[live] + done
                inside = np.maximum(x, y) < len(self.words)
                if not inside.all():
                    live, x, y = live[inside], x[inside], y[inside]
                differ = self.words[x] ^ self.words[y]
                same = differ == 0
                # Whole bytes below the lowest bit that differs, which a double holds exactly.
                rest = differ[~same]
                out[live[~same]] += (np.frexp((rest & -rest).astype(np.float64))[1] - 1) // 8
                out[live[same]] += 8
                live, done = live[same], done + 8
            live = np.flatnonzero((np.maximum(a, b) + out >= len(self.words)) & (out < cap))
        while len(live):  # one symbol at a time: names, and what is next to the end of the text
            x, y = a[live] + out[live], b[live] + out[live]
            inside = (np.maximum(x, y) < self.n) & (out[live] < cap)
            live, x, y = live[inside], x[inside], y[inside]
            live = live[self.symbols[x] == self.symbols[y]]
            out[live] += 1
        return np.minimum(out, cap)

    def leftmost(self, memory: int, folder: Path) -> np.ndarray:
        """Places of left-most S suffixes, ascending; the text is read in blocks from its end."""
        block, total = max(16, min(4 * memory, BLOCK)), 0
        found = Fifos(folder / "found", (np.int64,), memory)
        next_symbol, next_is_s, end = -1, False, self.n
        while end > 0:
            begin = max(0, end - block)
            x = self.symbols[begin:end].astype(np.int64)
            after = np.append(x[1:], next_symbol)
            rises, equal = x < after, x == after
            # The type of a run of equal symbols is that of its last one.
            at = np.where(equal, len(x), np.arange(len(x)))
            decided = np.minimum.accumulate(at[::-1])[::-1]
            is_s = np.where(decided < len(x), rises[np.minimum(decided, len(x) - 1)], next_is_s)
            follows = np.append(is_s[1:], next_is_s)
            starts = np.flatnonzero(follows & ~is_s) + begin + 1
            found.put(0, (starts,))
            total += len(starts)
            next_symbol, next_is_s, end = int(x[0]), bool(is_s[0]), begin
        out, at = _column(folder / "stars", np.int64, total, memory), 0
        # What was put last stands first; an extent of the file holds several blocks, the first of which stands last.
        for (some,) in found.read(0, back=True):
            some = np.sort(some)
            out[at : at + len(some)] = some
            at += len(some)
            _release(out)
        found.close()
        return out


class Pass:
    """One pass over a level: induces the L suffixes from the left-most S ones (up), or the S ones from L (down).

    ``seeds``: per bucket, tuples of place and common prefix (bytes) or symbol (names) that
    the pass scans after those that it induces. ``runs`` holds what is induced, ``ends``
    the left-most S suffixes that chains of the down pass end in, both in scan order.
    """

    def __init__(self, text: Text, folder: Path, memory: int, cap: int, down: bool, seeds: Fifos, keep: bool = True):
        self.text, self.cap, self.down, self.keep = text, cap, down, keep
        self.block = max(16, min(memory // 4, BLOCK))
        extra = np.uint8 if text.cuts is None else np.uint32
        name = f"{'down' if down else 'up'}-{cap}-"
        self.queue = Fifos(folder / f"{name}queue", (text.place, np.uint64, extra), memory)
        self.runs = Fifos(folder / f"{name}runs", (text.place, extra), memory)
        self.ends = Fifos(folder / f"{name}ends", (text.place,), memory)
        self.seeds, self.heap, self.known = seeds, [], set()
        #: Per first symbol: least common prefix scanned since its last tuple came.
        self.since: dict[int, int] = {}
        for b in seeds.queues:
            self._expect(b)
        if not down:  # the last suffix has nothing after it, so it is of type L
            last = np.asarray([text.n - 1])
            symbol = text.symbols[last].astype(np.int64)
            self._put(int(text.bucket(symbol)[0]), (last.astype(text.place), text.before(last), np.zeros(1, np.uint8) if text.cuts is None else symbol.astype(np.uint32)))
        while self.heap:
            bucket = heapq.heappop(self.heap)
            bucket = -bucket if down else bucket
            low, high = text.span(bucket)
            if low == high:
                self._symbol(low, bucket)
            else:
                self._range(low, high, bucket)
        self.queue.close()

    def _expect(self, bucket: int) -> None:
        if bucket not in self.known:
            self.known.add(bucket)
            heapq.heappush(self.heap, -bucket if self.down else bucket)

    def _put(self, bucket: int, columns: tuple[np.ndarray, ...]) -> None:
        self._expect(bucket)
        self.queue.put(bucket, columns)

    def _refill(self, position: np.ndarray, packed: np.ndarray) -> np.ndarray:
        """A tuple's symbols run out each time its position passes a multiple of what it carries."""
        dry = np.flatnonzero(position % self.text.carried == 0)
        packed[dry] = self.text.before(position[dry])
        return packed

    def _symbol(self, symbol: int, bucket: int) -> None:
        """Scan all suffixes of one first symbol, a block at a time."""
        last = None
        for s in self.since:
            self.since[s] = 0  # nothing in common across first symbols
        for at, packed, extra in self.queue.take(bucket, self.block):
            if last is None and self.cap:
                extra = extra.copy()
                extra[0] = 0
            if self.keep:
                self.runs.put(bucket, (at, extra))
            over = self._scan(symbol, bucket, at, packed, extra, True)
            if self.down and over.any():
                self.ends.put(bucket, (at[over],))
            last = at[-1:]
        carry, first = 0, True
        for at, extra in self.seeds.read(bucket, back=self.down):
            if self.down:  # scanned backwards: what a suffix has in common with the one above it
                at, above = at[::-1], extra[::-1]
                extra, carry = np.r_[carry, above[:-1]].astype(above.dtype), int(above[-1])
            if first and self.cap:
                extra = extra.copy()
                extra[0] = self.text.common(last, at[:1], self.cap)[0] if last is not None else 0
            first = False
            for c in range(0, len(at), self.block):
                some = at[c : c + self.block]
                self._scan(symbol, bucket, some, self.text.before(some), extra[c : c + self.block], False)

    def _scan(self, symbol: int, bucket: int, at: np.ndarray, packed: np.ndarray, common: np.ndarray, of_pass: bool) -> np.ndarray:
        """Put the predecessors of scanned tuples that this pass induces; which tuples have another one.

        ``of_pass``: the scanned tuples are of the type that the pass induces.
        """
        left, previous = at > 0, (packed & self.text.mask).astype(self.text.symbols.dtype)
        if self.down:
            wanted = left & ((previous <= symbol) if of_pass else (previous < symbol))
        else:
            wanted = left & ((previous >= symbol) if of_pass else (previous > symbol))
        source = np.flatnonzero(wanted)
        if len(source):
            to = self.text.bucket(previous[source])
            order = np.argsort(to, kind="stable")
            source, to = source[order], to[order]
            begins = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
            buckets, ends = to[begins].tolist(), [*begins[1:].tolist(), len(source)]
            if self.cap:
                extra = self._common(common, source, begins, buckets, ends)
            else:
                extra = previous[source] if self.text.cuts is not None else np.zeros(len(source), np.uint8)
            position = at[source] - 1
            carried = self._refill(position, packed[source] >> np.uint64(self.text.bits))
            for b, i, j in zip(buckets, begins.tolist(), ends):
                self._put(b, (position[i:j], carried[i:j], extra[i:j]))
        elif self.cap:
            least = int(common.min())
            self.since = {s: min(c, least) for s, c in self.since.items()}
        return left & ~wanted

    def _common(self, common: np.ndarray, source: np.ndarray, begins: np.ndarray, symbols: list[int], ends: list[int]) -> np.ndarray:
        """Common prefixes of the tuples put: one more than the least since the last of their symbol."""
        from_ = np.r_[0, source[:-1]] + 1
        from_[begins] = 0
        minima = _range_minima(common)(np.minimum(from_, source), source)
        minima[begins] = np.minimum(minima[begins], [self.since.get(s, 0) for s in symbols])
        suffix_min = np.append(np.minimum.accumulate(common[::-1])[::-1], np.uint8(255))
        rest = suffix_min[source[np.asarray(ends) - 1] + 1].tolist()
        least = int(suffix_min[0])
        self.since = {s: min(c, least) for s, c in self.since.items()} | dict(zip(symbols, rest))
        return np.minimum(minima, self.cap - 1).astype(np.uint8) + np.uint8(1)

    def _range(self, low: int, high: int, bucket: int) -> None:
        """Scan all suffixes of a range of names.

        A name is scanned before greater ones (smaller ones if down): first tuples that came
        from outside the range, as they came, then those induced inside it, by the place of
        their source, then seeds. Places of sources are compared by doubling along the chains.
        """
        text, bits = self.text, np.uint64(self.text.bits)
        came, seeds = list(self.queue.take(bucket, 1 << 62)), list(self.seeds.read(bucket, back=self.down))
        some, packed, names = came[0] if came else (np.zeros(0, text.place), np.zeros(0, np.uint64), np.zeros(0, np.uint32))
        if seeds:
            turn = -1 if self.down else 1
            places, of = (np.concatenate([x[i][::turn] for x in seeds]) for i in (0, 1))
            kind = np.r_[np.zeros(len(some), np.int8), np.full(len(places), 2, np.int8)]
            some, packed, names = np.concatenate([some, places]), np.concatenate([packed, text.before(places)]), np.concatenate([names, of])
        else:
            kind = np.zeros(len(some), np.int8)
        source, begin, steps = np.arange(len(some)), 0, []
        while len(some):
            previous = (packed & text.mask).astype(np.uint32)
            beyond = previous < names if self.down else previous > names
            wanted = (some > 0) & (beyond | ((previous == names) & (kind != 2)))
            inside = wanted & ((previous >= low) if self.down else (previous <= high))
            steps.append((some, packed, names, kind, source, previous, wanted, inside))
            on = np.flatnonzero(inside)
            source, begin = begin + on, begin + len(some)
            some, names, kind = some[on] - 1, previous[on], np.ones(len(on), np.int8)
            packed = self._refill(some, packed[on] >> bits)
        if not steps:
            return
        some, packed, names, kind, source, previous, wanted, inside = map(np.concatenate, zip(*steps))
        scan = self._chains(names.astype(np.int64) - low if not self.down else high - names.astype(np.int64), kind, source)
        some, packed, names, kind, previous, wanted, inside = (x[scan] for x in (some, packed, names, kind, previous, wanted, inside))
        own = kind != 2
        if self.keep and own.any():
            self.runs.put(bucket, (some[own], names[own]))
        over = own & (some > 0) & ~wanted
        if self.down and over.any():
            self.ends.put(bucket, (some[over],))
        out = np.flatnonzero(wanted & ~inside)
        if len(out):
            to = text.bucket(previous[out])
            order = np.argsort(to, kind="stable")
            out, to = out[order], to[order]
            position = some[out] - 1
            carried = self._refill(position, packed[out] >> bits)
            begins = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
            for i, j in zip(begins.tolist(), [*begins[1:].tolist(), len(out)]):
                self._put(int(to[i]), (position[i:j], carried[i:j], previous[out[i:j]]))

    @staticmethod
    def _chains(names: np.ndarray, kind: np.ndarray, source: np.ndarray) -> np.ndarray:
        """Scan order of tuples of a range; ``source`` of one that was not induced inside is itself."""
        n = len(names)
        arrival = np.where(kind == 1, 0, np.arange(n))
        order = np.lexsort((arrival, kind, names))
        if not (kind == 1).any():
            return order
        code = (names * 3 + kind) * n + arrival  # names: less than 2 ** 32 in a range of a few blocks
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.r_[0, code[order[1:]] != code[order[:-1]]])
        jump = source
        while True:
            code = rank * n + rank[jump]
            order = np.argsort(code, kind="stable")
            rank[order] = np.cumsum(np.r_[0, code[order[1:]] != code[order[:-1]]])
            if not (kind[jump] == 1).any():
                return order
            jump = jump[jump]

    def close(self) -> None:
        self.runs.close()
        self.ends.close()


def suffix_order(symbols: np.ndarray, cap: int, memory: int, scratch: Path) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (position, common prefix with the suffix before, at most ``cap``) in sorted order.

    ``symbols`` are bytes, in memory or in a mapped file. Suffixes that agree on ``cap``
    symbols may come in any order. ``memory``: tuples held at once by each structure;
    ``cap`` at most 254. An end of text sorts before every symbol.
    """
    text = Text(symbols)
    if not text.n:
        return
    folder = Path(tempfile.mkdtemp(dir=scratch))
    try:
        ranked = _ranked(text, cap, memory, folder)
        seeds, last = Fifos(folder / "seeds", (text.place, np.uint8), memory), None
        for at in _blocks(ranked, max(16, min(memory, BLOCK))):
            common = text.common(np.r_[at[:1] if last is None else last, at[:-1]], at, cap).astype(np.uint8)
            first = text.symbols[at]
            begins = np.flatnonzero(np.r_[True, first[1:] != first[:-1]])
            common[begins if last is None or first[0] != text.symbols[last[0]] else begins[1:]] = 0
            for i, j in zip(begins.tolist(), [*begins[1:].tolist(), len(at)]):
                seeds.put(int(first[i]), (at[i:j].astype(text.place), common[i:j]))
            last = at[-1:]
        lower = Pass(text, folder, memory, cap, False, seeds)
        seeds.close()
        upper = Pass(text, folder, memory, cap, True, lower.runs)
        for s in sorted({*lower.runs.queues, *upper.runs.queues}):
            last = held = None
            for at, common in lower.runs.read(s):
                yield at, common
                last = at[-1:]
            for at, above in upper.runs.read(s, back=True):
                at, above = at[::-1], above[::-1]
                common = np.r_[0 if held is None else held, above[:-1]].astype(np.uint8)
                if held is None and last is not None:
                    common[0] = text.common(last, at[:1], cap)[0]
                yield at, common
                held = above[-1]
        lower.close()
        upper.close()
    finally:
        shutil.rmtree(folder)


def _name_order(text: Text, cap: int, memory: int, folder: Path) -> Iterator[np.ndarray]:
    """Blocks of positions of a text of names in sorted order."""
    ranked = _ranked(text, cap, memory, folder)
    seeds = _seeds(text, ranked, memory, folder)
    lower = Pass(text, folder, memory, 0, False, seeds)
    seeds.close()
    upper = Pass(text, folder, memory, 0, True, lower.runs)
    for b in sorted({*lower.runs.queues, *upper.runs.queues}):
        low, high = text.span(b)
        if low == high:
            for at, _ in lower.runs.read(b):
                yield at
            for at, _ in upper.runs.read(b, back=True):
                yield at[::-1]
        else:
            parts = [*lower.runs.read(b), *((at[::-1], names[::-1]) for at, names in upper.runs.read(b, back=True))]
            at, names = map(np.concatenate, zip(*parts))
            yield at[np.argsort(names, kind="stable")]  # of one name, those of type L come first
    lower.close()
    upper.close()


def _seeds(text: Text, places: np.ndarray, memory: int, folder: Path) -> Fifos:
    """Places by bucket, in the given order, with their symbols where a bucket has several."""
    seeds = Fifos(folder / "seeds", (text.place, np.uint8 if text.cuts is None else np.uint32), memory)
    for at in _blocks(places, max(16, min(memory, BLOCK))):
        symbols = text.symbols[at]
        to = text.bucket(symbols)
        order = np.argsort(to, kind="stable")
        at, to = at[order].astype(text.place), to[order]
        extra = np.zeros(len(at), np.uint8) if text.cuts is None else symbols[order]
        begins = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
        for i, j in zip(begins.tolist(), [*begins[1:].tolist(), len(at)]):
            seeds.put(int(to[i]), (at[i:j], extra[i:j]))
    return seeds


def _ranked(text: Text, cap: int, memory: int, folder: Path) -> np.ndarray:
    """Left-most S suffixes in sorted order, as far as ``cap`` symbols tell."""
    stars = text.leftmost(memory, folder)
    m = len(stars)
    if m < 2:
        return stars
    # Sort the substrings between left-most S positions by inducing from them unsorted.
    seeds = _seeds(text, stars, memory, folder)
    lower = Pass(text, folder, memory, 0, False, seeds)
    seeds.close()
    upper = Pass(text, folder, memory, 0, True, lower.runs, keep=False)
    names, ordered = _column(folder / "names", np.uint32, m, memory), _column(folder / "ordered", np.int64, m, memory)
    step, done, name, last = max(16, min(memory // 4, BLOCK)), 0, 0, None
    cuts, open_ = [1], (1, 0)  # first names of buckets; the name last seen and its first place
    for b in sorted(upper.ends.queues):
        for (at,) in upper.ends.read(b, back=True):
            at = at[::-1].astype(np.int64)
            index = np.searchsorted(stars, at)
            length = np.where(index + 1 < m, stars[np.minimum(index + 1, m - 1)], text.n) - at + 1
            # The last one reaches the end of the text and equals no other.
            length[index == m - 1] = -1
            before, before_length = (at[:1], np.asarray([-2])) if last is None else last
            a, la = np.r_[before, at[:-1]], np.r_[before_length, length[:-1]]
            some = np.flatnonzero((la == length) & (length > 0))
            same = np.zeros(len(at), bool)
            same[some] = text.common(a[some], at[some], int(length[some].max(initial=0))) >= length[some]
            new = name + np.cumsum(~same)
            names[index], ordered[done : done + len(at)] = new, at
            fresh = np.flatnonzero(~same)
            if len(fresh):
                # A bucket of names: about ``step`` suffixes, or one name of more.
                firsts, places = np.r_[open_[0], new[fresh]], np.r_[open_[1], done + fresh]
                wide = np.flatnonzero(np.diff(places) > step // 2)
                turns = np.flatnonzero(places[1:] // step != places[:-1] // step) + 1
                cuts += sorted({*firsts[wide].tolist(), *firsts[wide + 1].tolist(), *firsts[turns].tolist()})
                open_ = int(firsts[-1]), int(places[-1])
            name, done, last = int(new[-1]), done + len(at), (at[-1:], length[-1:])
            _release(stars, names, ordered)
    lower.close()
    upper.close()
    if name == m:
        return ordered
    if m <= memory:
        return stars[_doubled(names, cap)]
    if m - open_[1] > step // 2:
        cuts.append(open_[0])
    below = Path(tempfile.mkdtemp(dir=folder))
    done = 0
    for at in _name_order(Text(names, np.unique(np.asarray(cuts, np.int64))), cap // 2 + 2, memory, below):
        ordered[done : done + len(at)] = stars[at]
        done += len(at)
        _release(stars, names, ordered)
    shutil.rmtree(below)
    return ordered


def _doubled(names: np.ndarray, cap: int) -> np.ndarray:
    """Order of the suffixes of a string of names that fits in memory, by doubling.

    Left-most S positions lie two symbols apart at least, so half of ``cap`` names are enough.
    """
    rank, step, n = names.astype(np.int64), 1, len(names)
    while True:
        after = np.zeros(n, np.int64)
        after[:-step] = rank[step:] if step < n else 0
        key = rank * (n + 2) + after
        order = np.argsort(key)
        sorted_key = key[order]
        fresh = np.cumsum(np.r_[1, sorted_key[1:] != sorted_key[:-1]])
        rank[order] = fresh
        step *= 2
        if fresh[-1] == n or 2 * step > cap + 2:
            return order
