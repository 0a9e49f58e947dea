"""Operator 4: token-id output in Parquet.

Texts are encoded once per executor task and written as Parquet rows
``(doc_id, ids, n_tokens, start_in_part, part)`` in ascending ``doc_id`` order:
part files hold disjoint, ascending ranges of ids and are sorted inside.
Token ids are a dictionary-encoded list column; the metadata columns have no
dictionary, so version 2 pages hold them delta encoded. Row-group and page sizes are parameters, and
Parquet's column and offset indexes let a reader fetch the rows or the metadata
it needs and nothing else.
"""

from __future__ import annotations

import functools
import json
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import frugal, stage, text_of

#: Characters that no pre-tokenizer rule of a byte-level BPE counts as white space.
SOLID = "!-~\u00c0-\u0fff\u4000-\ud7ff"
_JOINS = re.compile(f" ?[{SOLID}](?:[^\n]*[{SOLID}])?")


def _lead_table() -> np.ndarray:
    """For each byte, whether it leads a character of ``SOLID`` (as UTF-8)."""
    table = np.zeros(256, bool)
    for low, high in ((0x21, 0x7E), (0xC3, 0xDF), (0xE0, 0xE0), (0xE4, 0xED)):
        table[low : high + 1] = True
    return table


_LEADS = _lead_table()


_LETTER = np.isin(np.arange(256), [*range(65, 91), *range(97, 123)])
#: ASCII marks but the apostrophe, which may begin a contraction.
_MARK = np.isin(np.arange(256), [x for x in range(0x21, 0x7F) if not chr(x).isalnum() and chr(x) != "'"])


def _solid_before(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character that ends before each place is in ``SOLID``."""
    one, two, three = (data[np.maximum(at - k, 0)] for k in (1, 2, 3))
    tail = lambda x: (x & 0xC0) == 0x80
    pair = tail(one) & _LEADS[two] & (two >= 0xC3) & (two < 0xE0)
    triple = tail(one) & tail(two) & _LEADS[three] & (three >= 0xE0)
    return ((one < 0x80) & _LEADS[one]) | pair | triple


def breaks_at_spaces(tokenizer: dict) -> bool:
    """Whether a tokenizer's file says that it pre-tokenizes as ``Encoder`` cuts texts: byte level, by its own
    pattern, with no space put in front and the text not normalized."""
    step = tokenizer.get("pre_tokenizer") or {}
    return tokenizer.get("normalizer") is None and step.get("type") == "ByteLevel" and step.get("use_regex", True) and not step.get("add_prefix_space", True)


class Encoder:
    """Encodes whole texts with a byte-level BPE of the ``tokenizers`` library.

    A byte-level pre-tokenizer always breaks before one space that stands
    between two visible characters, on both sides of one line feed that does, and
    between a letter and a mark other than an apostrophe. A block of texts is cut at such places, each distinct piece is encoded
    once, and the ids of the pieces are put together in arrays: the ids are
    those of the whole texts. Known pieces and their ids are kept in arrays, up to
    ``limit`` pieces; then the half that was not used for longest goes. Long
    pieces are not kept.

    A tokenizer with another pre-tokenizer, or with a normalizer, encodes whole texts.
    """

    def __init__(self, path: str, limit: int = 500_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.limit, self.block = Tokenizer.from_file(path), limit, 0
        self.cuts = breaks_at_spaces(json.loads(self.tokenizer.to_str()))
        self.keys = pa.array([], pa.binary())
        #: Per known piece: where its ids begin in ``flat``, how many they are, and the block of its last use.
        self.begin, self.size, self.used = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.flat = np.zeros(0, "<u4")
        self.feed = self.tokenizer.encode("\n", add_special_tokens=False).ids
        # Strings that the tokenizer takes as one token are not cut inside.
        fixed = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cuts &= not any(c.isspace() for t in fixed for c in t)
        self.mark = _MARK.copy()
        self.mark[[ord(b) for t in fixed for a, b in zip(t, t[1:]) if a.isalpha() and ord(b) < 128]] = False

    def _new(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of pieces as bytes. Pieces that a line feed parts cleanly go in one call."""
        texts = [p.decode() for p in pieces]
        joins = [len(self.feed) == 1 and _JOINS.fullmatch(t) is not None for t in texts]
        out = [b"" if j else np.asarray(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t, j in zip(texts, joins)]
        where = np.flatnonzero(joins)
        for k in range(0, len(where), 1000):
            some = where[k : k + 1000]
            joined = self.tokenizer.encode_batch_fast(["\n".join([texts[i] for i in some])], add_special_tokens=False)
            ids = np.asarray(joined[0].ids, "<u4")
            ends = np.flatnonzero(ids == self.feed[0])
            if len(ends) != len(some) - 1:
                raise AssertionError("a piece holds the separator")
            data = ids.tobytes()
            for i, a, b in zip(some, [0, *(4 * (ends + 1)).tolist()], [*(4 * ends).tolist(), len(data)]):
                out[i] = data[a:b]
        return out

    def _ids(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of distinct pieces: an array of ids, and where in it those of each begin and how many they are."""
        self.block += 1
        at = np.asarray(pc.index_in(pieces, value_set=self.keys).fill_null(-1))
        lost = np.flatnonzero(at < 0)
        missing = pieces.take(pa.array(lost))
        new = self._new(missing.to_pylist())
        sizes, flat = np.fromiter(map(len, new), np.int64, len(new)) // 4, np.concatenate([self.flat, np.frombuffer(b"".join(new), "<u4")])
        begins = len(self.flat) + np.cumsum(sizes) - sizes
        begin, size = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
        found = at >= 0
        begin[found], size[found] = self.begin[at[found]], self.size[at[found]]
        begin[lost], size[lost] = begins, sizes
        self.used[at[found]] = self.block
        short = np.flatnonzero(np.asarray(pc.binary_length(missing)) <= 48)
        self.keys = pa.concat_arrays([self.keys, missing.take(pa.array(short))])
        self.begin, self.size = np.concatenate([self.begin, begins[short]]), np.concatenate([self.size, sizes[short]])
        self.used = np.concatenate([self.used, np.full(len(short), self.block, np.int32)])
        self.flat = flat
        if len(self.keys) > self.limit:
            keep = np.sort(np.argsort(-self.used, kind="stable")[: self.limit // 2])
            many = self.size[keep]
            upto = np.cumsum(many) - many
            self.flat = flat[np.arange(int(many.sum())) + np.repeat(self.begin[keep] - upto, many)]
            self.keys, self.begin, self.size, self.used = self.keys.take(pa.array(keep)), upto, many, self.used[keep]
        return flat, begin, size

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (UTF-8, no nulls), each with ``end_id`` after it, and the bounds of each."""
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        size = int(offsets[-1] - offsets[0])
        data = np.frombuffer(texts.buffers()[2], np.uint8, size, offset=int(offsets[0])) if size else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        if not self.cuts:
            whole = [np.asarray(self.tokenizer.encode(t.decode(), add_special_tokens=False).ids + ([] if end_id is None else [end_id]), "<u4") for t in texts.to_pylist()]
            return np.concatenate([np.zeros(0, "<u4"), *whole]), np.cumsum([0, *map(len, whole)])
        gaps = np.flatnonzero((data == 0x20) | (data == 0x0A))
        first = np.zeros(size + 1, bool)
        first[offsets] = True  # no cut reaches into another text
        inner = gaps[(gaps > 0) & (gaps < size - 1)]
        inner = inner[~first[inner] & ~first[inner + 1]]
        inner = inner[_LEADS[data[inner + 1]] & _solid_before(data, inner)]
        marks = np.flatnonzero(_LETTER[data[:-1]] & self.mark[data[1:]]) + 1
        first[marks] = True
        first[inner] = True
        first[inner[data[inner] == 0x0A] + 1] = True
        first[size] = True
        starts = np.flatnonzero(first)
        n = len(starts) - 1
        if n > 0:
            pieces = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(starts.astype(np.int32)), pa.py_buffer(data)]).dictionary_encode()
            which = np.asarray(pieces.indices)
            flat, begins, sizes = self._ids(pieces.dictionary)
            many = sizes[which]
        else:
            which, flat, begins, many = np.zeros(0, np.int64), np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64)
        upto = np.concatenate([[0], np.cumsum(many)])
        bounds = upto[np.searchsorted(starts[:n], offsets)]
        total, extra = int(upto[-1]), int(end_id is not None)
        taken = flat[np.arange(total) + np.repeat(begins[which] - upto[:-1], many)]
        if not extra:
            return taken, bounds
        out = np.full(total + len(texts), end_id, "<u4")
        out[np.arange(total) + np.repeat(np.arange(len(texts)), np.diff(bounds))] = taken
        return out, bounds + np.arange(len(texts) + 1)


@functools.lru_cache(maxsize=2)
def encoder_for(tokenizer: str) -> Encoder:
    """One encoder a worker process, so its pieces serve all tasks there."""
    return Encoder(tokenizer)


def _gathered(batches, most: int):
    """Ids and texts of ``(doc_id, text as binary)`` batches, small ones put together up to about ``most`` bytes."""
    held, size = [], 0
    for batch in batches:
        held.append((batch.column(0), batch.column(1)))
        size += batch.column(1).nbytes
        if size >= most:
            yield tuple(map(pa.concat_arrays, zip(*held))) if len(held) > 1 else held[0]
            held, size = [], 0
    if held:
        yield tuple(map(pa.concat_arrays, zip(*held))) if len(held) > 1 else held[0]


def text_blocks(batches, most: int = 4 << 20):
    """Per block of ``(doc_id, text as binary)`` rows, some ``most`` bytes of text at most: ids and texts."""
    for ids, texts in _gathered(batches, most // 2):
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        begin = 0
        while begin < len(texts):
            end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + most, side="right")) - 1)
            yield ids.slice(begin, end - begin), texts.slice(begin, end - begin)
            begin = end


#: Part files up to which their starts are broadcast.
MOST_BROADCAST = 1 << 20

TOKENS = "doc_id long, ids array<int>, n_tokens long, start_in_part long, part int"


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Rows of ``TOKENS``, one a document, in ascending order inside and across partitions.

    Null texts are empty and give the end id alone, texts of any length are encoded whole, a
    block at a time; documents that share a ``doc_id`` stand next to each other, by a hash of
    their text, and those without id come first. An empty table gives no rows.
    """

    def run(batches):
        encoder, part, start = encoder_for(tokenizer), TaskContext.get().partitionId(), 0
        for doc_ids, texts in text_blocks(batches):
            ids, bounds = encoder.encode(texts, end_id)
            yield pa.record_batch(
                {
                    "doc_id": doc_ids,
                    "ids": pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.view(np.int32))),
                    "n_tokens": pa.array(np.diff(bounds)),
                    "start_in_part": pa.array(start + bounds[:-1]),
                    "part": pa.array(np.full(len(texts), part, np.int32)),
                }
            )
            start += int(bounds[-1])

    rows = docs.select(F.col("doc_id").cast("long"), text_of().cast("binary").alias("text"))
    # What follows the id in the order deals rows of one id, or of none, over several files.
    order = ["doc_id", "hash", "salt"]
    ordered = rows.withColumns({"hash": F.xxhash64("text"), "salt": F.monotonically_increasing_id()}).repartitionByRange(*order).sortWithinPartitions(*order)
    return ordered.select("doc_id", "text").mapInArrow(frugal(run), TOKENS)


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int, row_group_bytes: int = 32 << 20, page_bytes: int = 256 << 10, page_rows: int = 2000, path: str | None = None) -> DataFrame:
    """Encode, write the token files to ``path`` (else to the shared folder, for as long as the application runs), and return them as read back."""
    return stage(
        encode_documents(docs, tokenizer, end_id),
        "tokens",
        path,
        **{
            "parquet.writer.version": "PARQUET_2_0",
            "parquet.enable.dictionary": "true",
            **{f"parquet.enable.dictionary#{c}": "false" for c in ("doc_id", "n_tokens", "start_in_part", "part")},
            "parquet.dictionary.page.size": str(1 << 20),
            "parquet.block.size": str(row_group_bytes),
            "parquet.page.size": str(page_bytes),
            "parquet.page.row.count.limit": str(page_rows),
            "compression": "zstd",
        },
    )


def part_starts(tokens: DataFrame) -> DataFrame:
    """``(part, base)``: ids before each part file. One row a file; reads two metadata columns."""
    totals = tokens.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))


def read_tokens(tokens: DataFrame) -> DataFrame:
    """Per document, from the files: ``doc_id, start, n_tokens, ids_crc32``."""

    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            values = np.asarray(lists.values).astype("<u4", copy=False)
            at = np.asarray(lists.offsets)
            crc = [zlib.crc32(values[a:b].data if b > a else b"") for a, b in zip(at[:-1], at[1:])]
            yield pa.record_batch([batch.column(0), batch.column(2), batch.column(3), batch.column(4), pa.array(crc, pa.int64())], names=["doc_id", "n_tokens", "start_in_part", "part", "ids_crc32"])

    read = tokens.select("doc_id", "ids", "n_tokens", "start_in_part", "part").mapInArrow(frugal(run), "doc_id long, n_tokens long, start_in_part long, part int, ids_crc32 long")
    starts = part_starts(tokens)
    # One row a part file: broadcast once they are counted.
    starts = F.broadcast(starts) if starts.count() <= MOST_BROADCAST else starts
    return read.join(starts, "part").select("doc_id", (F.col("base") + F.col("start_in_part")).alias("start"), "n_tokens", "ids_crc32")
