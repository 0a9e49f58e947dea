"""Operator 8: license scan by MinHash over text windows (DataFrame functions only).

A template of s five-word shingles belongs to the class of the least power of two c that
is s or more. It is sought in windows of 2c shingles that start at every c/2-th, so any
run of 1.5c shingles lies whole in a window: 1.5 times a notice, whatever words stand
in between. Templates are retrieved by ``BANDS`` bands of one MinHash value each: a window
that holds 0.8 of a template has Jaccard similarity 0.8 / 4.2 to it at least, and all
bands miss with probability (1 - 0.8 / 4.2) ** BANDS, under one in a hundred million.
Retrieved windows are verified by exact containment of shingles.

The value of a band is the hash of one shingle of the template, and a window can collide
in the band only if it holds that shingle. So words are first looked up in a Bloom filter
of the shingles that bands stand for, and MinHash values are made for the windows around
those found. Templates, their bands and their shingles are tables, of any size; only the
filter, of a bounded number of bits, is part of the plan.
"""

from __future__ import annotations

import string
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage, text_of, unstage
from .quality_stats import bound

SHINGLE, BANDS = 5, 96
#: Least and most bits of the filter, as powers of two, and probes of a shingle.
FILTER_BITS, PROBES = (16, 24), 3
#: Rows of the table of bands up to which it is broadcast.
MOST_BROADCAST = 1 << 20

#: Wording of public license notices, by name.
NOTICES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "mit-line": "Released under the MIT License.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so',
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}

#: Notices of fewer words than a shingle: their whole word sequence is their one shingle.
SHORT_NOTICES = {"all-rights-reserved": "All rights reserved."}

_WORD = r"[\p{L}\p{N}]+"


@dataclass(frozen=True)
class Template:
    name: str
    words: tuple[str, ...]

    @property
    def shingles(self) -> list[tuple[str, ...]]:
        return sorted({self.words[i : i + SHINGLE] for i in range(len(self.words) - SHINGLE + 1)})


def templates_of(notices: dict[str, str]) -> list[Template]:
    """Templates of ASCII notices; raises for one of fewer words than a shingle."""
    out = []
    for name, text in sorted(notices.items()):
        words = tuple("".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split())
        if len(words) < SHINGLE:
            raise ValueError(f"{name} has fewer than {SHINGLE} words")
        out.append(Template(name, words))
    return out


def short_templates_of(notices: dict[str, str]) -> list[Template]:
    """Templates of one shingle, the whole words of an ASCII notice."""
    return [Template(name, tuple("".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split())) for name, text in sorted(notices.items())]


def plain_words(text: Column) -> Column:
    """Runs of letters and digits, A-Z lower-cased."""
    return F.regexp_extract_all(F.translate(text, string.ascii_uppercase, string.ascii_lowercase), F.lit(f"({_WORD})"), F.lit(1))


def _numbers(n: Column) -> Column:
    """0 to n - 1; empty where n is not positive."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _hashes(w: Column, length: int) -> Column:
    return F.transform(_numbers(F.size(w) - (length - 1)), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(length)]))


def _shingles(w: Column, length: int) -> Column:
    return F.array_distinct(F.transform(_numbers(F.size(w) - (length - 1)), lambda i: F.concat_ws(" ", *[F.get(w, i + k) for k in range(length)])))


def _by_length(make) -> Column:
    """``make(length)`` for the row's ``length`` of shingles."""
    return reduce(lambda rest, n: F.when(F.col("length") == n, make(n)).otherwise(rest), range(1, SHINGLE), make(SHINGLE))


def prepared(notices: DataFrame) -> DataFrame:
    """``name, length, m, size, shingles, hashes`` of notices ``name, text``.

    Of fewer than five words the whole is one shingle; notices without words are left out.
    ``size`` is the class, ``m`` the number of distinct shingles.
    """
    words = notices.select(F.col("name").cast("string").alias("name"), plain_words(text_of()).alias("w")).filter(F.size("w") > 0)
    words = words.withColumn("length", F.least(F.size("w"), F.lit(SHINGLE)))
    span = F.size("w") - F.col("length") + 1
    size = F.pow(F.lit(2.0), F.ceil(F.log2(span.cast("double")))).cast("int")
    size = F.when(size < span, size * 2).otherwise(size)
    rows = words.select("name", "length", size.alias("size"), _by_length(lambda n: _shingles(F.col("w"), n)).alias("shingles"), F.array_distinct(_by_length(lambda n: _hashes(F.col("w"), n))).alias("hashes"))
    return rows.select("name", "length", F.size("shingles").cast("long").alias("m"), "size", "shingles", "hashes")


def bands_of(templates: DataFrame) -> DataFrame:
    """``name, length, size, band, value, shingle``: ``BANDS`` rows a template, with the hash of the shingle that has the value."""
    least = lambda b: F.array_min(F.transform("hashes", lambda h: F.struct(F.xxhash64(h, b).alias("value"), h.alias("shingle"))))
    return templates.select("name", "length", "size", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), least)).alias("band", "x")).select("name", "length", "size", "band", "x.value", "x.shingle")


def _probes(h: Column, bits: int) -> list[Column]:
    """Bits of the filter that stand for a hash."""
    return [F.shiftrightunsigned(h, 64 - bits - 12 * k).bitwiseAND(F.lit((1 << bits) - 1)).cast("int") for k in range(PROBES)]


def _filter(shingles: DataFrame, keys: int) -> tuple[Column, int]:
    """The filter of ``shingle`` hashes as an array of longs, and its number of bits as a power of two.

    At least 64 bits a hash, so that one word in some ten thousand passes by chance; beyond the
    most bits more pass, and are looked up in the table.
    """
    bits = min(max(FILTER_BITS[0], (64 * max(keys, 1) - 1).bit_length()), FILTER_BITS[1])
    at = shingles.select(F.explode(F.array(*_probes(F.col("shingle"), bits))).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("i")).agg(F.expr("bit_or(shiftleft(1L, at & 63))").alias("x")).collect()  # 2 ** 18 rows at most
    values = [0] * (1 << (bits - 6))
    for row in words:
        values[row["i"]] = row["x"]
    return F.lit(values).cast("array<bigint>"), bits


def _windows(size: Column) -> tuple[Column, Column]:
    """Step and length, in shingles, of the windows of a class."""
    return F.greatest(F.floor(size / 2), F.lit(1)).cast("int"), (2 * size).cast("int")


def scan(docs: DataFrame, notices: dict[str, str] | DataFrame = NOTICES, containment: float = 0.8, short: dict[str, str] = SHORT_NOTICES) -> DataFrame:
    """``doc_id, license, n_shingles, best_shared, n_windows, first_word`` of every match.

    A document matches a template if a window holds ``containment`` of its
    shingles; ``best_shared`` is the most any window holds, ``first_word`` the
    first word of the first matching window. ``notices`` are names and texts, or a table
    ``name, text`` of any number of templates, which then stands alone. ``short`` notices, of
    fewer than five words, count as one shingle. Null texts match nothing, and texts of fewer than
    five words none but those; rows that share a ``doc_id`` are reported together, and texts of any length
    are read whole. An empty table gives no rows; other columns play no part.
    """
    spark = docs.sparkSession
    if not isinstance(notices, DataFrame):
        given = [(t.name, " ".join(t.words)) for t in templates_of(notices) + short_templates_of(short)]
        notices = spark.createDataFrame(given, "name string, text string")
    templates = stage(prepared(notices), "license-templates")
    bands = stage(bands_of(templates), "license-bands")
    few = bands.count() <= MOST_BROADCAST
    small = lambda df: F.broadcast(df) if few else df
    keys = bands.select("length", "size", "shingle").distinct()
    lengths = sorted(r["length"] for r in bands.select("length").distinct().collect())  # 5 at most
    if not lengths:
        return docs.limit(0).select(F.col("doc_id").cast("long"), F.lit("").alias("license"), *[F.lit(0).cast("long").alias(c) for c in ("n_shingles", "best_shared", "n_windows", "first_word")])
    table, bits = _filter(keys.select("shingle").distinct(), keys.count())

    def known(h: Column) -> Column:
        """Whether the filter has a hash."""
        tests = [F.call_function("shiftright", F.get(table, F.shiftright(at, 6)), at.bitwiseAND(F.lit(63))).bitwiseAND(F.lit(1).cast("bigint")) == 1 for at in _probes(h, bits)]
        return F.coalesce(reduce(lambda a, b: a & b, tests), F.lit(False))

    holds = lambda w: reduce(lambda a, b: a | b, [F.exists(_hashes(w, n), known) for n in lengths])
    # The words are kept where the filter names one of their shingles, so that they are cut once.
    near = docs.select(F.col("doc_id").cast("long"), bound(plain_words(text_of()), lambda w: F.when(holds(w), w)).alias("w")).filter(F.col("w").isNotNull())
    near = stage(near.withColumn("row", F.monotonically_increasing_id()), "license-documents")
    found = reduce(DataFrame.unionByName, [near.select("row", F.lit(n).alias("length"), F.posexplode(_hashes(F.col("w"), n)).alias("at", "shingle")) for n in lengths])
    step, length = _windows(F.col("size"))
    around = found.join(small(keys), ["length", "shingle"]).select("row", "length", "size", F.explode(F.transform(F.sequence(F.lit(0), (length / step).cast("int") - 1), lambda j: F.floor(F.col("at") / step).cast("int") - j)).alias("k"))
    starts = stage(around.filter("k >= 0").distinct(), "license-starts")
    part = F.slice("w", F.col("k") * step + 1, length + F.col("length") - 1)
    cut = near.join(starts, "row").select("doc_id", "row", "length", "size", (F.col("k") * step).cast("int").alias("at"), part.alias("part"))
    cut = cut.select("doc_id", "row", "length", "size", "at", _by_length(lambda n: _shingles(F.col("part"), n)).alias("held"), F.array_distinct(_by_length(lambda n: _hashes(F.col("part"), n))).alias("hashes"))
    cut = stage(cut, "license-windows")
    signature = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.array_min(F.transform("hashes", lambda h: F.xxhash64(h, b))))
    signed = cut.select("row", "length", "size", "at", F.posexplode(signature).alias("band", "value"))
    alike = signed.join(small(bands.select("name", "length", "size", "band", "value")), ["length", "size", "band", "value"]).select("row", "length", "size", "at", "name").distinct()
    shared = F.size(F.array_intersect("held", "shingles")).cast("long")
    pairs = cut.join(alike, ["row", "length", "size", "at"]).join(templates.select("name", "m", "shingles"), "name")
    verified = pairs.select("doc_id", "name", "m", "at", shared.alias("shared")).filter(F.col("shared") >= F.lit(containment) * F.col("m"))
    each = verified.groupBy("doc_id", "name", "m", "at").agg(F.max("shared").alias("shared"))
    out = each.groupBy("doc_id", F.col("name").alias("license"), F.col("m").alias("n_shingles")).agg(
        F.max("shared").alias("best_shared"), F.count(F.lit(1)).alias("n_windows"), F.min("at").cast("long").alias("first_word")
    )
    out = stage(out, "license-matches")
    unstage(templates, bands, near, starts, cut)
    return out


def oracle(notices: dict[str, str] = NOTICES, containment: float = 0.8, short: dict[str, str] = SHORT_NOTICES) -> str:
    """Exact containment of every template in every window, in DuckDB SQL over ``documents``."""
    rows = []
    for t in templates_of(notices) + short_templates_of(short):
        n = min(SHINGLE, len(t.words))
        shingles = sorted({" ".join(t.words[i : i + n]) for i in range(len(t.words) - n + 1)})
        size = 1 << (len(t.words) - n).bit_length()
        rows += [f"('{t.name}', {n}, {len(shingles)}, {2 * size}, {max(size // 2, 1)}, '{s}')" for s in shingles]
    return f"""
    WITH t(license, n, m, width, step, shingle) AS (VALUES {', '.join(rows)}),
    w AS (
        SELECT doc_id, row_number() OVER () AS r,
               regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{_WORD}') AS w
        FROM documents
    ), i AS (
        SELECT doc_id, r, w, n, unnest(range(len(w) - n + 1)) AS i FROM w, (SELECT DISTINCT n FROM t) WHERE len(w) >= n
    ), s AS (
        SELECT doc_id, r, n, i, array_to_string(w[i + 1 : i + n], ' ') AS shingle FROM i
    ), h AS (
        SELECT doc_id, r, license, m, step, shingle, unnest(range(i // step - width // step + 1, i // step + 1)) AS k FROM s JOIN t USING (n, shingle)
    ), c AS (
        SELECT doc_id, license, m, step, k, max(n) AS n FROM (
            SELECT doc_id, r, license, m, step, k, count(DISTINCT shingle) AS n FROM h WHERE k >= 0 GROUP BY ALL
        ) WHERE n >= {containment}::DOUBLE * m GROUP BY ALL
    )
    SELECT doc_id, license, CAST(m AS BIGINT) AS n_shingles, CAST(max(n) AS BIGINT) AS best_shared, count(*) AS n_windows, CAST(min(k * step) AS BIGINT) AS first_word
    FROM c GROUP BY ALL
    """
