"""Text statistics of a document as column expressions (operators 5 and 10)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import text_of

#: Fixed values of the rules: white space, and the characters that count as symbols.
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def bound(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, though the body names it often."""
    return F.element_at(F.transform(F.array(value), body), 1)


def without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def words_of(column: str = "text") -> Column:
    """Runs of characters other than ASCII white space."""
    return F.array_remove(F.split(F.translate(text_of(column), SPACES, " " * len(SPACES)), " ", -1), "")


def word_chars(column: str = "text") -> Column:
    return F.length(without(text_of(column), SPACES)).cast("long")


def n_symbols(column: str = "text") -> Column:
    text = text_of(column)
    return (F.length(text) - F.length(without(text, SYMBOLS))).cast("long")


def n_dup_lines(column: str = "text") -> Column:
    lines = F.filter(F.split(text_of(column), "\n", -1), lambda x: F.length(without(x, SPACES)) > 0)
    return bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def _covered(places: Column) -> Column:
    """Words under windows of three that start at ascending places: each adds what it covers beyond the one before."""
    adds = F.transform(places, lambda x, j: F.least(F.lit(3), x - F.coalesce(F.get(places, j - 1), F.lit(-3))))
    return F.aggregate(adds, F.lit(0), lambda a, x: a + x.cast("int"))


def _repeats_by_text(w: Column) -> Column:
    """``n_repeat_words`` by sorting the windows' texts."""

    def places(windows: Column) -> Column:
        def repeated(x: Column, j: Column) -> Column:
            same = lambda at: F.coalesce(F.get(windows, at)["g"] == x["g"], F.lit(False))
            return same(j - 1) | same(j + 1)

        return F.sort_array(F.transform(F.filter(windows, repeated), lambda x: x["p"]))

    window = lambda i: F.struct(F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("g"), i.alias("p"))
    windows = F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - 3), window))
    return bound(bound(windows, places), _covered)


#: Bits of a window's place and of its hash that share a long.
PLACE_BITS = 21


def n_repeat_words(words: Column) -> Column:
    """Words that stand in a three-word window found twice or more in the text.

    Hashes of windows, with the places in their low bits, are sorted as longs, so
    equal windows become neighbours, which are then compared word by word; the places
    found are sorted and counted: n log n, however long or repetitive the text. Where
    neighbours of one hash differ, or a text has more words than places have numbers,
    the texts of the windows are sorted instead.
    """
    mask = (1 << PLACE_BITS) - 1

    def count(w: Column) -> Column:
        def key(i: Column) -> Column:
            h = F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
            return h.bitwiseAND(F.lit(~mask)).bitwiseOR(i.cast("long"))

        def paired(keys: Column) -> Column:
            """Keys whose hash the one before or after has."""
            hash_ = lambda x: F.shiftright(x, PLACE_BITS)
            same = lambda x, at: F.coalesce(hash_(F.get(keys, at)) == hash_(x), F.lit(False))
            return F.filter(keys, lambda x, j: same(x, j + 1) | same(x, j - 1))

        def verified(keys: Column) -> Column:
            """Covered words; by text where a hash stands for several windows."""
            place = lambda x: x.bitwiseAND(F.lit(mask)).cast("int")

            def differs(x: Column, j: Column) -> Column:
                other = F.get(keys, j - 1)
                p, q = place(x), place(other)
                one_hash = F.shiftright(other, PLACE_BITS) == F.shiftright(x, PLACE_BITS)
                words_differ = (F.get(w, p) != F.get(w, q)) | (F.get(w, p + 1) != F.get(w, q + 1)) | (F.get(w, p + 2) != F.get(w, q + 2))
                return F.coalesce(one_hash & words_differ, F.lit(False))

            some = F.exists(F.transform(keys, differs), lambda x: x)
            plain = bound(F.sort_array(F.transform(keys, place)), _covered)
            return F.when(F.size(keys) == 0, F.lit(0)).when(some, _repeats_by_text(w)).otherwise(plain)

        keys = F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - 3), key))
        return F.when(F.size(w) < 3, F.lit(0)).when(F.size(w) > mask, _repeats_by_text(w)).otherwise(bound(bound(keys, paired), verified))

    return bound(words, count).cast("long")
