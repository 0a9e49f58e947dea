"""Scalar expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Control characters that separate fields of the text formats.
FIELD, ITEM, PART = "\x01", "\x02", "\x03"
#: Fixed value: text shown for a query that no dictionary knows.
NO_TEXT = "No query text exist."


def evidence_of(common: Column) -> Column:
    """1 - 2^-n: sum of 2^-i for i to ``common``, the number of common neighbours."""
    return F.lit(1.0) - F.pow(F.lit(2.0), -common.cast("double"))


def variance_of(count: Column, total: Column, squares: Column) -> Column:
    """Population variance from exact integer sums."""
    return (count * squares - total * total).cast("double") / (count * count).cast("double")


def spread_of(count: Column, total: Column, squares: Column, single: bool = False) -> Column:
    """e^-variance; ``single`` rounds the variance to single precision first."""
    return F.exp(-rounded(variance_of(count, total, squares), single))


def rounded(value: Column, float32: bool) -> Column:
    return value.cast("float").cast("double") if float32 else value


def host_of(url: Column) -> Column:
    """Host of a url, lower-cased; without a scheme, what stands before the first slash."""
    return F.lower(F.coalesce(F.parse_url(F.when(url.contains("://"), url).otherwise(F.concat(F.lit("http://"), url)), F.lit("HOST")), F.split_part(url, F.lit("/"), F.lit(1))))


def path_of(url: Column) -> Column:
    """Path of a url with its leading slash; empty if it has none."""
    return F.coalesce(F.parse_url(F.when(url.contains("://"), url).otherwise(F.concat(F.lit("http://"), url)), F.lit("PATH")), F.lit(""))
