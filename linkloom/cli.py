"""Command line: runs a registered query, or the similarity pipeline, and writes the rows.

    python -m linkloom.cli QUERY INPUT_DIR OUTPUT [--from MODULE] [--format parquet|csv|json] [key=value ...]
    python -m linkloom.cli similar ADJACENCY_FILES OUTPUT [--param iterations=2 ...] [key=value ...]

``key=value`` pairs are Spark settings. ``MODULE`` has the queries as ``QUERIES`` or returns them
from ``queries()``; without one they are those of the click graph. ``similar`` reads query-side
adjacency lines; its parameters are those of ``linkloom.config.Params``. The exit code is 0 on success.
"""

from __future__ import annotations

import argparse
import dataclasses
import importlib
import sys

from pyspark.sql import DataFrame, SparkSession

from linkloom.config import Params
from linkloom.plans import similarity
from linkloom.sources import adjacency, files

SIMILAR = "similar"


def _pairs(parser: argparse.ArgumentParser, given: list[str]) -> dict[str, str]:
    if bad := [s for s in given if "=" not in s]:
        parser.error(f"not key=value: {bad[0]}")
    return {k: v for k, _, v in (s.partition("=") for s in given)}


def params_of(given: dict[str, str]) -> Params:
    """Parameters from text; raises for unknown names and bad values."""
    kinds = {f.name: type(f.default) for f in dataclasses.fields(Params)}
    if unknown := set(given) - set(kinds):
        raise ValueError(f"unknown parameters: {sorted(unknown)}")
    if bad := [v for k, v in given.items() if kinds[k] is bool and v not in ("true", "false")]:
        raise ValueError(f"neither true nor false: {bad[0]}")
    return Params(**{k: v == "true" if kinds[k] is bool else kinds[k](v) for k, v in given.items()})


def similar(spark: SparkSession, path: str, params: Params) -> DataFrame:
    """Scores ``i, j, v`` of the queries of adjacency lines."""
    return similarity.similar_queries(adjacency.query_side(files.scan_text(spark, path)), params).scores


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="linkloom", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("query")
    parser.add_argument("input")
    parser.add_argument("output")
    parser.add_argument("--from", dest="module", default="linkloom.catalog", help="module of the query")
    parser.add_argument("--format", default="parquet", choices=["parquet", "csv", "json"])
    parser.add_argument("--param", action="append", default=[], help="parameter of the similarity as name=value")
    parser.add_argument("settings", nargs="*", help="Spark settings as key=value")
    given = parser.parse_intermixed_args(arguments)
    settings = _pairs(parser, given.settings)
    if given.query == SIMILAR:
        try:
            params = params_of(_pairs(parser, given.param))
        except ValueError as error:
            parser.error(str(error))
        run = lambda spark: similar(spark, given.input, params)
    else:
        module = importlib.import_module(given.module)
        queries = module.QUERIES if hasattr(module, "QUERIES") else module.queries()
        if given.query not in queries:
            parser.error(f"no query {given.query!r} in {given.module}")
        run = lambda spark: queries[given.query](spark, given.input)
    builder = SparkSession.builder.appName(f"linkloom {given.query}")
    for key, value in settings.items():
        builder = builder.config(key, value)
    run(builder.getOrCreate()).write.mode("overwrite").format(given.format).save(given.output)
    return 0


if __name__ == "__main__":
    sys.exit(main())
