import glob
import math

import duckdb
import pytest

import __spark_entry__ as entry
from linkloom import catalog

from .conftest import SF


def duck():
    connection = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        connection.execute(f"CREATE VIEW {path.split('/')[-1][:-8]} AS SELECT * FROM read_parquet('{path}')")
    return connection


def canonical(table):
    names = sorted(table.column_names)
    plain = lambda v: None if isinstance(v, float) and math.isnan(v) else v
    return names, sorted((tuple(plain(v) for v in r) for r in zip(*[table.column(n).to_pylist() for n in names])), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_against_sql(spark, name):
    got = canonical(catalog.QUERIES[name](spark, SF).toArrow())
    want = canonical(duck().execute(catalog.ORACLES[name]).to_arrow_table())
    assert got == want


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["q1", "q2", "n", "e"] and df.count() > 0


def test_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.QUERIES) <= set(entry.queries())
