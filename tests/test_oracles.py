"""Every registered query against its SQL twin, on the smallest tables."""

import time

import duckdb
import pytest

import __spark_entry__ as entry_point
from keysieve.catalog.oracles import ORACLES
from keysieve.catalog.queries import QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def rows(names, values):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(repr(row[i]) for i in order) for row in values)


def test_every_query_has_a_twin():
    assert set(ORACLES) == set(QUERIES)
    assert set(QUERIES) <= set(entry_point.queries())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, sf_dir, name):
    twin = duck.execute(entry_point.oracle_sql()[name])
    columns = [c[0] for c in twin.description]
    frame = entry_point.queries()[name](spark, sf_dir)
    assert sorted(frame.columns) == sorted(columns)
    assert rows(frame.columns, frame.collect()) == rows(columns, twin.fetchall())


def test_twins_answer_under_a_limit():
    """A caller may ask for the first rows only; no plan may take longer for that."""
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '/root/testdata/sf0.01/{name}.parquet'")
    for name, sql in entry_point.oracle_sql().items():
        start = time.perf_counter()
        con.execute(f"SELECT * FROM ({sql}) LIMIT 10").fetchall()
        assert time.perf_counter() - start < 5, name


def test_entry(spark):
    frame = entry_point.entry(spark)
    assert frame.count() == 823
