"""Every registered operator against its SQL twin on the smallest tables; contract columns of the others."""

import re

import duckdb
import pytest

import __spark_entry__ as entry_point
from keysieve.llm.oracles import ORACLES
from keysieve.llm.queries import QUERIES

CONTRACT = {
    "op1": ("pages", {"page_id", "url", "text", "n_chars"}), "op3": ("documents", {"doc_id", "license", "origin"}),
    "op4": ("documents", {"doc_id", "held_out", "score", "predicted"}), "op5": ("documents", {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}),
    "op7": ("documents", {"doc_id", "held_out", "lang_pred", "score"}),
    "op9": ("documents", {"doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"}),
    "op11": ("pieces", {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"}),
}


def rows(names, values):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(repr(row[i]) for i in order) for row in values)


def test_all_are_registered():
    assert sorted(int(re.match(r"op(\d+)_", name).group(1)) for name in QUERIES) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(entry_point.queries())


@pytest.mark.parametrize("name", list(ORACLES))
def test_twin(spark, sf_dir, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    twin = con.execute(ORACLES[name])
    columns = [c[0] for c in twin.description]
    frame = QUERIES[name](spark, sf_dir)
    assert sorted(frame.columns) == sorted(columns)
    assert rows(frame.columns, frame.collect()) == rows(columns, twin.fetchall())


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLES])
def test_contract(spark, sf_dir, name):
    table, columns = CONTRACT[name.split("_")[0]]
    frame = QUERIES[name](spark, sf_dir)
    assert columns <= set(frame.columns)
    if table != "pieces":  # one row per row of the table
        assert frame.count() == spark.read.parquet(f"{sf_dir}/{table}.parquet").count()
