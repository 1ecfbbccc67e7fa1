"""The registered text queries on the test tables: their twins, or the columns they promise."""

from __future__ import annotations

import hashlib
import os

import duckdb
import pytest

from levelbook.llm import queries

from .helpers import TESTDATA, repeats_brute

COLUMNS = {
    "op1_benchmark_decontamination": ["doc_id", "contaminated", "n_items", "item_ids", "least_distance"],
    "op2_suffix_array_dedup": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op4_lm_scoring": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "op7_html_extraction": ["page_id", "url", "text", "n_chars"],
}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for file in os.listdir(TESTDATA):
        connection.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{TESTDATA}/{file}'")
    return connection


def test_one_query_per_operator():
    assert [int(name[2:].split("_")[0]) for name in queries.QUERIES] == list(range(1, 14))
    assert set(queries.ORACLES) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_twins(spark, duck, name):
    found = queries.QUERIES[name](spark, TESTDATA)
    result = duck.execute(queries.ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(found.columns) == sorted(names)
    assert sorted(map(str, (tuple(r) for r in found.select(*names).collect()))) == sorted(map(str, result.fetchall()))


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_promised_columns(spark, name):
    found = queries.QUERIES[name](spark, TESTDATA)
    assert found.columns[: len(COLUMNS[name])] == COLUMNS[name]
    table = "pages" if "html" in name else "documents"
    assert found.count() == spark.read.parquet(f"{TESTDATA}/{table}.parquet").count()


def test_suffix_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{TESTDATA}/documents.parquet").collect()
    found = queries.QUERIES["op2_suffix_array_dedup"](spark, TESTDATA).collect()
    assert sorted(tuple(r)[:5] for r in found) == sorted(repeats_brute([(r.doc_id, r.text) for r in docs], 400))


def test_pieces_query_decodes(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{TESTDATA}/documents.parquet").collect()}
    for r in queries.QUERIES["op6_sentencepiece"](spark, TESTDATA).collect():
        assert r.round_trip and r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()
