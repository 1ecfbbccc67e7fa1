"""The corpus pipeline on the test documents, stage by stage."""

from __future__ import annotations

import pytest

import corpus_pipeline
from levelbook.llm import pieces, quality
from levelbook.llm.contamination import Matcher, budget, normal
from levelbook.llm.frames import written

from .helpers import TESTDATA, docs_of, jaccard_brute, repeats_brute

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def outputs(spark):
    docs, out = spark.read.parquet(f"{TESTDATA}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out.append(docs)
        docs = written(stage(spark, docs, TESTDATA), f"test-{name}")
    return [*out, docs]


def test_columns(outputs):
    assert all(df.columns == COLUMNS for df in outputs[:-1])


def test_quality(outputs):
    ledger = quality.ledger(outputs[0])
    expected = {r.doc_id for r in ledger.collect() if not r.failures & quality.POLICIES["v2"].mask}
    assert {i for i, _ in rows_of(outputs[1])} == expected


def test_one_of_each_group_stays(outputs):
    expected, _ = jaccard_brute(rows_of(outputs[1]))
    assert {i for i, _ in rows_of(outputs[2])} == {i for i, (_, root) in expected.items() if i == root}


def test_repeated_strings_are_cut(outputs):
    before = rows_of(outputs[2])
    removed = {i: n for i, _, n, _, _ in repeats_brute(before, 400)}
    after = dict(rows_of(outputs[3]))
    assert set(after) == set(removed)
    for i, text in before:
        if not removed[i]:
            assert after[i] == text
        else:
            assert 0 <= len(text.encode()) - removed[i] - len(after[i].encode()) <= 6 * len(text)
    assert outputs[3].filter("n_chars <> length(text)").count() == 0


def test_items_are_gone(spark, outputs):
    items = [(r.item_id, normal(r.text)) for r in spark.read.parquet(f"{TESTDATA}/benchmark.parquet").collect()]
    matcher = Matcher(items, 0.08)
    hit = {i for i, t in rows_of(outputs[3]) if any(True for _ in matcher.matches(t))}
    assert {i for i, _ in rows_of(outputs[4])} == {i for i, _ in rows_of(outputs[3])} - hit
    plain = {i for i, t in rows_of(outputs[3]) if any(x in normal(t) for _, x in items)}
    assert plain <= hit and budget(100, 0.08) == 8


def test_ids_decode_to_the_texts(outputs):
    back = {r.doc_id: r.text for r in pieces.decode(outputs[5]).collect()}
    assert back == dict(rows_of(outputs[4]))


def test_run(spark, outputs):
    found = corpus_pipeline.run(spark, TESTDATA)
    assert sorted(r.doc_id for r in found.select("doc_id").collect()) == sorted(i for i, _ in rows_of(outputs[4]))


def test_odd_documents(spark):
    good = " ".join(f"word{i}" for i in range(80))
    rows = [(1, good, "x"), (1, good, "x"), (2, good, "y"), (None, good, None), (3, None, "z"), (4, "", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _dropped string")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, TESTDATA), "test-odd")
        assert docs.columns == ["doc_id", "text", "_dropped"]
    assert sorted(str(r.doc_id) for r in docs.collect()) == ["1", "None"]
    empty = docs_of(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, TESTDATA).count() == 0
