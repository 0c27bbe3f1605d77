"""The registered queries on the small tables, and the pipeline stage by stage."""

from __future__ import annotations

import os

import pytest

import __spark_entry__
import corpus_pipeline
from tests.llm import brute

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.fixture(scope="module")
def docs(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def run(spark, name):
    return __spark_entry__.queries()[name](spark, SF).collect()


def test_op2(spark, docs):
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in run(spark, "op2_ngram_jaccard_join")} == brute.ngram_components(docs)


def test_op7(spark, docs):
    assert {
        r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in run(spark, "op7_substring_dedup")
    } == brute.word_windows(docs)


def test_op10(spark, docs):
    assert {
        r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in run(spark, "op10_suffix_array_dedup")
    } == brute.byte_windows(docs)


def test_op8_held_out_accuracy(spark):
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    told = [r for r in run(spark, "op8_language_id") if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in told) >= 0.95 * len(told)


@pytest.mark.parametrize("name", ["op1_sentencepiece", "op3_mixing", "op4_media_columns", "op6_lm_scoring", "op9_sharding"])
def test_one_row_a_document(spark, docs, name):
    assert sorted(r["doc_id"] for r in run(spark, name)) == sorted(i for i, _ in docs)


def test_pipeline_stages(spark, docs, tmp_path):
    rows = spark.read.parquet(f"{SF}/documents.parquet")
    columns = rows.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r["text"] for r in rows.select("doc_id", "text").collect()}
        stage(spark, rows, SF).write.parquet(str(tmp_path / str(k)))
        rows = spark.read.parquet(str(tmp_path / str(k)))
        if name != "tokens":
            assert rows.columns == columns
        after = {r["doc_id"] for r in rows.select("doc_id").collect()}
        if name == "near_copies":
            groups = brute.ngram_components(list(before.items()), corpus_pipeline.SHINGLE_WORDS, *corpus_pipeline.SIMILARITY)
            assert after == {i for i, (_, c) in groups.items() if c == i}
        if name == "substrings":
            lost = brute.word_windows(list(before.items()), corpus_pipeline.PASSAGE_WORDS)
            left = {r["doc_id"]: len(brute.words(r["text"])) for r in rows.collect()}
            assert left == {i: n - gone for i, (n, gone, _) in lost.items() if n > gone}
    assert rows.where("not round_trip").count() == 0
