"""The pipeline's stages and the operators under them on awkward tables: clashing names, nulls, few words, long texts."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from tests.llm import brute
from tests.llm.test_small import SCHEMA, TEXT, awkward, frame
from tracelake.llm import blocks, language_crf, mixing, ngram_join, recompression

CLASHING = SCHEMA + ", _id long, _x string, copies int, gone string, kept_text string, row string, label string, h int, copy int, starts string, score double, lang_pred string"
MORE = (1, "x", 2, "g", "k", "r", "l", 3, 4, "s", 0.5, "zz")


@pytest.mark.parametrize("width", [3, 5, 8])
def test_blocks_of_few_words(width):
    for n in range(10):
        for texts in ([" ".join(f"w{k}" for k in range(n))], ["a"] * n):
            row, name, _ = ngram_join.shingle_sets(blocks.Words(pa.array(texts, pa.string()), lower=True), width)
            sets = [len(brute.shingles(t, width)) for t in texts]
            assert np.bincount(row, minlength=len(texts)).tolist() == sets and len(name) == sum(sets)


def test_task_of_few_words(spark):
    docs = [(1, "a b"), (2, "a b"), (3, "c d e")]
    for parts in (1, 3):
        told = ngram_join.ngram_join(frame(spark, docs).repartition(parts), 5, (80, 100)).collect()
        assert {r["doc_id"]: r["component_id"] for r in told} == {1: 1, 2: 1, 3: 3}


def model(spark):
    docs = [
        (i, TEXT if i % 2 else "der die das und nicht ist ein eine mit von auf", "en" if i % 2 else "de", "s", 1, "n") for i in range(40)
    ]
    return language_crf.fit(spark.createDataFrame(docs, SCHEMA))


@pytest.fixture
def stages(spark, monkeypatch):
    """The stages, with a field for languages that small tables cannot train."""
    field = model(spark)
    monkeypatch.setattr(language_crf, "fit", lambda docs: field)
    return corpus_pipeline.STAGES


def test_stages_on_clashing_names_and_nulls(spark, stages):
    docs = [(i, t, None if i % 3 else "en", None if i % 5 == 0 else f"s{i % 2}", 1, "n", *MORE) for i, t in awkward()]
    docs += [(None, TEXT, "en", "s0", 1, "n", *MORE), (None, None, None, None, None, None, *MORE), (8, TEXT, "en", "s0", 1, "n", *MORE)]
    rows = spark.createDataFrame(docs, CLASHING)
    for name, stage in stages[:-1]:
        out = stage(spark, rows, "")
        assert out.dtypes == rows.dtypes, name
        assert out.count() > 0
    assert stages[-1][1](spark, rows, "").count() == len(docs)


def test_stages_on_empty_tables(spark, stages):
    rows = spark.createDataFrame([], SCHEMA)
    for _, stage in stages:
        assert stage(spark, rows, "").count() == 0


def test_tables_without_labels(spark):
    rows = frame(spark, [(1, TEXT), (2, "x")]).drop("lang", "source")
    assert {r["lang_pred"] for r in language_crf.language_id(rows).collect()} == {"und"}
    assert {(r["doc_id"], r["rate"]) for r in mixing.mix_rates(rows, mixing.EQUAL, "source").collect()} == {(1, 1.0), (2, 1.0)}
    assert mixing.mixed(rows, mixing.EQUAL, "source").count() == 2


def test_text_longer_than_a_block(spark):
    pick = random.Random(1)
    long = " ".join(f"w{pick.randrange(10**6)}" for _ in range(300_000))
    assert len(long) > blocks.BLOCK_BYTES
    docs = frame(spark, [(1, long), (2, "start " + long[: 1 << 20]), (3, TEXT)])
    told = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in recompression.substring_dedup(docs).collect()}
    part = long[: 1 << 20].split()
    assert told[1] == (300_000, 0) and told[3][1] == 0
    assert told[2][0] - told[2][1] in (1, 1 + (part[-1] != long.split()[len(part) - 1]))
    sets = {r["doc_id"]: r["n_shingles"] for r in ngram_join.ngram_join(docs).collect()}
    assert sets[1] == len(brute.shingles(long, 3))


def test_large_group_of_near_copies_keeps_few_rows(spark):
    members = spark.range(8000).selectExpr("0L AS tile", "id AS node", "200L AS n_shingles")
    assert ngram_join.tiled(members, (90, 100)).count() <= 4 * 8000


def test_forward_backward_by_enumeration():
    import itertools

    pick = np.random.default_rng(3)
    emission, moves = pick.normal(size=(1, 4, 3)), pick.normal(size=(3, 3))
    ways = {
        p: np.exp(
            sum(emission[0, t, p[t]] for t in range(4)) + sum(moves[p[t], p[t + 1]] for t in range(3))
        ) for p in itertools.product(range(3), repeat=4)
    }
    whole = sum(ways.values())
    want = [[sum(v for p, v in ways.items() if p[t] == k) / whole for k in range(3)] for t in range(4)]
    assert np.allclose(language_crf.posteriors(emission, np.array([4]), moves)[0], want)
    gamma, expected = language_crf.forward_backward(emission, np.array([4]), moves)
    assert np.allclose(gamma[0], want)
    assert np.allclose(
        expected,
        [[sum(v for p, v in ways.items() for t in range(3) if p[t] == i and p[t + 1] == j) / whole for j in range(3)] for i in range(3)]
    )


def test_rates_equal_a_plain_solution(spark):
    pick = np.random.default_rng(5)
    posterior, tokens = pick.dirichlet([0.3] * 3, 300), pick.integers(1, 200, 300)
    told = spark.createDataFrame(
        [(i, i, "", int(n), [float(x) for x in p]) for i, (n, p) in enumerate(zip(tokens, posterior, strict=True))],
        "doc_id long, x long, label string, n_tokens long, posterior array<double>"
    )
    rated, before, after = mixing.fit_rates(told, 3, np.array([0.2, 0.3, 0.5]))
    rate = np.array([r["rate"] for r in rated.orderBy("doc_id").collect()])
    assert (rate >= 0).all() and np.allclose(before, tokens @ posterior)
    assert np.allclose((rate * tokens) @ posterior, after)
    assert np.allclose(after, np.array([0.2, 0.3, 0.5]) * tokens.sum(), rtol=0.005)
