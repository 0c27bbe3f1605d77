"""Whitening against plain sums and known spectra."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelake.llm import whitening as Wh

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, components=8):
    """{(id, component): (deviation, whitened, explained)} by exact sums and a double solver."""
    good = [
        (
            i,
            [math.floor(1024 * float(np.float32(c))) + 100000 for c in v]
        ) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)
    ]
    n, x = len(good), np.array([v for _, v in good], object)
    total = x.sum(axis=0)
    z = x * n - total
    v = np.array([[float(Fraction(int(s), n**3)) for s in row] for row in z.T.dot(z)])
    values, vectors = np.linalg.eigh(v)
    order = np.argsort(-values)[:components]
    told = (z / n).astype(float) @ vectors[:, order] / np.sqrt(values[order])
    return {
        (i, k + 1): (
            int((z[r] ** 2).sum()),
            told[r, k],
            values[order[k]] / v.trace()
        ) for r, (i, _) in enumerate(good) for k in range(len(order))
    }


def agrees(got, want):
    assert {(r["vec_id"], r["component"]) for r in got} == set(want)
    sign = {
        k: max(
            (r["whitened"] * want[r["vec_id"], k][1] for r in got if r["component"] == k),
            key=abs
        ) for k in {r["component"] for r in got}
    }
    for r in got:
        deviation, whitened, explained = want[r["vec_id"], r["component"]]
        assert r["deviation"] == deviation and r["explained"] == pytest.approx(explained, rel=1e-9)
        assert r["whitened"] == pytest.approx(whitened * np.sign(sign[r["component"]]), abs=1e-8)
        assert r["identity_error"] < 1e-9


def test_whole_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    got = Wh.embedding_whitening(table).collect()
    agrees(got, plain([(r["vec_id"], r["embedding"]) for r in table.collect()]))
    assert len({r["n"] for r in got}) == 1


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(k, [float(c) for c in rng.normal(size=4)], 0) for k in range(40)]
    rows += [
        (50, None, 1),
        (51, [1.0, None, 2.0, 3.0], 1),
        (52, [float("nan"), 0.0, 0.0, 0.0], 1),
        (53, [float("inf"), 0.0, 0.0, 0.0], 1),
        (54, [0.0, 0.0, 0.0, 0.0], None),
        (55, rows[0][1], 1)
    ]
    table = spark.createDataFrame(rows, SCHEMA)
    got = Wh.embedding_whitening(table.withColumnRenamed("label", "component").withColumn("n", F.lit(1))).collect()
    agrees(got, plain([(i, v) for i, v, _ in rows]))
    again = Wh.embedding_whitening(table.repartition(7)).collect()
    assert {(r["vec_id"], r["component"], r["deviation"]) for r in got} == {(r["vec_id"], r["component"], r["deviation"]) for r in again}


def test_no_variance_and_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert Wh.embedding_whitening(empty).count() == 0
    one = Wh.embedding_whitening(spark.createDataFrame([(1, [1.0, 2.0], 0)] * 3, SCHEMA)).collect()
    assert len(one) == 6 and {(r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one} == {(0, None, 0.0, 0.0)}
    line = Wh.embedding_whitening(spark.createDataFrame([(k, [float(k), 0.0], 0) for k in range(3)], SCHEMA)).collect()
    assert {r["component"] for r in line if r["whitened"] is None} == {2}


def test_shorter_vectors_and_huge_entries(spark):
    short = Wh.embedding_whitening(spark.createDataFrame([(1, [1.0], 0), (2, [3.0, 4.0], 0), (3, [0.0, 1.0], 0)], SCHEMA)).collect()
    agrees(short, plain([(1, [1.0, 0.0]), (2, [3.0, 4.0]), (3, [0.0, 1.0])]))
    huge = Wh.embedding_whitening(spark.createDataFrame([(k, [1e30 * k, float(k % 2)], 0) for k in range(4)], SCHEMA)).collect()
    assert {r["deviation"] for r in huge} == {None} and all(math.isfinite(r["whitened"]) for r in huge if r["component"] == 1)


@pytest.mark.parametrize("near", [1.0, 1e-9, 1e-13])
def test_clustered_eigenvalues(near):
    """Ten eigenvalues ``near`` apart among thirty: all vectors to double precision."""
    size, rng = 30, np.random.default_rng(1)
    q = np.linalg.qr(rng.normal(size=(size, size)))[0]
    q = Wh.Pair(q, np.zeros_like(q))
    for _ in range(3):
        squares = Wh.product(q.T, q)
        q = Wh.added(q, q.hi @ (((np.eye(size) - squares.hi) - squares.lo) / 2))
    values = np.r_[5 + near * np.arange(10), np.linspace(27, 40, 20)]
    v = Wh.product(Wh.product(q, Wh.Pair(np.diag(values), np.zeros((size, size)))), q.T)
    got, vectors = Wh.eigen(v)
    order = np.argsort(-values)
    want = q.hi[:, order]
    assert np.allclose(got, values[order], rtol=1e-15)
    assert np.abs(vectors - want * np.sign((vectors * want).sum(axis=0))).max() < 1e-15


def test_equal_eigenvalues_give_an_orthonormal_basis():
    values, vectors = Wh.eigen(Wh.Pair(np.diag([2.0, 2.0, 2.0, 5.0]), np.zeros((4, 4))))
    assert values.tolist() == [5.0, 2.0, 2.0, 2.0] and np.allclose(vectors.T @ vectors, np.eye(4), atol=1e-15)


def test_products_are_exact():
    y = np.random.default_rng(2).integers(-(2**61), 2**61, size=(9, 3))
    assert (Wh.exact_products(y) == y.astype(object).T @ y.astype(object)).all()
    assert Wh.exact_products(y % 999).dtype == np.int64
