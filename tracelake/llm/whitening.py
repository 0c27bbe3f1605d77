"""Whitening of embeddings by refined eigenvectors of an exact, distributed covariance.

Entries are made whole numbers, so that the sums that Spark gathers are exact and don't
depend on how rows are dealt: totals of each dimension first, then products of what is
left after the mean, rounded to a whole number, is taken away. Only these sums, a number
for each pair of dimensions, reach the driver; their size doesn't depend on the rows.

The eigenvectors start from a float32 solver. Steps of matrix products (Ogita and Aishima's
refinement) correct them in about twice the precision of doubles; eigenvalues that lie too
close for a step are told apart by a small eigenproblem of their own.

Edge cases: a null vector, or one with a null, NaN or infinite entry, has no row and is not
in the fit. Shorter vectors count as if zeros followed; an empty table, or one of empty vectors, gives no
rows. Entries are taken as at most 2**60 / 1024 from zero. A component in which all vectors
agree (one vector, equal vectors, fewer vectors than components), or differ by less than
``LEAST`` of the whole variance, can't have unit variance: its ``whitened`` is null. Equal eigenvalues have no order of their own; any is given. A
``deviation`` that a long can't hold is null. Repeated rows and ids count as often as they
stand; a null id stays null. Further columns are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, OFFSET = 1024, 100_000
#: Entries are held to so much after scaling, so that they are whole numbers of 64 bits.
LARGEST = float(1 << 60)
#: Rows that are multiplied at once, and bits of a part of an entry: products of parts stay exact in doubles.
ROWS, BITS = 1 << 10, 21
COMPONENTS = 8
#: Shares of the variance that are taken as none.
LEAST = 2.0**-80
#: Eigenvalues at most so many times the present error apart are a cluster: a step's corrections stay below its inverse.
NEAR = 1000
NUMBER = pa.decimal128(38, 0)


class Pair(NamedTuple):
    """A matrix as the sum of two of doubles, the second within the rounding of the first."""

    hi: np.ndarray
    lo: np.ndarray

    @property
    def T(self) -> Pair:
        return Pair(self.hi.T, self.lo.T)


def summed(a: np.ndarray, b: np.ndarray) -> Pair:
    """a + b and its rounding error."""
    s = a + b
    t = s - a
    return Pair(s, (a - (s - t)) + (b - t))


def added(a: Pair, b: np.ndarray) -> Pair:
    s, e = summed(a.hi, b)
    return summed(s, e + a.lo)


def parts(a: Pair, axis: int, inner: int, count: int = 5) -> list[np.ndarray]:
    """Matrices that sum to ``a``, of so few bits that the product of two of them has no rounding."""
    bits = (53 - math.ceil(math.log2(max(inner, 2)))) // 2
    hi, lo, out = a.hi, a.lo, []
    top = np.abs(hi).max(axis=axis, keepdims=True)
    unit = np.exp2(np.ceil(np.log2(np.where(top > 0, top, 1.0))))
    for _ in range(count):
        unit = unit * 2.0**-bits
        part = np.rint(hi / unit) * unit
        out.append(part)
        hi, lo = summed(hi - part, lo)
    return out


def product(a: Pair, b: Pair) -> Pair:
    """The matrix product, correct to about twice the bits of a double."""
    left, right = parts(a, 1, a.hi.shape[1]), parts(b, 0, a.hi.shape[1])
    pairs = [(p, q) for p in range(len(left)) for q in range(len(right)) if p + q < len(left)]
    total = Pair(np.zeros((a.hi.shape[0], b.hi.shape[1])), np.zeros((a.hi.shape[0], b.hi.shape[1])))
    for p, q in sorted(pairs, key=sum, reverse=True):
        total = added(total, left[p] @ right[q])
    return total


def clusters(values: np.ndarray, near: float) -> list[np.ndarray]:
    """Groups of places whose values, in order, lie at most ``near`` apart."""
    order = np.argsort(values)
    cuts = np.flatnonzero(np.diff(values[order]) > near) + 1
    return [g for g in np.split(order, cuts) if len(g) > 1]


def eigen(v: Pair, most: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """Falling eigenvalues of a symmetric matrix and its unit eigenvectors as columns, to double precision."""
    size = len(v.hi)
    top = np.abs(v.hi).max(initial=0.0)
    if top == 0:
        return np.zeros(size), np.eye(size)
    start = np.linalg.eigh((v.hi / top).astype(np.float32))[1].astype(np.float64)
    x, unit = Pair(start, np.zeros_like(start)), np.eye(size)
    values = np.zeros(size)
    for _ in range(most):
        squares = product(x.T, x)
        r = (unit - squares.hi) - squares.lo
        s = product(x.T, product(v, x))
        low = np.diag(s.lo) + np.diag(s.hi) * np.diag(r) / (1 - np.diag(r))
        values = np.diag(s.hi) + low
        off = s.hi - np.diag(np.diag(s.hi))
        near = NEAR * (np.linalg.norm(off, 2) + np.abs(values).max() * np.linalg.norm(r, 2))
        gap = (np.diag(s.hi)[None, :] - np.diag(s.hi)[:, None]) + (low[None, :] - low[:, None])
        groups, member = clusters(values, near), np.arange(size)
        for group in groups:
            member[group] = group[0]
        apart = member[:, None] != member[None, :]
        e = np.where(apart, (off + s.lo + values[None, :] * r) / np.where(apart, gap, 1.0), r / 2)
        e[np.diag_indices(size)] = np.diag(r) / 2
        x = added(x, x.hi @ e)
        for group in groups:
            x = told_apart(v, x, group, float(values[group].mean()))
        if np.abs(e).max() < 2.0**-58 and (not groups or near < np.abs(values).max() * 2.0**-85):
            break
    order = np.argsort(-values, kind="stable")
    out = x.hi[:, order]
    sign = np.sign(out[np.abs(out).argmax(axis=0), np.arange(size)])
    return values[order], out * sign


def told_apart(v: Pair, x: Pair, group: np.ndarray, middle: float) -> Pair:
    """The vectors of a cluster of eigenvalues, turned by the eigenvectors of their own small, shifted matrix."""
    own = Pair(x.hi[:, group], x.lo[:, group])
    small, squares = product(own.T, product(v, own)), product(own.T, own)
    shift = middle * np.eye(len(group))
    small = added(added(small, -shift), -middle * ((squares.hi - np.eye(len(group))) + squares.lo))
    size = np.abs(small.hi).max()
    if size == 0:
        return x
    turn = np.linalg.eigh((small.hi + small.hi.T) / (2 * size))[1]
    turn = Pair(turn, np.zeros_like(turn))
    squares = product(turn.T, turn)
    turned = product(own, added(turn, turn.hi @ (((np.eye(len(group)) - squares.hi) - squares.lo) / 2)))
    hi, lo = x.hi.copy(), x.lo.copy()
    hi[:, group], lo[:, group] = turned
    return Pair(hi, lo)


def whole_numbers(vectors: pa.Array, width: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the good vectors, their entries as whole numbers, and how many entries each has of its own."""
    told = pc.is_valid(vectors).to_numpy(zero_copy_only=False)
    length = pc.list_value_length(vectors).fill_null(0).to_numpy().astype(np.int64)[told]
    entries = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(length)), length)
    good = np.bincount(row[~np.isfinite(entries)], minlength=len(length)) == 0
    column = np.arange(len(entries)) - np.repeat(np.cumsum(length) - length, length)
    width = int(length[good].max(initial=0)) if width is None else width
    keep = good[row]
    out = np.full((int(good.sum()), width), OFFSET, np.int64)
    scaled = np.floor(np.clip(entries[keep] * float(SCALE), -LARGEST, LARGEST)).astype(np.int64) + OFFSET
    out[(np.cumsum(good) - 1)[row[keep]], column[keep]] = scaled
    return np.flatnonzero(told)[good], out, length[good]


def exact_sum(x: np.ndarray) -> np.ndarray:
    """Column sums that don't overflow, as Python's numbers."""
    small = len(x) == 0 or float(np.abs(x).max(initial=0)) * len(x) < 2.0**62
    return (x if small else x.astype(object)).sum(axis=0).astype(object)


def exact_products(y: np.ndarray) -> np.ndarray:
    """y.T @ y without rounding, from products of parts of ``BITS`` bits in doubles."""
    rest, limbs = y, []
    while True:
        part = ((rest + (1 << (BITS - 1))) & ((1 << BITS) - 1)) - (1 << (BITS - 1))
        limbs.append(part.astype(np.float64))
        rest = (rest - part) >> BITS
        if not rest.any():
            break
    total = np.zeros((y.shape[1], y.shape[1]), object if len(limbs) > 1 else np.int64)
    for i, a in enumerate(limbs):
        for j, b in enumerate(limbs):
            told = (a.T @ b).astype(np.int64)
            total = total + (told.astype(object) << (BITS * (i + j)) if len(limbs) > 1 else told)
    return total


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, total, count = 0, np.zeros(0, object), np.zeros(0, np.int64)
    for batch in batches:
        _, x, own = whole_numbers(batch.column(0))
        n += len(x)
        more = x.shape[1] - len(total)
        if more > 0:
            total, count = np.append(total, np.zeros(more, object)), np.append(count, np.zeros(more, np.int64))
        held = (own[:, None] > np.arange(x.shape[1])).sum(axis=0)
        total[: x.shape[1]] += exact_sum(x) - (len(x) - held).astype(object) * OFFSET
        count[: x.shape[1]] += held
    if n:
        numbers = pa.array([Decimal(0), *map(Decimal, total)], NUMBER)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(-1, len(total)), pa.int32()), numbers, pa.array([n, *count], pa.int64())],
            ["dim", "total", "n"]
        )


def _products(middle: np.ndarray):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = len(middle)
        total, small, held = np.zeros((width, width), object), np.zeros((width, width), np.int64), 0
        for batch in batches:
            _, x, _ = whole_numbers(batch.column(0), width)
            for k in range(0, len(x), ROWS):
                told = exact_products(x[k : k + ROWS] - middle)
                if told.dtype == object:
                    total = total + told
                else:
                    small, held = small + told, held + 1
                if held == 512:
                    total, small, held = total + small, np.zeros_like(small), 0
        i, j = np.triu_indices(width)
        numbers = (total + small)[i, j]
        if any(numbers):
            yield pa.RecordBatch.from_arrays(
                [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(list(map(Decimal, numbers)), NUMBER)],
                ["i", "j", "total"]
            )

    return rows


class Whitening(NamedTuple):
    """What a fit learned: rows, totals of dimensions, falling eigenvalues, eigenvectors as columns, trace of the covariance."""

    n: int
    totals: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float


def fit(rows: DataFrame, column: str = "embedding") -> Whitening:
    """The covariance of the vectors' whole numbers over all rows (divisor n) and its eigenvectors."""
    vectors = rows.select(column)
    sums = vectors.mapInArrow(_totals, "dim int, total decimal(38,0), n long").groupBy("dim").agg(
        F.sum("total").alias("total"),
        F.sum("n").alias("n")
    )
    told = {r["dim"]: (int(r["total"]), r["n"]) for r in sums.collect()}
    n = told[-1][1] if told else 0
    width = max(told, default=-1) + 1
    totals = [told[k][0] + OFFSET * (n - told[k][1]) for k in range(width)]
    if not width:
        return Whitening(n, totals, np.zeros(0), np.zeros((0, 0)), 0.0)
    middle = [(2 * t + n) // (2 * n) for t in totals]
    left = [t - n * m for t, m in zip(totals, middle, strict=True)]
    sums = vectors.mapInArrow(
        _products(np.array(middle, np.int64)),
        "i int, j int, total decimal(38,0)"
    ).groupBy("i", "j").agg(F.sum("total").alias("total"))
    hi, lo, trace = np.zeros((width, width)), np.zeros((width, width)), Fraction(0)
    for r in sums.collect():
        i, j = r["i"], r["j"]
        entry = Fraction(n * int(r["total"]) - left[i] * left[j], n * n)
        hi[i, j] = hi[j, i] = float(entry)
        lo[i, j] = lo[j, i] = float(entry - Fraction(float(entry)))
        trace += entry if i == j else 0
    values, found = eigen(Pair(hi, lo))
    return Whitening(n, totals, np.where(values > float(trace) * LEAST, values, 0.0), found, float(trace))


def _projected(model: Whitening, components: int):
    totals = np.array(model.totals, object)
    fits = all(abs(t) < 1 << 62 for t in model.totals)
    with np.errstate(divide="ignore", invalid="ignore"):
        turn = model.vectors[:, :components] / np.sqrt(model.values[:components])
    none = model.values[:components] == 0

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x, _ = whole_numbers(batch.column(1), len(totals))
            small = fits and float(np.abs(x).max(initial=0)) * model.n < 2.0**61
            z = x * model.n - totals.astype(np.int64) if small else x.astype(object) * model.n - totals
            length = z.astype(np.float64)
            if small and (length**2).sum(axis=1).max(initial=0) < 2.0**62:
                deviation = pa.array((z * z).sum(axis=1), pa.int64())
            else:
                deviation = pa.array([d if d < 1 << 63 else None for d in (z.astype(object) ** 2).sum(axis=1)], pa.int64())
            told = (length / model.n) @ np.where(none, 0.0, turn)
            values = pa.array(told.ravel(), pa.float64(), mask=np.tile(none, len(told)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(told) + 1) * told.shape[1], pa.int32()), values)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), deviation, lists], ["id", "deviation", "whitened"])

    return rows


def projected(rows: DataFrame, model: Whitening, components: int = COMPONENTS, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """``key``, deviation and whitened (array of the first ``components``) of every good vector."""
    told = rows.select(key, column).mapInArrow(
        _projected(model, components),
        f"id {dict(rows.dtypes)[key]}, deviation long, whitened array<double>"
    )
    return told.withColumnRenamed("id", key)


def identity_error(told: DataFrame, width: int) -> float:
    """The largest distance of an entry of the covariance of ``whitened`` from the identity; null components are left out."""
    entries = [(i, j) for i in range(width) for j in range(i, width)]
    at = lambda i: F.get("whitened", F.lit(i))
    row = told.agg(*[F.covar_pop(at(i), at(j)).alias(f"c{k}") for k, (i, j) in enumerate(entries)]).first()
    return max((abs(c - (i == j)) for (i, j), c in zip(entries, row, strict=True) if c is not None), default=0.0)


def embedding_whitening(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of every good vector and each of the first components."""
    model = fit(embeddings)
    width = min(components, len(model.totals))
    told = projected(embeddings, model, width)
    error = identity_error(told, width) if width else 0.0
    shares = F.array(*[F.lit(float(v / model.trace) if model.trace else 0.0) for v in model.values[:width]]).cast("array<double>")
    out = told.select("vec_id", "deviation", F.posexplode("whitened").alias("k", "whitened"))
    return out.select(
        "vec_id", (F.col("k") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation",
        "whitened", F.get(shares, "k").alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )
