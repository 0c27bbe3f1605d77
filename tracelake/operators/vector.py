"""Embeddings: chunks, pending work, exact nearest neighbours, rank fusion."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .materialize import materialized


def chunks(messages: DataFrame, width: int = 2000) -> DataFrame:
    """``messages`` with chunk_index and chunk_text: pieces of ``width`` characters; empty texts give none."""
    starts = F.sequence(F.lit(0), F.floor((F.length("content") - 1) / width).cast("int"))
    told = messages.where(F.length("content") > 0).withColumn("chunk_index", F.explode(starts))
    return told.withColumn("chunk_text", F.expr(f"substring(content, chunk_index * {width} + 1, {width})"))


def pending(messages: DataFrame, embedded: DataFrame, limit: int = 200) -> DataFrame:
    """The first ``limit`` messages with content and without a vector, by id."""
    return messages.where(F.trim("content") != "").join(
        embedded.select(F.col("message_id").alias("id")),
        "id",
        "left_anti"
    ).orderBy(F.length("id"), "id").limit(limit)


def embedded(texts: DataFrame, column: str, embed: Callable[[list[str]], list[list[float]]]) -> DataFrame:
    """``texts`` with ``embedding`` from a function of batches of texts."""

    @F.pandas_udf("array<float>")
    def vectors(batch: pd.Series) -> pd.Series:
        return pd.Series(embed(batch.tolist()))

    return texts.withColumn("embedding", vectors(column))


def _binary(lists: pa.Array) -> pa.Array:
    """Lists of floats as binaries of float32 values; values are copied only where their type differs or a null stands for 0."""
    lists = lists.cast(pa.list_(pa.float32()))
    values = lists.values
    values = values.fill_null(0.0) if values.null_count else values
    ends = np.frombuffer(lists.buffers()[1], np.int32)[lists.offset : lists.offset + len(lists) + 1]
    held = values.buffers()[1]
    data = held.slice(values.offset * 4) if held is not None else pa.py_buffer(b"")
    valid = pa.array(lists.is_valid())
    told = pa.Array.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(ends.astype(np.int64) * 4), data])
    return pc.if_else(valid, told, pa.scalar(None, pa.large_binary())).cast(pa.binary())


def float_lists(packed: pa.Array) -> pa.Array:
    """Binaries of float32 values as lists, on the same bytes where each holds whole values; what remains of others is left out."""
    packed = packed.cast(pa.large_binary())
    _, offsets, data = packed.buffers()
    ends = np.frombuffer(offsets, np.int64)[packed.offset : packed.offset + len(packed) + 1]
    size = np.where(packed.is_valid().to_numpy(zero_copy_only=False), np.diff(ends), 0)
    if data is None:
        values, starts = np.zeros(0, np.float32), np.zeros(len(packed) + 1, np.int64)
    elif (size % 4 == 0).all() and (np.diff(ends) == size).all() and (data.address + int(ends[0])) % 4 == 0:
        values, starts = np.frombuffer(data, np.float32, int(size.sum()) // 4, int(ends[0])), (ends - ends[0]) // 4
    else:
        raw = np.frombuffer(data, np.uint8)
        starts = np.append(0, np.cumsum(size // 4))
        at = np.arange(starts[-1] * 4) + np.repeat(ends[:-1] - starts[:-1] * 4, size // 4 * 4)
        values = raw[at].view(np.float32)
    return pa.LargeListArray.from_arrays(pa.array(starts), pa.array(values), mask=packed.is_null())


def packed(vector: str | Column) -> Column:
    """A vector as the bytes of its values in float32, lowest first; a null entry is 0, a null vector null."""

    @F.arrow_udf("binary")
    def pack(batch: pa.Array) -> pa.Array:
        return _binary(batch)

    return pack(vector)


def unpacked(data: str | Column) -> Column:
    """The vector that bytes hold; bytes beyond the last whole value are left out."""

    @F.arrow_udf("array<float>")
    def unpack(batch: pa.Array) -> pa.Array:
        return float_lists(batch).cast(pa.list_(pa.float32()))

    return unpack(data)


def embedding_run(
    messages: DataFrame, held: DataFrame, embed: Callable[[list[str]], list[list[float]]], model: str, limit: int = 200
) -> DataFrame:
    """message_id, session_id, chunk_index, chunk_text, embedding (packed), embedding_model, dimensions of the first
    ``limit`` messages that ``held`` (message_id) has no vector of: what a run adds to the store."""
    told = embedded(chunks(pending(messages, held, limit)), "chunk_text", embed)
    said = told.select(
        F.col("id").alias("message_id"),
        "session_id",
        "chunk_index",
        "chunk_text",
        F.size("embedding").alias("dimensions"),
        packed("embedding").alias("embedding")
    )
    return said.withColumn("embedding_model", F.lit(model))


def cosine(a: str | Column, b: str | Column) -> Column:
    """Cosine in double precision over the shorter length; 0 where a norm is 0."""
    pairs = F.filter(
        F.arrays_zip(
            F.col(a).alias("x") if isinstance(a, str) else a.alias("x"),
            F.col(b).alias("y") if isinstance(b, str) else b.alias("y")
        ),
        lambda p: p["x"].isNotNull() & p["y"].isNotNull()
    )
    total = lambda f: F.aggregate(pairs, F.lit(0.0), lambda acc, p: acc + f(p))
    dot = total(lambda p: p["x"].cast("double") * p["y"].cast("double"))
    norm = F.sqrt(
        total(lambda p: p["x"].cast("double") * p["x"].cast("double"))
    ) * F.sqrt(total(lambda p: p["y"].cast("double") * p["y"].cast("double")))
    return F.when(norm == 0, 0.0).otherwise(dot / norm)


#: Rows of a block of vectors and of a block of queries, the cells of the grid at least while a block keeps LEAST_ROWS
#: vectors, and the vectors and queries that a task multiplies at once.
VECTORS_IN_BLOCK, QUERIES_IN_BLOCK, LEAST_CELLS, LEAST_ROWS = 65_536, 4_096, 32, 2_048
ROWS_AT_ONCE, PRODUCT = 8_192, 256


def nearest(vectors: DataFrame, queries: DataFrame, limit: int = 10) -> DataFrame:
    """query_id, message_id, session_id, cosine, pos: the best chunk of each session for each query vector.

    Vectors and query vectors (query_id, query_vector) are dealt into blocks of bounded size, of
    which each two meet in a task, as matrix products; it sends on the best ``limit`` sessions of
    its block for each query, so memory doesn't grow with either table and rows only with the
    number of blocks. An embedding is an array or the packed bytes of one, which are read where
    they lie. Vectors that are null or hold a null count as empty; the cosine is over the shorter
    length and 0 where a norm is 0.
    """
    asked = materialized(queries.select("query_id", F.col("query_vector").cast("array<double>").alias("query_vector")))
    held = F.col("embedding") if dict(vectors.dtypes)["embedding"] == "binary" else F.col("embedding").cast("array<double>")
    told = vectors.select("message_id", "session_id", held.alias("embedding"))
    schema = asked.select("query_id").schema.fields + told.select("message_id", "session_id").schema.fields
    schema = StructType([*schema, StructField("cosine", DoubleType())])
    parts = lambda n, most: max(1, -(-n // most))
    number, slices = vectors.count(), parts(asked.count(), QUERIES_IN_BLOCK)
    blocks = max(parts(number, VECTORS_IN_BLOCK), min(parts(number, LEAST_ROWS), parts(LEAST_CELLS, slices)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    left = told.withColumn("_block", dealt("message_id", blocks)).withColumn("_slice", every(slices))
    right = asked.withColumn("_slice", dealt("query_id", slices)).withColumn("_block", every(blocks))
    grid = left.groupBy("_block", "_slice").cogroup(right.groupBy("_block", "_slice"))
    found = grid.applyInArrow(_near_rows(limit), schema)
    one = found.withColumn(
        "_n",
        F.row_number().over(W.partitionBy("query_id", "session_id").orderBy(F.desc("cosine"), "message_id"))
    ).where("_n = 1").drop("_n")
    order = W.partitionBy("query_id").orderBy(F.desc("cosine"), "session_id")
    return one.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= limit)


def _by_length(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Length of vector to (rows, matrix); null vectors and those with a null count as empty."""
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        column = float_lists(column)
    told = column.is_valid().to_numpy(zero_copy_only=False)
    length = pc.list_value_length(column).fill_null(0).to_numpy().astype(np.int64)
    values = column.flatten()
    start = np.cumsum(np.where(told, length, 0)) - np.where(told, length, 0)
    if values.null_count:
        bad = np.unique(np.repeat(np.arange(len(length)), np.where(told, length, 0))[values.is_null().to_numpy(zero_copy_only=False)])
        length[bad] = 0
    numbers = values.cast(pa.float64()).to_numpy(zero_copy_only=False)
    out = {}
    for n in np.unique(length).tolist():
        rows = np.flatnonzero(length == n)
        out[n] = (rows, numbers[start[rows][:, None] + np.arange(n)].reshape(len(rows), n))
    return out


def _normed(matrix: np.ndarray, n: int) -> np.ndarray:
    """The first ``n`` entries of each row over their norm; zeros where it is 0."""
    cut = matrix[:, :n]
    norm = np.sqrt((cut * cut).sum(1))[:, None]
    return cut / np.where(norm > 0, norm, 1.0)


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each row of ``a`` with that of ``b``, to six decimals."""
    norm = np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1))
    return np.round(np.where(norm > 0, (a * b).sum(1) / np.where(norm > 0, norm, 1.0), 0.0), 6)


def _by_id(vectors: pa.Table) -> pa.Table:
    """In the order of session and message, by which equal cosines are told apart."""
    ids = vectors["message_id"].combine_chunks()
    ids = ids.flatten() if pa.types.is_struct(ids.type) else [ids]
    keys = pa.table([vectors["session_id"], *ids], names=[str(k) for k in range(len(ids) + 1)])
    return vectors.take(pc.sort_indices(keys, sort_keys=[(c, "ascending") for c in keys.column_names], null_placement="at_start"))


def _near_rows(limit: int):
    def rows(vectors: pa.Table, asked: pa.Table) -> pa.Table:
        vectors = _by_id(vectors).combine_chunks()
        groups = _by_length(_whole(asked["query_vector"])) if asked.num_rows else {}
        session = pc.dictionary_encode(_whole(vectors["session_id"]), null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        least = np.full(asked.num_rows, -np.inf)  # the cosine of a query's session number ``limit``; an equal one comes later
        query, row, near = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for lo in range(0, vectors.num_rows, ROWS_AT_ONCE):
            own = session[lo : lo + ROWS_AT_ONCE]
            starts = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            parts = _by_length(_whole(vectors["embedding"].slice(lo, ROWS_AT_ONCE)))
            found = [(query, row, near)]
            for wanted, matrix in groups.values():
                for at in range(0, len(wanted), PRODUCT):
                    some, part = wanted[at : at + PRODUCT], matrix[at : at + PRODUCT]
                    about = np.empty((len(own), len(some)))
                    for place, values in parts.values():
                        n = min(values.shape[1], part.shape[1])
                        about[place] = _normed(values, n) @ _normed(part, n).T
                    floor = least[some]
                    if np.isinf(floor).any() and len(starts) > limit:
                        best = np.maximum.reduceat(about, starts, axis=0) if len(starts) < len(own) else about
                        floor = np.maximum(floor, -np.partition(-best, limit - 1, axis=0)[limit - 1])
                    good, which = np.nonzero(about >= floor - 2e-6)
                    cosine = np.zeros(len(good))
                    for place, values in parts.values():
                        n, inside = min(values.shape[1], part.shape[1]), np.full(len(own), -1)
                        inside[place] = np.arange(len(place))
                        for k in range(0, len(good), ROWS_AT_ONCE):
                            spot = inside[good[k : k + ROWS_AT_ONCE]]
                            here = np.flatnonzero(spot >= 0)
                            cosine[k + here] = _cosines(values[spot[here], :n], part[which[k + here], :n])
                    above = cosine > least[some[which]]
                    found.append((some[which[above]], lo + good[above], cosine[above]))
            query, row, near = _best_of(*(np.concatenate(x) for x in zip(*found, strict=True)), session, limit, least)
        query, row = pa.array(query), pa.array(row)
        told = [asked["query_id"].take(query), vectors["message_id"].take(row), vectors["session_id"].take(row), pa.array(near)]
        return pa.Table.from_arrays(told, names=["query_id", "message_id", "session_id", "cosine"])

    return rows


def _whole(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def _best_of(
    query: np.ndarray, row: np.ndarray, near: np.ndarray, session: np.ndarray, limit: int, least: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best row of each session for each query, the first ``limit`` of a query; ``least`` gets the last one's cosine."""
    order = np.lexsort((row, -near, query))
    query, row, near = query[order], row[order], near[order]
    once = np.sort(np.unique(query * (len(session) + 1) + session[row], return_index=True)[1])
    query, row, near = query[once], row[once], near[once]
    first = np.flatnonzero(np.append(True, query[1:] != query[:-1])[: len(query)])
    pos = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
    least[query[pos == limit - 1]] = near[pos == limit - 1]
    kept = pos < limit
    return query[kept], row[kept], near[kept]


def fused(lists: list[DataFrame], limit: int = 10, k: int = 60) -> DataFrame:
    """query_id, session_id, score, pos: reciprocal ranks of lists (query_id, session_id, pos), summed."""
    told = None
    for one in lists:
        part = one.select("query_id", "session_id", (F.lit(1.0) / (k + F.col("pos"))).alias("part"))
        told = part if told is None else told.unionByName(part)
    scored = told.groupBy("query_id", "session_id").agg(F.round(F.sum("part"), 9).alias("score"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "session_id")
    return scored.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= limit)
