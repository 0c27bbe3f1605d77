"""Embedding near-dedup by cross-polytope hashing.

Method: a vector is padded to a power of two, its signs are flipped at random and it is
turned by a fast Hadamard transform, three times over; the nearest vertex of the cross
polytope (largest absolute coordinate, with its sign) is one hash, and ``HASHES`` of them
name a bucket. In each of ``TABLES`` tables a vector also lies in the buckets that the
second-nearest vertex of one hash gives (multiprobe). Vectors that share a bucket meet in
the tile of the bucket's smallest member, where a blocked matrix product in double
precision verifies every pair; a pair that meets in several tiles counts in one.

Equal vectors of a label are one class with a weight, so copies are never paired. A tile
beyond TILE classes is cut into hashed blocks, which meet in pairs; a tile gives counts of
links and a spanning forest, never all pairs.

Results by case: vectors that are null, empty, zero, or hold null or non-finite components,
and rows without a label, link with nothing and are their own component; vectors of
different lengths do not link; rows that repeat, also with the same vec_id, count as other
vectors; a null vec_id takes part but has a null component of its own if it is alone;
further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import K1, K2, lists, mix, signed, sorted_runs
from .graph import checkpointed, components, shuffle_partitions

LEAST = 0.98
TABLES = 8
HASHES = 3
TILE = 1024


def hadamard(x: np.ndarray) -> np.ndarray:
    """The unnormalised fast Walsh-Hadamard transform of each row."""
    n = x.shape[1]
    half = 1
    while half < n:
        x = x.reshape(len(x), n // (2 * half), 2, half)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(len(x), n)
        half *= 2
    return x


def _signs(seed: int, n: int) -> np.ndarray:
    bits = mix(np.arange(n, dtype=np.uint64) + np.array([seed], np.uint64) * K1) >> np.uint64(63)
    return 1.0 - 2.0 * bits.astype(np.float64)


def bucket_codes(vectors: np.ndarray, label: np.ndarray, tables: int = TABLES, hashes: int = HASHES) -> np.ndarray:
    """rows x (tables * (1 + hashes)) bucket names: the nearest vertices, then one of them replaced by the second."""
    rows, length = vectors.shape
    n = max(2, 1 << (length - 1).bit_length())
    padded = np.zeros((rows, n))
    padded[:, :length] = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    base = mix(label.astype(np.int64).view(np.uint64) * K2 + np.uint64(length))
    out = np.empty((rows, tables * (1 + hashes)), np.uint64)
    for t in range(tables):
        nearest, second = [], []
        for h in range(hashes):
            turned = padded
            for k in range(3):
                turned = hadamard(turned * _signs((t * hashes + h) * 3 + k + 1, n)) / np.sqrt(n)
            size = np.abs(turned)
            first = size.argmax(axis=1)
            sign = lambda at: (turned[np.arange(rows), at] < 0).astype(np.uint64)  # noqa: E731, B023
            nearest.append(first.astype(np.uint64) * np.uint64(2) + sign(first))
            size[np.arange(rows), first] = -1
            other = size.argmax(axis=1)
            second.append(other.astype(np.uint64) * np.uint64(2) + sign(other))
        for probe in range(1 + hashes):
            name = base + np.uint64(t + 1)
            for h in range(hashes):
                name = mix(name * K1 + (second[h] if probe == h + 1 else nearest[h]))
            out[:, t * (1 + hashes) + probe] = name
    return out


def _by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix in double precision) for each length of vector in a list column."""
    bounds = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)
    length = np.diff(bounds)
    for n in np.unique(length).tolist():
        rows = np.flatnonzero(length == n)
        yield rows, values[bounds[rows][:, None] + np.arange(n)].astype(np.float64)


def _code_rows(tables: int, hashes: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = tables * (1 + hashes)
        for batch in batches:
            label = batch["label"].to_numpy()
            for own, matrix in _by_length(batch["embedding"]):
                codes = np.sort(bucket_codes(matrix, label[own], tables, hashes), axis=1)
                yield pa.RecordBatch.from_arrays(
                    [batch["node"].take(pa.array(own)), lists(signed(codes.ravel()), np.arange(len(own) + 1) * width)],
                    names=["node", "codes"]
                )

    return rows


def tile_links(
    node: np.ndarray, block: np.ndarray, split: bool, weight: np.ndarray, unit: np.ndarray, tile: int, tiles: list[np.ndarray], least: float
) -> tuple[np.ndarray, np.ndarray]:
    """(links counted here, smallest node linked through pairs seen here) of each class of one tile.

    A pair counts unless a smaller tile also holds both; in a tile cut in blocks, pairs of one
    block count in that block's own part only.
    """
    n = len(node)
    linked = unit @ unit.T >= least
    np.fill_diagonal(linked, False)
    if split:
        linked &= block[:, None] != block[None]
    label = node.copy()
    high = np.iinfo(np.int64).max
    while True:
        new = np.minimum(label, np.where(linked, label[None], high).min(axis=1, initial=high))
        if (new == label).all():
            break
        label = new
    smaller = [x[x < tile] for x in tiles]
    flat = np.concatenate(smaller) if n else np.zeros(0, np.int64)
    if len(flat):
        names, back = np.unique(flat, return_inverse=True)
        holds = np.zeros((n, len(names)), np.float32)
        holds[np.repeat(np.arange(n), [len(x) for x in smaller]), back] = 1
        linked &= ~(holds @ holds.T > 0)
    return linked @ weight, label


def _tile_rows(least: float):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in sorted_runs(batches, ["tile", "a", "b"]):
            node, weight, block = (table[c].to_numpy() for c in ("node", "weight", "block"))
            tile, a, b = (table[c].to_numpy() for c in ("tile", "a", "b"))
            vectors, tiles = table["embedding"].combine_chunks(), table["tiles"].combine_chunks()
            bounds, values = vectors.offsets.to_numpy(), vectors.values.to_numpy(zero_copy_only=False)
            tile_bounds, tile_values = tiles.offsets.to_numpy(), tiles.values.to_numpy()
            nodes, counts, labels = [], [], []
            for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), table.num_rows], strict=True):
                if hi - lo < 2:
                    continue
                matrix = values[bounds[lo] : bounds[hi]].astype(np.float64).reshape(hi - lo, -1)
                unit = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
                own = [tile_values[tile_bounds[k] : tile_bounds[k + 1]] for k in range(lo, hi)]
                count, label = tile_links(node[lo:hi], block[lo:hi], a[lo] != b[lo], weight[lo:hi], unit, tile[lo], own, least)
                nodes.append(node[lo:hi])
                counts.append(count)
                labels.append(label)
            if nodes:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(nodes)), pa.array(np.concatenate(counts).astype(np.int64)), pa.array(np.concatenate(labels))],
                    names=["node", "links", "label"]
                )

    return rows


def usable(column: str = "embedding"):
    """Whether a vector is neither null nor zero and all its components are finite numbers."""
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(column, lambda x: x != 0), F.lit(False))


def near_vectors(embeddings: DataFrame, least: float = LEAST, tables: int = TABLES, hashes: int = HASHES) -> DataFrame:
    """vec_id, n_links, component_id, kept for each vector; links are found pairs of one label with cosine >= ``least``."""
    parts = shuffle_partitions(embeddings.sparkSession)
    rows = embeddings.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("embedding").cast("array<float>").alias("embedding"),
        F.col("label").cast("long").alias("label")
    )
    able = usable() & F.col("label").isNotNull()
    rows = rows.withColumn("node", F.when(able, F.xxhash64("label", F.size("embedding"), "embedding")))
    classes = rows.where("node is not null").groupBy("node").agg(
        F.min("vec_id").alias("first"),
        F.count("*").alias("weight"),
        F.first("label").alias("label"),
        F.first("embedding").alias("embedding")
    )
    classes = checkpointed(classes)
    codes = classes.select("node", "label", "embedding").mapInArrow(
        _code_rows(tables, hashes),
        "node long, codes array<long>"
    ).select("node", F.explode("codes").alias("code"))
    codes = checkpointed(codes)
    shared = codes.groupBy("code").agg(
        F.min("node").alias("tile"),
        F.count_distinct("node").alias("n")
    ).where("n > 1").select("code", "tile")
    members = checkpointed(codes.join(shared, "code").select("tile", "node").distinct())
    tiles_of = members.groupBy("node").agg(F.sort_array(F.collect_set("tile")).alias("tiles"))
    counts = members.groupBy("tile").agg(F.count("*").alias("members")).where("members > 1")
    blocks = F.ceil(F.col("members") / TILE).cast("int")
    placed = members.join(counts, "tile").withColumn("blocks", blocks).withColumn(
        "block",
        F.pmod(F.xxhash64("node", F.lit(5)), F.col("blocks")).cast("int")
    )
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("tile", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "block", "node")
    placed = placed.join(tiles_of, "node").join(classes.select("node", "weight", "embedding"), "node")
    placed = placed.select(
        "tile",
        "a",
        "b",
        "block",
        "node",
        "weight",
        "tiles",
        "embedding"
    ).repartition(parts, "tile", "a", "b").sortWithinPartitions("tile", "a", "b", "node")
    told = checkpointed(placed.mapInArrow(_tile_rows(least), "node long, links long, label long"))
    links = told.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(told.select(F.col("node").alias("a"), F.col("label").alias("b")))
    grouped = classes.select("node", "first", "weight").join(links, "node", "left").join(joined, "node", "left").withColumn(
        "component",
        F.coalesce("component", "node")
    )
    least_id = grouped.groupBy("component").agg(F.min("first").alias("component_id"))
    grouped = grouped.join(least_id, "component").select(
        "node",
        (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        "component_id"
    )
    out = rows.select("vec_id", "node").join(grouped, "node", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept")
    )
