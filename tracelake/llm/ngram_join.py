"""N-gram Jaccard join: near-duplicate documents by the overlap of their shingle sets.

Method: every set keeps a prefix of its rarest shingles, so long that two sets that link
must share a prefix shingle. Sets that share one meet in the tile of that shingle's
smallest holder; large tiles are cut into bands of set size and blocks. In a tile, hashed
bitmap signatures bound each overlap from above by their bit counts, and pairs that the
bound admits are settled by intersecting the sets. Every link is found and counted in one
tile, the smallest that both sets have in common; a tile reports a count and a label for
each set, never all pairs, so a group of copies costs as many rows as members. The pairs
themselves come from ``ngram_links``, one for each two linked classes of equal sets.

Results by case: a null or word-less text has an empty set and links with nothing; a text
with fewer words than the shingle width is one shingle; equal sets are one class and link;
rows that share a doc_id are one node, and n_links counts rows; a null doc_id is kept and never linked; further
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import K1, K2, K3, Words, blocks, lists, mix, signed, sorted_runs
from .graph import checkpointed, components, shuffle_partitions, spare

WIDTH = 3
THRESHOLD = (90, 100)
#: Cells of the hashed shingle counts by which prefixes are ordered.
CELL_BITS = 22
WORD_BITS = 16
#: Bits of the filter that says which sets to fetch; of fixed size, so at worst it lets more through.
FILTER_BITS = 24
#: Sets in a tile and shingles of all its sets, beyond which it is cut into size bands and blocks.
TILE, TILE_NAMES = 4096, 1 << 20


def shingle_names(words: Words, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row in the block, name, first word) of each shingle of consecutive words, repeats included."""
    count = np.diff(words.bounds)
    n = len(words)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    multipliers = mix(np.arange(1, width + 1, dtype=np.uint64) * K3) | np.uint64(1)
    sums = np.zeros(n, np.uint64)
    for k in range(min(width, n)):
        sums[: n - k] += words.name[k:] * multipliers[k]
    at = np.flatnonzero(words.doc[: n - width + 1] == words.doc[width - 1 :]) if n >= width else np.zeros(0, np.int64)
    few = np.flatnonzero((count > 0) & (count < width))
    short = np.zeros(len(few), np.uint64)
    for k in range(width - 1):
        has = count[few] > k
        short[has] += words.name[words.bounds[few[has]] + k] * multipliers[k]
    short += count[few].astype(np.uint64) * K2
    return np.concatenate([words.doc[at], few]), np.concatenate([mix(sums[at]), mix(short)]), np.concatenate([at, words.bounds[few]])


def shingle_sets(words: Words, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``shingle_names``, each name once a row, sorted by row and name."""
    row, name, at = shingle_names(words, width)
    order = np.lexsort((name, row))
    row, name, at = row[order], name[order], at[order]
    if len(row):
        once = np.ones(len(row), bool)
        once[1:] = (row[1:] != row[:-1]) | (name[1:] != name[:-1])
        row, name, at = row[once], name[once], at[once]
    return row, name, at


def set_prints(row: np.ndarray, name: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bounds of each row's set, and two order-free 64-bit prints of it."""
    bounds = np.searchsorted(row, np.arange(rows + 1))
    prints = []
    for k in (K1, K2):
        total = np.zeros(len(name) + 1, np.uint64)
        np.cumsum(mix(name * k + k), out=total[1:])
        prints.append(total[bounds[1:]] - total[bounds[:-1]])
    return bounds, prints[0], prints[1]


@dataclass
class Frequencies:
    """Hashed counts by which prefixes are ordered; of fixed size, whatever the input.

    ``words`` has log2 of the counts of 2**WORD_BITS cells of words, less that of all words.
    ``cells`` says how far each of 2**CELL_BITS cells of shingles stands out in the partitions
    that noticed it, in powers of two. All documents are counted. Any order gives whole
    results; with frequent shingles last, sets that share little share no prefix.
    """

    words: np.ndarray
    total: float
    cells: np.ndarray

    def weight(self, words: Words, name: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
        """0 to 31 for each shingle: the larger of what its words lead one to expect and what was noticed."""
        share = self.words[(words.name >> np.uint64(64 - WORD_BITS)).astype(np.int64)]
        expected = np.full(len(at), self.total)
        for k in range(width):
            expected += share[np.minimum(at + k, len(share) - 1)]
        chance = np.clip(expected + 8, 0, 30).astype(np.int64)
        return np.maximum(chance, self.cells[(name >> np.uint64(64 - CELL_BITS)).astype(np.int64)])


def _cell_counts(width: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, of_words = np.zeros(1 << CELL_BITS, np.int64), np.zeros(1 << WORD_BITS, np.int64)
        for block in blocks(batches, "text"):
            words = Words(block["text"], lower=True)
            name = shingle_names(words, width)[1]
            total += np.bincount((name >> np.uint64(64 - CELL_BITS)).astype(np.int64), minlength=len(total))
            of_words += np.bincount((words.name >> np.uint64(64 - WORD_BITS)).astype(np.int64), minlength=len(of_words))
        cell, word = np.flatnonzero(total > 4 * total.mean() + 3), np.flatnonzero(of_words)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([cell, -1 - word]).astype(np.int32)),
                pa.array(np.concatenate([total[cell], of_words[word]])),
                pa.array(np.full(len(cell) + len(word), total.mean()))
            ],
            names=["cell", "n", "mean"]
        )

    return count


def frequencies(docs: DataFrame, width: int) -> Frequencies:
    told = docs.select("text").mapInArrow(_cell_counts(width), "cell int, n long, mean double").groupBy("cell").agg(
        F.sum("n").alias("n"),
        F.sum(F.col("mean") + 1).alias("mean")
    ).toArrow()
    cell, n, mean = (told[c].to_numpy() for c in ("cell", "n", "mean"))
    counts = np.ones(1 << WORD_BITS)
    counts[-1 - cell[cell < 0]] = n[cell < 0]
    total = np.log2(counts.sum())
    cells = np.zeros(1 << CELL_BITS, np.uint8)
    cells[cell[cell >= 0]] = (9 + np.log2(1 + n / mean)).clip(0, 31).astype(np.uint8)[cell >= 0]
    return Frequencies((np.log2(counts) - total).astype(np.float32), float(total), cells)


def _prefix_rows(width: int, threshold: tuple[int, int], weights):
    part, whole = threshold

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            words = Words(block["text"], lower=True)
            row, name, at = shingle_sets(words, width)
            bounds, f1, f2 = set_prints(row, name, words.rows)
            size = np.diff(bounds)
            weight = weights.value.weight(words, name, at, width)
            order = np.argsort(row * 32 + weight, kind="stable")
            kept = size - (size * part + whole - 1) // whole + (size > 0)
            rank = np.arange(len(row)) - bounds[row]
            chosen = order[rank < kept[row]]
            chosen_bounds = np.concatenate([[0], np.cumsum(kept)])
            bits, bit_bounds = signatures(name, bounds)
            yield pa.RecordBatch.from_arrays(
                [
                    block["doc_id"],
                    pa.array(size),
                    signed(f1),
                    signed(f2),
                    lists(signed(name[chosen]), chosen_bounds),
                    lists(signed(bits), bit_bounds)
                ],
                names=["doc_id", "n_shingles", "f1", "f2", "keys", "signature"]
            )

    return rows


def _place_in_filter(node: np.ndarray) -> np.ndarray:
    return (mix(node.astype(np.int64).view(np.uint64) + K3) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def node_filter(nodes: DataFrame) -> np.ndarray:
    """A hashed bitmap of the nodes, 2**FILTER_BITS bits as bytes, gathered as its words that hold a bit."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = np.unique(_place_in_filter(batch["node"].to_numpy()))
            if len(place):
                word, starts = np.unique(place >> 6, return_index=True)
                bits = np.bitwise_or.reduceat(np.uint64(1) << (place & 63).astype(np.uint64), starts)
                yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int32)), signed(bits)], names=["word", "bits"])

    told = nodes.select("node").mapInArrow(rows, "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    out[told["word"].to_numpy()] = told["bits"].to_numpy().view(np.uint64)
    return out


def _set_rows(width: int, wanted):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = _place_in_filter(batch["doc_id"].fill_null(0).to_numpy())
            hit = (wanted.value[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1) > 0
            for block in blocks([batch.filter(pa.array(hit))], "text"):
                words = Words(block["text"], lower=True)
                row, name, _ = shingle_sets(words, width)
                bounds, f1, _ = set_prints(row, name, words.rows)
                yield pa.RecordBatch.from_arrays([block["doc_id"], signed(f1), lists(signed(name), bounds)], names=["node", "f1", "names"])

    return rows


def signature_words(size: np.ndarray) -> np.ndarray:
    """64-bit words of a set's bitmap: a power of two, two to four bits a name."""
    return np.exp2(np.maximum(2, np.ceil(np.log2(np.maximum(size, 1) / 32)))).astype(np.int64)


def signatures(names: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, bounds): a bitmap of each set, one hashed bit a name."""
    size = np.diff(bounds)
    words = signature_words(size)
    starts = np.concatenate([[0], np.cumsum(words)])
    row = np.repeat(np.arange(len(size)), size)
    bit = (names & (words[row] * 64 - 1).astype(np.uint64)).astype(np.int64)
    cell = starts[row] + (bit >> 6)
    order = np.argsort(cell, kind="stable")
    out = np.zeros(int(starts[-1]), np.uint64)
    if len(order):
        cell, value = cell[order], (np.uint64(1) << (bit & 63).astype(np.uint64))[order]
        firsts = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
        out[cell[firsts]] = np.bitwise_or.reduceat(value, firsts)
    return out, starts


def _folded(bitmap: np.ndarray, width: int) -> np.ndarray:
    """Bitmaps at a smaller power of two of words: a bit's place is kept modulo the width."""
    while bitmap.shape[-1] > width:
        half = bitmap.shape[-1] // 2
        bitmap = bitmap[..., :half] | bitmap[..., half:]
    return bitmap


class Bitmaps:
    """The bitmaps of a tile's sets, each compared at the smaller width of two."""

    def __init__(self, size: np.ndarray, words: np.ndarray, bounds: np.ndarray):
        self.size, self.width = size, np.diff(bounds)
        self.place = np.zeros(len(size), np.int64)
        self.whole: dict[int, np.ndarray] = {}
        for w in np.unique(self.width).tolist():
            rows = np.flatnonzero(self.width == w)
            self.place[rows] = np.arange(len(rows))
            self.whole[w] = words[bounds[rows][:, None] + np.arange(w)]
        self.folded: dict[tuple[int, int], np.ndarray] = {}

    def at_width(self, width: int, narrow: int) -> np.ndarray:
        """The bitmaps of ``width`` words, folded to ``narrow`` ones."""
        if width == narrow:
            return self.whole[width]
        if (width, narrow) not in self.folded:
            self.folded[width, narrow] = _folded(self.whole[width], narrow)
        return self.folded[width, narrow]

    def admitted(self, x: int, others: np.ndarray, threshold: tuple[int, int]) -> np.ndarray:
        """Of ``others``, those that sizes and bit counts do not rule out as partners of ``x``.

        Each bit that only one set has stands for a name that the other lacks, so the overlap
        is at most the set's size less its lone bits.
        """
        part, whole = threshold
        size, w = self.size, int(self.width[x])
        others = others[np.minimum(size[others], size[x]) * whole >= np.maximum(size[others], size[x]) * part]
        if not len(others):
            return others
        fits = []
        for v in np.unique(self.width[others]).tolist():
            rows = others[self.width[others] == v]
            own = self.at_width(w, min(v, w))[self.place[x]]
            other = self.at_width(v, min(v, w))[self.place[rows]]
            most = np.minimum(
                size[x] - np.bitwise_count(own & ~other).sum(1, dtype=np.int64),
                size[rows] - np.bitwise_count(other & ~own).sum(1, dtype=np.int64)
            )
            fits.append(rows[most * (whole + part) >= part * (size[rows] + size[x])])
        return np.concatenate(fits) if fits else others[:0]


class Sharing:
    """How many values the lists of a tile's sets have in common."""

    def __init__(self, values: np.ndarray, bounds: np.ndarray):
        kinds, ids = np.unique(values, return_inverse=True)
        self.ids, self.bounds, self.mark = ids.astype(np.int32), bounds, np.zeros(len(kinds), bool)

    def counts(self, x: int, others: np.ndarray) -> np.ndarray:
        mine = self.ids[self.bounds[x] : self.bounds[x + 1]]
        lengths = self.bounds[others + 1] - self.bounds[others]
        ends = np.cumsum(lengths)
        self.mark[mine] = True
        theirs = self.mark[self.ids[np.repeat(self.bounds[others] - (ends - lengths), lengths) + np.arange(ends[-1])]]
        self.mark[mine] = False
        total = np.concatenate([[0], np.cumsum(theirs)])
        return total[ends] - total[ends - lengths]


def tile_links(names: np.ndarray, bounds: np.ndarray, threshold: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """All links among the sets of one tile, as two arrays of places in it, the smaller first."""
    part, whole = threshold
    size = np.diff(bounds)
    bitmaps, sharing = Bitmaps(size, *signatures(names, bounds)), Sharing(names, bounds)
    first, second = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for x in range(len(size) - 1):
        fits = bitmaps.admitted(x, np.arange(x + 1, len(size)), threshold)
        if len(fits):
            linked = fits[sharing.counts(x, fits) * (whole + part) >= part * (size[fits] + size[x])]
            first.append(np.full(len(linked), x))
            second.append(linked)
    return np.concatenate(first), np.concatenate(second)


def least_reached(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest of ``n`` places that each reaches by the links a, b."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def counted_here(
    a: np.ndarray, b: np.ndarray, tile: int, tiles: np.ndarray, bounds: np.ndarray, band: np.ndarray, block: np.ndarray, part: str
) -> np.ndarray:
    """Which of a tile's links count in it: those that no smaller tile holds and no other part of it counts.

    Of a tile in bands and blocks, a link counts in the lower band of its two sets, and
    within one block in that block's own part.
    """
    here = np.ones(len(a), bool)
    if part:
        own, low, high = (int(x) for x in part.split(":"))
        here &= np.minimum(band[a], band[b]) == own
        if low != high:
            here &= block[a] != block[b]
    if len(a):
        starts = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
        smaller = [np.unique(tiles[lo:hi][tiles[lo:hi] < tile]) for lo, hi in zip(bounds[:-1], bounds[1:], strict=True)]
        sharing = Sharing(np.concatenate(smaller), np.concatenate([[0], np.cumsum([len(x) for x in smaller])]))
        for lo, hi in zip(starts, [*starts[1:], len(a)], strict=True):
            here[lo:hi] &= sharing.counts(int(a[lo]), b[lo:hi]) == 0
    return here


def _groups(batches: Iterator[pa.RecordBatch], column: str):
    """(table, its ``column`` as offsets and values, starts and ends of its tiles) of a sorted stream."""
    for table, starts in sorted_runs(batches, ["tile", "part"]):
        values = table[column].combine_chunks()
        values = values.chunk(0) if isinstance(values, pa.ChunkedArray) else values
        yield table, values.offsets.to_numpy(), values.values.to_numpy().view(np.uint64), list(
            zip(starts, [*starts[1:], table.num_rows], strict=True)
        )


def _candidates(threshold: tuple[int, int]):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds, bits, tiles in _groups(batches, "signature"):
            size = table["n_shingles"].to_numpy()
            keep = np.zeros(table.num_rows, bool)
            for lo, hi in tiles:
                bitmaps = Bitmaps(size[lo:hi], bits[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo])
                for x in range(hi - lo - 1):
                    fits = bitmaps.admitted(x, np.arange(x + 1, hi - lo), threshold)
                    keep[lo + fits] = True
                    keep[lo + x] |= len(fits) > 0
            yield from table.filter(pa.array(keep)).select(
                ["tile", "part", "node", "n_shingles", "f1", "weight", "band", "block"]
            ).combine_chunks().to_batches()

    return rows


def _links(threshold: tuple[int, int], pairs: bool):
    """Rows of each set of a tile (node, f1, links counted here, smallest node reached), or the pairs counted here."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds, names, places in _groups(batches, "names"):
            node, print_, weight, band, block, tile = (table[c].to_numpy() for c in ("node", "f1", "weight", "band", "block", "tile"))
            tiles = table["tiles"].combine_chunks()
            tiles = tiles.chunk(0) if isinstance(tiles, pa.ChunkedArray) else tiles
            tile_bounds, tile_values = tiles.offsets.to_numpy(), tiles.values.to_numpy()
            for lo, hi in places:
                # rows that repeat under one doc_id bring the same set again
                again = (node[lo + 1 : hi] == node[lo : hi - 1]) & (print_[lo + 1 : hi] == print_[lo : hi - 1])
                at = lo + np.flatnonzero(np.append(True, ~again))
                if len(at) < 2:
                    continue
                own, own_bounds = _taken(names, bounds, at)
                a, b = tile_links(own, own_bounds, threshold)
                if not len(a):
                    continue
                here = counted_here(a, b, tile[lo], *_taken(tile_values, tile_bounds, at), band[at], block[at], table["part"][lo].as_py())
                if pairs:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x[at][y[here]]) for y in (a, b) for x in (node, print_)],
                        names=["a", "a_print", "b", "b_print"]
                    )
                    continue
                label = least_reached(len(at), a, b)
                links = np.zeros(len(at), np.int64)
                np.add.at(links, a[here], weight[at][b[here]])
                np.add.at(links, b[here], weight[at][a[here]])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node[at]), pa.array(print_[at]), pa.array(links), pa.array(node[at][label])],
                    names=["node", "f1", "links", "label"]
                )

    return rows


def _taken(values: np.ndarray, bounds: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists at the given places, as values and bounds."""
    lengths = bounds[at + 1] - bounds[at]
    ends = np.cumsum(lengths)
    return values[np.repeat(bounds[at] - (ends - lengths), lengths) + np.arange(ends[-1])], np.concatenate([[0], ends])


def tiled(members: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """``members`` (tile, node, n_shingles) with the ``part`` of the tile: "" or, of a large tile, band and blocks;
    and with the set's own band and block.

    Two sets that may link are of the same band of sizes or of neighbouring ones, and so
    meet in the lower band; bands beyond TILE sets or TILE_NAMES shingles are hashed to
    blocks, which meet in pairs.
    """
    share = F.ceil(F.greatest(F.count("*") / TILE, F.sum("n_shingles") / TILE_NAMES)).cast("int")
    counts = members.groupBy("tile").agg(F.count("*").alias("members"), share.alias("share")).where("members > 1").drop("members")
    told = members.join(counts, "tile")
    small = told.where("share <= 1").select(
        "tile",
        F.lit("").alias("part"),
        "node",
        "n_shingles",
        F.lit(0).cast("long").alias("band"),
        F.lit(0).alias("block")
    )
    # sizes at the bound are one band apart, however their logarithms are rounded
    own = F.floor(F.log(F.col("n_shingles")) / math.log(threshold[1] / threshold[0]) + 1e-9)
    banded = told.where("share > 1").select("tile", "node", "n_shingles", own.alias("own"), F.explode(F.array(own, own - 1)).alias("band"))
    per_band = banded.groupBy("tile", "band").agg(
        F.count("*").alias("members"),
        share.alias("blocks")
    ).where("members > 1").select("tile", "band", "blocks")
    blocked = banded.join(per_band, ["tile", "band"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    blocked = blocked.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return small.unionByName(
        blocked.select(
            "tile",
            F.concat_ws(":", "band", F.least("block", "other"), F.greatest("block", "other")).alias("part"),
            "node",
            "n_shingles",
            F.col("own").alias("band"),
            "block"
        )
    )


def _placed(docs: DataFrame, width: int, threshold: tuple[int, int]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sets of the documents, classes of equal sets, the sets of each tile part in which links are sought)."""
    spark = docs.sparkSession
    weights = spark.sparkContext.broadcast(frequencies(docs, width))
    sets = checkpointed(
        docs.mapInArrow(
            _prefix_rows(width, threshold, weights),
            "doc_id long, n_shingles long, f1 long, f2 long, keys array<long>, signature array<long>"
        )
    )
    filled = sets.where("n_shingles > 0 and doc_id is not null")
    classes = checkpointed(
        filled.groupBy("n_shingles", "f1", "f2").agg(
            F.min("doc_id").alias("node"),
            F.count("*").alias("weight"),
            F.first("keys").alias("keys"),
            F.first("signature").alias("signature")
        )
    )
    keyed = classes.select("node", "n_shingles", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("node").alias("tile"), F.count("*").alias("n")).where("n > 1").select("key", "tile")
    members = checkpointed(keyed.join(shared, "key").select("tile", "node", "n_shingles").distinct())
    parts = shuffle_partitions(docs.sparkSession)
    tiles = tiled(members, threshold).join(classes.select("node", "n_shingles", "f1", "weight", "signature"), ["node", "n_shingles"])
    tiles = tiles.select(
        "tile",
        "part",
        "node",
        "n_shingles",
        "f1",
        "weight",
        "band",
        "block",
        "signature"
    ).repartition(parts, "tile", "part").sortWithinPartitions("tile", "part")
    candidates = checkpointed(
        tiles.mapInArrow(_candidates(threshold), "tile long, part string, node long, n_shingles long, f1 long, weight long, band long, block int")
    )

    wanted = docs.sparkSession.sparkContext.broadcast(node_filter(candidates))
    names = docs.mapInArrow(_set_rows(width, wanted), "node long, f1 long, names array<long>")
    # two sets that link are candidates in each tile that holds both, so these tiles tell which one counts the link
    tiles_of = candidates.groupBy("node", "n_shingles").agg(F.collect_set("tile").alias("tiles"))
    placed = candidates.join(tiles_of, ["node", "n_shingles"]).join(names, ["node", "f1"]).select("tile", "part", "node", "f1", "weight", "band", "block", "tiles", "names")
    return sets, classes, placed.repartition(parts, "tile", "part").sortWithinPartitions("tile", "part", "node", "f1")


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def ngram_links(docs: DataFrame, width: int = WIDTH, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """a, b: the class_id of every two classes of equal sets that link, once, the smaller first.

    Every document of one class links with every one of the other, and those of a class with
    each other. Rows of one doc_id with other texts are classes of their own.
    """
    _, _, placed = _placed(_documents(docs), width, threshold)
    return placed.mapInArrow(_links(threshold, True), "a long, a_print long, b long, b_print long").select("a", "b")


def ngram_join(docs: DataFrame, width: int = WIDTH, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, class_id, component_id, n_links for each document.

    Documents link when ``whole * intersection >= part * union`` of their sets of distinct
    ``width``-word shingles (A-Z lower-cased), for ``threshold`` = (part, whole).
    ``class_id`` is the smallest doc_id with the same set, ``component_id`` the smallest
    doc_id reachable by links; both are the doc_id itself where there is none. ``n_links``
    is the number of other rows that link with the row.
    """
    sets, classes, placed = _placed(_documents(docs), width, threshold)
    told = checkpointed(placed.mapInArrow(_links(threshold, False), "node long, f1 long, links long, label long"))
    counts = told.groupBy("node", "f1").agg(F.sum("links").alias("links"))
    linked = components(told.select(F.col("node").alias("a"), F.col("label").alias("b")))
    of_class = classes.join(counts, ["node", "f1"], "left").select(
        "n_shingles",
        "f1",
        "f2",
        F.col("node").alias("class_id"),
        (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("links")
    )
    out = sets.select("doc_id", "n_shingles", "f1", "f2").join(of_class, ["n_shingles", "f1", "f2"], "left").join(
        linked.withColumnRenamed("node", "class_id"),
        "class_id",
        "left"
    )
    known = F.col("doc_id").isNotNull()
    return out.select(
        "doc_id",
        "n_shingles",
        F.when(known, F.coalesce("class_id", "doc_id")).alias("class_id"),
        F.when(known, F.coalesce("component", "class_id", "doc_id")).alias("component_id"),
        F.when(known, F.coalesce("links", F.lit(0))).otherwise(0).alias("n_links")
    )


def without_near_copies(docs: DataFrame, width: int, threshold: tuple[int, int]) -> DataFrame:
    """``docs`` with one document of each component of links, the one with the smallest doc_id; all columns stay."""
    (own,) = spare(docs, "gone")
    gone = ngram_join(docs, width, threshold).where("component_id < doc_id").select(F.col("doc_id").alias(own)).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone[own], "left_anti")
