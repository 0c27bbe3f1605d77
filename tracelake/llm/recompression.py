"""Substring dedup by recompression: word windows that an earlier document already holds go.

Method: the words of a text are renamed in rounds. The first names maximal runs of equal
words, and every round names adjacent pairs whose left name falls in one half of the names
and whose right name falls in the other. A name is a fingerprint of what it replaces, so
all tasks give the same pair the same name, and equal substrings get equal interior
symbols wherever they stand. A window drops from either end, round by round, the symbols
that its surroundings could have changed; what it drops and the core that is left depend on
its words alone and name it. Spark first matches the smallest pairs of neighbouring core
symbols (anchors) of all documents, then the full window names of those places only whose anchor is shared. A
second, independent fingerprint of the window's words verifies each match.

Documents with the same words throughout are settled by their first copy.

Results by case: a null or word-less text has no words and keeps an empty string; a text
shorter than the window loses nothing; rows that share a doc_id are one document for the
order but keep their own texts; a null doc_id loses nothing and covers nobody; further
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .blocks import K1, K2, K3, K4, Seen, Words, blocks, is_marked, marked, mix, range_hashes, signed, unsigned
from .graph import dealt, shuffle_partitions, texts_of

WINDOW = 13
#: Rounds at least; wider windows take more, until about two symbols of the core are left.
ROUNDS = 4
#: One division of the names into left and right ones for each round.
_SALTS = mix(np.arange(1, 65, dtype=np.uint64))


def _fold(name: np.ndarray, more: np.ndarray) -> np.ndarray:
    return mix(name * K1 + more * K2 + K3)


def rounds_for(width: int) -> int:
    return max(ROUNDS, round(math.log(width / 6.5) / math.log(4 / 3)))


class WindowNames:
    """For each window of ``width`` words of a block: ``at`` (first word), ``anchor`` and ``name``."""

    def __init__(self, doc: np.ndarray, name: np.ndarray, width: int):
        n, rounds = len(name), rounds_for(width)
        at = np.flatnonzero(doc[: n - width + 1] == doc[width - 1 :]) if n >= width else np.zeros(0, np.int64)
        symbol, owner = name, doc
        lo, hi = at.copy(), at + width
        left, right = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
        anchor = np.zeros(len(at), np.uint64)
        for step in range(rounds):
            if step == 0 and n:
                symbol, owner, lo, hi, left, right = self._runs(symbol, owner, lo, hi, left, right)
            if len(symbol):
                symbol, owner, lo, hi, left, right = self._pairs(symbol, owner, lo, hi, left, right, step)
            if step == rounds - 3 and len(symbol):
                anchor = self._smallest_pair(symbol, lo, hi)
        core = range_hashes(symbol, lo, np.maximum(lo, hi)) if len(symbol) else np.zeros(len(at), np.uint64)
        self.at, self.name = at, _fold(_fold(left, right), core)
        self.anchor = np.where(anchor == 0, self.name, anchor)

    @staticmethod
    def _smallest_pair(symbol, lo, hi):
        """The smallest name of two neighbouring symbols of each core; 0 where the core has fewer."""
        pair = np.zeros(len(symbol), np.uint64)
        pair[:-1] = _fold(symbol[:-1], symbol[1:]) | np.uint64(1)
        none = np.uint64(0xFFFFFFFFFFFFFFFF)
        best = np.full(len(lo), none)
        for k in range(int((hi - lo).max(initial=0)) - 1):
            at = lo + k
            best = np.minimum(best, np.where(at + 1 < hi, pair[np.minimum(at, len(pair) - 1)], none))
        return np.where(best == none, np.uint64(0), best)

    @staticmethod
    def _runs(symbol, owner, lo, hi, left, right):
        new = np.ones(len(symbol), bool)
        new[1:] = (symbol[1:] != symbol[:-1]) | (owner[1:] != owner[:-1])
        starts = np.flatnonzero(new)
        run = np.cumsum(new) - 1
        length = np.diff(np.append(starts, len(symbol)))
        # the window's first and last runs may go on outside it: they leave with their visible length
        to = np.minimum(starts[run[lo]] + length[run[lo]], hi)
        left = _fold(left, symbol[lo] + (to - lo).astype(np.uint64) * K4)
        back = np.maximum(starts[run[hi - 1]], to)
        rest = hi > back
        right = np.where(rest, _fold(right, symbol[hi - 1] + (hi - back).astype(np.uint64) * K4), right)
        some = back > to
        lo, hi = np.where(some, run[np.minimum(to, len(run) - 1)], 0), np.where(some, run[np.maximum(back - 1, 0)] + 1, 0)
        head = symbol[starts]
        named = np.where(length > 1, mix(head * K2 + length.astype(np.uint64) * K3), head)
        return named, owner[starts], lo, hi, left, right

    @staticmethod
    def _pairs(symbol, owner, lo, hi, left, right, step):
        side = (mix(symbol ^ _SALTS[step]) & np.uint64(1)).astype(bool)  # True: may be a left one
        # a first symbol of the right half or a last one of the left half may pair with one outside
        some = lo < hi
        first = some & ~side[np.minimum(lo, len(symbol) - 1)]
        left = np.where(first, _fold(left, symbol[np.minimum(lo, len(symbol) - 1)]), left)
        lo = lo + first
        some = lo < hi
        last = some & side[np.maximum(hi - 1, 0)]
        right = np.where(last, _fold(right, symbol[np.maximum(hi - 1, 0)]), right)
        hi = hi - last
        pair = np.zeros(len(symbol), bool)
        pair[:-1] = side[:-1] & ~side[1:] & (owner[:-1] == owner[1:])
        second = np.zeros(len(symbol), bool)
        second[1:] = pair[:-1]
        keep = ~second
        named = symbol.copy()
        where = np.flatnonzero(pair)
        named[where] = mix(symbol[where] * K1 + symbol[where + 1] * K3 + np.uint64(step + 1))
        place = np.concatenate([[0], np.cumsum(keep)])
        some = lo < hi
        return named[keep], owner[keep], np.where(some, place[lo], 0), np.where(some, place[hi], 0), left, right


def _anchor_rows(width: int):
    """(anchor, doc_id), once a document; of an anchor that a block has in several documents, only the smallest
    and the largest have to meet others, the rest are decided and marked."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen()
        for block in blocks((b.filter(pa.array(~b["copy"].to_numpy(zero_copy_only=False))) for b in batches), "text"):
            words = Words(block["text"])
            windows = WindowNames(words.doc, words.name, width)
            doc, anchor = block["doc_id"].to_numpy()[words.doc[windows.at]], marked(windows.anchor, np.zeros(1, bool))
            order = np.lexsort((doc, anchor))
            doc, anchor = doc[order], anchor[order]
            new = np.append(True, anchor[1:] != anchor[:-1])[: len(anchor)]
            once = new.copy()
            once[1:] |= doc[1:] != doc[:-1]
            doc, anchor, new = doc[once], anchor[once], new[once]
            if not len(doc):
                continue
            last = np.append(new[1:], True)
            decided = ~(new | last) | (seen.least(anchor) < np.iinfo(np.int64).max)
            several = new & ~last
            seen.add(anchor[several], doc[several])
            by_doc = np.argsort(doc, kind="stable")  # packs better
            yield pa.RecordBatch.from_arrays([signed(marked(anchor, decided)[by_doc]), pa.array(doc[by_doc])], names=["anchor", "doc_id"])

    return rows


def _shared(key_columns: list[str], out: list[str], later_only: bool):
    """Of rows sorted by the keys and doc_id: those of groups that more than one document has.

    Rows that are marked as decided pass. Works on a stream with one row held back, so a group
    may be of any size.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: tuple | None = None  # keys, first doc_id, whether the group's first rows are out
        held: list[pa.RecordBatch] = []
        for batch in batches:
            decided = is_marked(batch[key_columns[0]].to_numpy())
            if decided.any():
                yield batch.filter(pa.array(decided)).select(out)
                batch = batch.filter(pa.array(~decided))
            n = batch.num_rows
            if not n:
                continue
            keys = [batch.column(batch.schema.get_field_index(k)).to_numpy() for k in key_columns]
            doc = batch.column(batch.schema.get_field_index("doc_id")).to_numpy()
            new = np.zeros(n, bool)
            new[0] = before is None or any(k[0] != b for k, b in zip(keys, before[0], strict=True))
            for k in keys:
                new[1:] |= k[1:] != k[:-1]
            starts = np.flatnonzero(new)
            group = np.cumsum(new)  # 0: goes on from the batch before
            first = np.concatenate([[before[1] if before else 0], doc[starts]])[group]
            later = doc > first
            if later_only:
                keep = later
            else:
                shared = np.zeros(len(starts) + 1, bool)
                shared[group[later]] = True
                if before and before[2]:
                    shared[0] = True
                if shared[0]:
                    yield from held
                if not shared[0] and not (len(starts) == 0):
                    held = []
                elif shared[0]:
                    held = []
                keep = shared[group]
                open_from = starts[-1] if len(starts) else 0
                if not shared[-1]:  # the last group may turn out to be shared in the next batch
                    held.append(batch.slice(int(open_from)).select(out))
            if keep.any():
                yield batch.filter(pa.array(keep)).select(out)
            last_shared = bool(shared[-1]) if not later_only else False
            before = (tuple(k[-1] for k in keys), first[-1], last_shared)

    return rows


def _window_rows(width: int):
    """(name, verify, doc_id, pos) of windows with a shared anchor; where an earlier document of the task holds
    the window too, that is decided here and marked."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen()
        for block in blocks(
            (
                b.filter(
                    pa.array(~b["copy"].to_numpy(zero_copy_only=False) & b["anchors"].is_valid().to_numpy(zero_copy_only=False))
                ) for b in batches
            ),
            "text"
        ):
            words = Words(block["text"])
            windows = WindowNames(words.doc, words.name, width)
            column = block["anchors"]
            owner = np.repeat(np.arange(block.num_rows), np.diff(column.offsets.to_numpy()))
            wanted = np.unique(_fold(unsigned(column.flatten()), owner.astype(np.uint64)))
            row = words.doc[windows.at]
            mine = _fold(marked(windows.anchor, np.zeros(1, bool)), row.astype(np.uint64))
            at = np.searchsorted(wanted, mine)
            hit = (wanted[np.minimum(at, len(wanted) - 1)] == mine) if len(wanted) else np.zeros(len(mine), bool)
            where = windows.at[hit]
            if not len(where):
                continue
            check = range_hashes(mix(words.name * K3 + K1), where, where + width) >> np.uint64(32)
            name, doc = windows.name[hit], block["doc_id"].to_numpy()[row[hit]]
            both = _fold(name, check)
            order = np.argsort(both)
            starts = np.flatnonzero(np.append(True, both[order[1:]] != both[order[:-1]]))
            kinds, size = both[order[starts]], np.diff(np.append(starts, len(order)))
            least, before = np.minimum.reduceat(doc[order], starts), seen.least(kinds)
            decided = np.empty(len(doc), bool)
            decided[order] = doc[order] > np.repeat(np.minimum(least, before), size)
            several = (size > 1) | (before < np.iinfo(np.int64).max)
            seen.add(kinds[several], least[several])
            name, check = np.where(decided, np.uint64(1), marked(name, decided)), np.where(decided, 0, check).astype(np.uint32)
            yield pa.RecordBatch.from_arrays(
                [signed(name), pa.array(check.view(np.int32)), pa.array(doc), pa.array((where - words.bounds[row[hit]]).astype(np.int32))],
                names=["name", "verify", "doc_id", "pos"]
            )

    return rows


def covered(count: int, starts: np.ndarray, width: int) -> np.ndarray:
    """Which of ``count`` units lie in a window of ``width`` that begins at one of ``starts``."""
    edge = np.zeros(count + 1, np.int64)
    starts = np.unique(starts)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + width, count), -1)
    return np.cumsum(edge[:-1]) > 0


def _kept_words(block: pa.RecordBatch, words: Words, width: int) -> Iterator[np.ndarray]:
    """For each row of a block, the places of the words that stay."""
    copy = block["copy"].to_pylist()
    column = block["starts"].fill_null([])
    bounds, starts = column.offsets.to_numpy(), column.flatten().to_numpy()
    bounds = bounds - bounds[0]
    for r in range(words.rows):
        lo, hi = words.bounds[r], words.bounds[r + 1]
        if copy[r] and hi - lo >= width:
            yield lo + np.zeros(0, np.int64)
        elif bounds[r] < bounds[r + 1]:
            yield lo + np.flatnonzero(~covered(hi - lo, starts[bounds[r] : bounds[r + 1]], width))
        else:
            yield np.arange(lo, hi)


def _digest_rows(width: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            words = Words(block["text"])
            data, start, end = words.data.tobytes(), words.start.tolist(), words.end.tolist()
            left, digests = [], []
            for kept in _kept_words(block, words, width):
                left.append(len(kept))
                digests.append(hashlib.sha256(b" ".join([data[start[k] : end[k]] for k in kept.tolist()])).hexdigest())
            count = np.diff(words.bounds)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": block["doc_id"], "n_words": pa.array(count), "n_removed": pa.array(
                        count - np.array(left, np.int64)
                    ), "kept_sha256": pa.array(digests, pa.string())
                }
            )

    return rows


def _text_rows(width: int):
    """``row`` and ``text`` of each row, the text cut where it loses words."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            words = Words(block["text"])
            data, changed, cut = words.data.tobytes(), np.zeros(words.rows, bool), [None] * words.rows
            for r, kept in enumerate(_kept_words(block, words, width)):
                changed[r] = len(kept) < words.bounds[r + 1] - words.bounds[r]
                if changed[r]:
                    # words that stay together keep what stood between them
                    breaks = np.flatnonzero(np.diff(kept) > 1)
                    firsts, lasts = kept[np.append(0, breaks + 1)] if len(kept) else kept, kept[
                        np.append(breaks, len(kept) - 1)
                    ] if len(kept) else kept
                    cut[r] = "\n".join(
                        data[a:b].decode() for a, b in zip(words.start[firsts].tolist(), words.end[lasts].tolist(), strict=True)
                    )
            yield pa.RecordBatch.from_pydict(
                {"row": block["row"], "text": pc.if_else(pa.array(changed), pa.array(cut, pa.string()), block["text"])}
            )

    return rows


def removals(docs: DataFrame, width: int = WINDOW, *more: Column) -> DataFrame:
    """(doc_id, text, starts, copy) of ``docs``, and ``more``: where windows of an earlier document begin.

    ``copy`` is true where an earlier document has the same text, which settles all its windows.
    """
    parts = shuffle_partitions(docs.sparkSession)
    docs = texts_of(docs, *more)
    known = docs.where("doc_id is not null")
    prints = known.where("text is not null").select(
        "doc_id",
        F.xxhash64("text").alias("x"),
        F.crc32(F.col("text").cast("binary")).alias("c"),
        F.octet_length("text").alias("l")
    )
    first = prints.groupBy("x", "c", "l").agg(
        F.min("doc_id").alias("first"),
        F.max("doc_id").alias("last")
    ).where("first < last").select("x", "c", "l", "first")
    copies = prints.join(first, ["x", "c", "l"]).where("doc_id > first").groupBy("doc_id").agg(F.collect_set("x").alias("prints"))
    # the texts are dealt out by doc_id once: all uses of ``told`` read the same exchange
    told = known.repartition(parts, "doc_id").join(copies, "doc_id", "left").withColumn(
        "copy",
        F.coalesce(F.array_contains("prints", F.xxhash64("text")), F.lit(False))
    ).drop("prints")
    anchors = dealt(
        told.mapInArrow(_anchor_rows(width), "anchor long, doc_id long"),
        "anchor",
        "anchor"
    ).sortWithinPartitions("anchor", "doc_id")
    shared = anchors.mapInArrow(_shared(["anchor"], ["anchor", "doc_id"], False), "anchor long, doc_id long")
    wanted = shared.groupBy("doc_id").agg(F.collect_set(F.col("anchor").bitwiseAND(F.lit(-2))).alias("anchors"))
    windows = told.join(wanted, "doc_id", "left").mapInArrow(_window_rows(width), "name long, verify int, doc_id long, pos int")
    windows = dealt(windows, "name", "name").sortWithinPartitions("name", "verify", "doc_id")
    hits = windows.mapInArrow(
        _shared(["name", "verify"], ["doc_id", "pos"], True),
        "doc_id long, pos int"
    ).groupBy("doc_id").agg(F.collect_set("pos").alias("starts"))
    told = told.join(hits, "doc_id", "left")
    without_id = docs.where("doc_id is null").withColumns({"starts": F.lit(None).cast("array<int>"), "copy": F.lit(False)})
    return told.unionByName(without_id)


def substring_dedup(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for each document.

    Words in a window of ``width`` words that also starts in a document with a smaller
    doc_id are removed; windows are judged on the input. ``kept_sha256`` is of the kept
    words joined by one space.
    """
    return removals(docs, width).mapInArrow(_digest_rows(width), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def without_repeats(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """``docs`` with repeated windows cut from the texts; a text that loses nothing stays as it is.

    All columns and rows are kept; what is left of a text is joined by line feeds.
    """
    told = removals(docs, width, F.struct(*[c for c in docs.columns if c != "text"]).alias("row"))
    cut = told.mapInArrow(
        _text_rows(width),
        StructType([StructField("row", told.schema["row"].dataType), StructField("text", StringType())])
    )
    return cut.select(*["text" if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])
