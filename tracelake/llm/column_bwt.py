"""Exact substring dedup over bytes, by a suffix array of many strings built column by column.

Method: in round j every string inserts its suffix of length j, the one that the byte before
its last suffix begins. Where it goes follows from the Burrows-Wheeler transform so far: all
suffixes that begin with smaller bytes come before it, and those that begin with the same
byte are in the order of what follows them. The common prefixes of its new neighbours follow
from the smallest common prefix between the places that they come from. Each round reads the
columns (transform, common prefix, string, place) from sequential files and writes them anew.

So that many tasks can build at once, windows are dealt out by content: a window's anchor is
its ``ANCHOR``-byte substring with the smallest hash, equal windows have equal anchors, and
neighbouring windows with one anchor form a stretch, which is one string. Only stretches
whose anchor occurs in two different places of the corpus are built; stretches that are
equal throughout are one string, settled in the task that reads them where it can be. Groups of equal windows are then the runs of suffixes
whose common prefix is at least the window, and all but the earliest are removed. An
anchor of very many stretches is dealt out further, window by window, by content.

Results by case: a null text counts as empty; a text shorter than the window loses nothing;
texts equal to that of an earlier document lose everything if they hold a window; rows that
share a doc_id are one document, taken to have one text; a null doc_id loses nothing and
covers nobody; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import contextlib
import hashlib
import tempfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import K1, K2, K3, Seen, blocks, is_marked, marked, mix, range_hashes, signed, sorted_runs, text_buffers, unsigned
from .graph import checkpointed, dealt, shuffle_partitions, texts_of

WINDOW = 100
ANCHOR = 32
#: Bytes of strings that are built at a time.
BUILD_BYTES = 1 << 20
#: An anchor of more stretches than this is dealt out by window, to one part more for each HOT_ROWS of them.
HOT, HOT_ROWS = 20_000, 500
#: Rows up to which the table of such anchors may be broadcast.
FEW = 100_000

_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * K3 + K1)


class Files:
    """Columns in sequential files of a scratch folder, read and rewritten from their start; a column only grows."""

    def __init__(self, folder: str, kinds: dict):
        self.kinds = kinds
        self.open = {name: (Path(folder) / name).open("w+b", buffering=0) for name in kinds}

    def read(self, name: str) -> np.ndarray:
        self.open[name].seek(0)
        return np.fromfile(self.open[name], self.kinds[name])

    def write(self, name: str, column: np.ndarray) -> None:
        self.open[name].seek(0)
        left = memoryview(np.ascontiguousarray(column, self.kinds[name])).cast("B")
        while len(left):
            left = left[self.open[name].write(left) :]

    def close(self) -> None:
        for file in self.open.values():
            file.close()


def build(
    data: np.ndarray, bounds: np.ndarray, first: np.ndarray | None = None, common: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, place, lcp) of all suffixes of the strings in order; lcp is with the suffix before.

    ``place`` is where the suffix starts in its string. The empty suffixes come first, in the
    order of the strings. Where every string goes on in a part that isn't built, ``first``
    gives the strings in the order of those parts and ``common`` the common prefixes of
    neighbours there; suffixes are then in the order of their bytes and that of the parts.
    """
    narrow = not len(data) or int(data.max()) < 255
    kinds = {"bwt": np.uint8 if narrow else np.uint16, "lcp": np.int16, "suffix": np.int64}
    with tempfile.TemporaryDirectory() as folder, contextlib.closing(Files(folder, kinds)) as files:
        count = len(bounds) - 1
        length = np.diff(bounds)
        first = np.arange(count) if first is None else first
        at = np.empty(count, np.int64)  # where the newest suffix of each string stands
        at[first] = np.arange(count)
        files.write("bwt", np.zeros(count))
        files.write("lcp", np.zeros(count) if common is None else common)
        files.write("suffix", (first << 32) | length[first])
        for j in range(1, int(length.max(initial=0)) + 1):
            active = np.flatnonzero(length >= j)
            bwt = files.read("bwt")
            bwt[at[active]] = data[bounds[active + 1] - j].astype(bwt.dtype) + 1
            order = np.argsort(bwt, kind="stable")
            rank = np.empty(len(order), np.int32)
            rank[order] = np.arange(len(order), dtype=np.int32)
            ended = int((bwt == 0).sum())
            source = at[active]
            goes = count + rank[source] - ended
            turn = np.argsort(goes)
            active, source, goes = active[turn], source[turn], goes[turn]
            own_rank = rank[source]
            n = len(bwt) + len(active)
            lcp = files.read("lcp")
            before = order[np.maximum(own_rank - 1, 0)]
            joins = (own_rank > 0) & (bwt[before] == bwt[source])
            ahead = order[np.minimum(own_rank + 1, len(order) - 1)]
            leads = (own_rank + 1 < len(order)) & (bwt[ahead] == bwt[source])
            own = np.zeros(len(active), lcp.dtype)
            own[joins] = 1 + _range_min(lcp, before[joins] + 1, source[joins] + 1)
            after = np.zeros(len(active), lcp.dtype)
            after[leads] = 1 + _range_min(lcp, source[leads] + 1, ahead[leads] + 1)
            old = np.ones(n, bool)
            old[goes] = False
            grown = np.zeros(n + 1, lcp.dtype)
            grown[:n][old] = lcp
            grown[goes + 1] = after
            grown[goes] = own  # a new suffix right after a new one: both say the same
            files.write("lcp", grown[:n])
            for name, value in (("bwt", 0), ("suffix", (active << 32) | (length[active] - j))):
                column = np.empty(n, kinds[name])
                column[old] = bwt if name == "bwt" else files.read(name)
                column[goes] = value
                files.write(name, column)
            at[active] = goes
        suffix = files.read("suffix")
        return suffix >> 32, suffix & 0xFFFFFFFF, files.read("lcp")


def sorted_parts(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp with the one before) of the parts ``data[start:end]``, none longer than the widest."""
    length = end - start
    width = -(-int(length.max(initial=1)) // 8) * 8
    grid = np.arange(width)[None] < length[:, None]
    table = np.zeros((len(start), width), np.uint8)
    table[grid] = data[
        np.repeat(start - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())
    ] if len(start) else 0
    keys = np.ascontiguousarray(table).view(">u8")
    order = np.lexsort((length, *[keys[:, k] for k in range(keys.shape[1] - 1, -1, -1)]))
    lcp = np.zeros(len(start), np.int64)
    if len(start) > 1:
        differs = table[order[1:]] != table[order[:-1]]
        same = np.where(differs.any(axis=1), differs.argmax(axis=1), width)
        lcp[1:] = np.minimum(same, np.minimum(length[order[1:]], length[order[:-1]]))
    return order, lcp


def _range_min(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The minimum of each ``values[lo:hi]``; no range is empty."""
    if not len(lo):
        return np.zeros(0, values.dtype)
    turn = np.argsort(lo, kind="stable")  # the stretches between the ranges then stay short
    ends = np.empty(2 * len(lo), np.int64)
    ends[0::2], ends[1::2] = lo[turn], hi[turn]
    out = np.empty(len(lo), values.dtype)
    out[turn] = np.minimum.reduceat(np.append(values, np.iinfo(values.dtype).max), ends)[::2]
    return out


def stretches(
    data: np.ndarray, offsets: np.ndarray, window: int, anchor: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, last, anchor start, anchor hash): neighbouring windows of a row with one anchor; first and last window start."""
    n = len(data)
    if n < window:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.view(np.uint64)
    # hashes of all substrings of ``anchor`` bytes, by doubling
    total, covered = None, 0
    power, width = _VALUE[data], 1
    multiplier = K1
    while width <= anchor:
        if anchor & width:
            if total is None:
                total, covered = power, width
            else:
                m = n - covered - width + 1
                total, covered = total[:m] * K2 + power[covered : covered + m], covered + width
        if width * 2 <= anchor:
            power = power[: len(power) - width] * multiplier + power[width:]
            multiplier = np.uint64((int(multiplier) * int(multiplier) + 2) & 0xFFFFFFFFFFFFFFFF) | np.uint64(1)
        width *= 2
    name = mix(total)
    small = (name >> np.uint64(32)).astype(np.uint32)
    where = np.arange(len(small), dtype=np.int32)
    span, need = 1, window - anchor + 1
    while span < need:
        step = min(span, need - span)
        less = small[step:] < small[: len(small) - step]
        where = np.where(less, where[step:], where[: len(where) - step])
        small = np.minimum(small[step:], small[: len(small) - step])
        span += step
    size = np.diff(offsets)
    filled = np.flatnonzero(size >= window)
    valid = np.zeros(n + 1, np.int8)
    np.add.at(valid, offsets[filled], 1)
    np.add.at(valid, offsets[filled] + size[filled] - window + 1, -1)
    starts = np.flatnonzero(np.cumsum(valid[:-1]) > 0)
    chosen = where[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (starts[1:] != starts[:-1] + 1)
    firsts = np.flatnonzero(new)
    first = starts[firsts]
    last = starts[np.append(firsts[1:], len(starts)) - 1] if len(firsts) else first
    row = np.searchsorted(offsets, first, "right") - 1
    return row, first, last, chosen[firsts].astype(np.int64), name[chosen[firsts]]


def _anchor_rows(window: int, anchor: int):
    """(anchor, place, doc_id); equal texts have their stretches in the same places, which only the first of a
    block needs, as the others are settled as copies. Of an anchor that a block has in several places, only
    the smallest and the largest have to meet others, the rest are decided and marked."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen()
        for block in blocks(batches, "text"):
            data, offsets = text_buffers(block["text"])
            row, first, _, _, name = stretches(data, offsets, window, anchor)
            if not len(row):
                continue
            doc, name = block["doc_id"].to_numpy()[row], marked(name, np.zeros(1, bool))
            place = mix(unsigned(block["x"])[row] * K1 + (first - offsets[row]).astype(np.uint64) * K3)
            order = np.lexsort((doc, place, name))
            once = np.append(True, (name[order[1:]] != name[order[:-1]]) | (place[order[1:]] != place[order[:-1]]))
            name, place, doc = name[order[once]], place[order[once]], doc[order[once]]
            new = np.append(True, name[1:] != name[:-1])
            last = np.append(new[1:], True)
            decided = ~(new | last) | (seen.least(name) < np.iinfo(np.int64).max)
            several = new & ~last
            seen.add(name[several], doc[several])
            by_doc = np.argsort(doc, kind="stable")  # packs better
            yield pa.RecordBatch.from_arrays(
                [signed(marked(name, decided)[by_doc]), signed(place[by_doc]), pa.array(doc[by_doc])],
                names=["anchor", "place", "doc_id"]
            )

    return rows


def _elsewhere(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by anchor and place: those decided before, and those whose anchor has two places. One group's first rows may wait."""
    key = first = None
    shared = False
    held: list[pa.RecordBatch] = []
    for batch in batches:
        decided = is_marked(batch["anchor"].to_numpy())
        if decided.any():
            yield batch.filter(pa.array(decided)).select(["anchor", "doc_id"])
            batch = batch.filter(pa.array(~decided))
        if not batch.num_rows:
            continue
        anchor, place = batch["anchor"].to_numpy(), batch["place"].to_numpy()
        new = np.ones(len(anchor), bool)
        new[1:] = anchor[1:] != anchor[:-1]
        new[0] = anchor[0] != key
        starts = np.flatnonzero(new)
        group = np.cumsum(new)
        firsts = np.concatenate([[first if first is not None else 0], place[starts]])
        is_shared = np.zeros(len(starts) + 1, bool)
        is_shared[0] = shared
        is_shared[group[place != firsts[group]]] = True
        if is_shared[0]:
            yield from held
            held = []
        elif len(starts):
            held = []
        keep = is_shared[group]
        if keep.any():
            yield batch.filter(pa.array(keep)).select(["anchor", "doc_id"])
        if not is_shared[-1]:
            tail = batch.slice(int(starts[-1]) if len(starts) else 0).select(["anchor", "doc_id"])
            held.append(tail)
        key, first, shared = anchor[-1], firsts[-1], bool(is_shared[-1])


STRINGS = "anchor long, part int, print long, verify int, doc_id long, start long, inner int, bytes binary"


def _stretch_rows(window: int, anchor: int):
    """The stretches whose anchor is shared, as strings; those of a hot anchor window by window.

    A string that stands earlier in the same block is decided: it comes marked, without bytes,
    with the number of its further windows as ``inner``.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(
            (
                b.filter(
                    pa.array(~b["copy"].to_numpy(zero_copy_only=False) & b["anchors"].is_valid().to_numpy(zero_copy_only=False))
                ) for b in batches
            ),
            "text"
        ):
            data, offsets = text_buffers(block["text"])
            row, first, last, inner, name = stretches(data, offsets, window, anchor)
            column = block["anchors"]
            owner = np.repeat(np.arange(block.num_rows), np.diff(column.offsets.to_numpy())).astype(np.uint64)
            told = column.flatten()
            wanted, at = np.unique(mix(unsigned(told.field("anchor")) + owner * K3), return_index=True)
            parts = told.field("parts").to_numpy()[at]
            if not len(wanted) or not len(row):
                continue
            name = marked(name, np.zeros(1, bool))
            mine = mix(name + row.astype(np.uint64) * K3)
            at = np.minimum(np.searchsorted(wanted, mine), len(wanted) - 1)
            hit = wanted[at] == mine
            row, first, last, inner, name, parts = row[hit], first[hit], last[hit], inner[hit], name[hit], parts[at[hit]]
            value, other = _VALUE[data], mix(_VALUE + K2)[data]
            doc, start = block["doc_id"].to_numpy()[row], first - offsets[row]

            def named(first, last, doc, start):
                """(print, verify, whether it stands earlier in the block) of each string."""
                print_, check = (range_hashes(v, first, last + window) for v in (value, other))
                order = np.lexsort((start, doc, print_))
                new = np.append(True, print_[order[1:]] != print_[order[:-1]])[: len(order)]
                head = order[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(order) else order
                early = np.zeros(len(order), bool)
                early[order] = (check[order] == check[head]) & ((doc[order] != doc[head]) | (start[order] != start[head]))
                return print_, check >> np.uint64(32), early

            print_, check, early = named(first, last, doc, start)
            split = ~early & (parts > 0)
            part = np.zeros(len(name), np.int64)
            if split.any():
                count = (last - first + 1)[split]
                ends = np.cumsum(count)
                each = np.arange(ends[-1]) - np.repeat(ends - count, count)
                own, rest = np.repeat(np.flatnonzero(split), count), np.flatnonzero(~split)
                at, own_doc, own_start = first[own] + each, doc[own], start[own] + each
                own_print, own_check, own_early = named(at, at, own_doc, own_start)
                own_part = (own_print % parts[own].astype(np.uint64)).astype(np.int64) + 1
                inner = np.concatenate([inner[rest], inner[own]])
                name, part = np.concatenate([name[rest], name[own]]), np.concatenate([part[rest], own_part])
                first, last, doc, start = np.concatenate([first[rest], at]), np.concatenate([last[rest], at]), np.concatenate([doc[rest], own_doc]), np.concatenate([start[rest], own_start])
                print_, check, early = np.concatenate([print_[rest], own_print]), np.concatenate([check[rest], own_check]), np.concatenate([early[rest], own_early])
            length = np.where(early, 0, last - first + window)
            bounds = np.concatenate([[0], np.cumsum(length)])
            text = data[np.arange(bounds[-1]) + np.repeat(first - bounds[:-1], length)]
            binary = pa.LargeBinaryArray.from_buffers(
                pa.large_binary(),
                len(first),
                [None, pa.py_buffer(bounds.astype(np.int64).tobytes()), pa.py_buffer(text.tobytes())]
            ).cast(pa.binary())
            yield pa.RecordBatch.from_arrays(
                [signed(np.where(early, np.uint64(0), name)), pa.array(np.where(early, 0, part).astype(np.int32)), signed(np.where(early, np.uint64(1), marked(print_, early))), pa.array(check.astype(np.uint32).view(np.int32)), pa.array(doc), pa.array(start), pa.array(np.where(early, last, inner).astype(np.int64) - first, pa.int32()), binary],
                names=["anchor", "part", "print", "verify", "doc_id", "start", "inner", "bytes"],
            )

    return rows


def _firsts(batches: Iterator[pa.RecordBatch], window: int, spans: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted strings, the first of equal ones; all windows of the others have begun earlier: one span each, put in ``spans``."""
    before = None
    for batch in batches:
        if not batch.num_rows:
            continue
        decided = is_marked(batch["print"].to_numpy())
        doc, start = batch["doc_id"].to_numpy(), batch["start"].to_numpy()
        if decided.any():
            spans.append(
                pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (doc[decided], start[decided], (start + batch["inner"].to_numpy())[decided])],
                    names=["doc_id", "first", "last"]
                )
            )
            batch = batch.filter(pa.array(~decided))
            doc, start = batch["doc_id"].to_numpy(), batch["start"].to_numpy()
        if not batch.num_rows:
            continue
        keys = [batch[c].to_numpy() for c in ("anchor", "part", "print", "verify")]
        new = np.zeros(len(doc), bool)
        new[0] = before is None or any(k[0] != x for k, x in zip(keys, before, strict=True))
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
        heads = np.flatnonzero(new)
        group = np.cumsum(new)
        place = (doc, start)
        at = [
            np.concatenate([[0 if before is None else x], p[heads]])[group] for p, x in zip(
                place,
                (0, 0) if before is None else first,
                strict=True
            )
        ]
        # rows that repeat under one doc_id are the same place
        copy = (doc != at[0]) | (start != at[1])
        before, first = tuple(k[-1] for k in keys), (at[0][-1], at[1][-1])
        if copy.any():
            bounds = batch["bytes"].cast(pa.large_binary())
            length = np.diff(np.frombuffer(bounds.buffers()[1], np.int64)[bounds.offset : bounds.offset + len(bounds) + 1])
            spans.append(
                pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (doc[copy], start[copy], (start + length - window)[copy])],
                    names=["doc_id", "first", "last"]
                )
            )
        if heads.size:
            yield batch.take(pa.array(heads))


def _spans(doc: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
    """(doc_id, first, last) of neighbouring window starts."""
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + 1)
    firsts = np.flatnonzero(new)
    lasts = np.append(firsts[1:], len(doc)) - 1
    return pa.RecordBatch.from_arrays(
        [pa.array(doc[firsts]), pa.array(start[firsts]), pa.array(start[lasts])],
        names=["doc_id", "first", "last"]
    )


def repeated_windows(
    doc: np.ndarray, start: np.ndarray, data: np.ndarray, bounds: np.ndarray, inner: np.ndarray, window: int
) -> tuple[np.ndarray, np.ndarray]:
    """(doc, window start) of windows of the strings that an earlier place also holds, by their suffix array.

    Every window begins at or before the anchor of its string, ``inner`` bytes in, and equal
    windows have it in the same place. So only the bytes before the anchors are inserted
    column by column, above the order of what follows from there on.
    """
    head = bounds[:-1] + inner
    order, common = sorted_parts(data, head, bounds[1:])
    length = inner.astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(length)])
    left = data[np.arange(ends[-1]) + np.repeat(bounds[:-1] - ends[:-1], length)]
    string, place, lcp = build(left, ends, order, common)
    whole = np.diff(bounds)[string] - place >= window
    group = np.cumsum(lcp < window)
    string, place, group = string[whole], place[whole], group[whole]
    at = start[string] + place
    order = np.lexsort((at, doc[string], group))
    own_doc, own_at, group = doc[string][order], at[order], group[order]
    new = np.ones(len(group), bool)
    new[1:] = group[1:] != group[:-1]
    head = np.flatnonzero(new)[np.cumsum(new) - 1] if len(group) else np.zeros(0, np.int64)
    later = (own_doc > own_doc[head]) | (own_at > own_at[head])
    return own_doc[later], own_at[later]


def _repeat_rows(window: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans: list[pa.RecordBatch] = []
        for table, starts in sorted_runs(_firsts(batches, window, spans), ["anchor", "part"]):
            yield from spans
            spans.clear()
            doc, start, inner = table["doc_id"].to_numpy(), table["start"].to_numpy(), table["inner"].to_numpy()
            text = table["bytes"].combine_chunks().cast(pa.large_binary())
            _, where, raw = text.buffers()
            bounds = np.frombuffer(where, np.int64)[text.offset : text.offset + len(text) + 1]
            data = np.frombuffer(raw, np.uint8)[bounds[0] : bounds[-1]]
            bounds = bounds - bounds[0]
            size = np.diff(np.append(starts, table.num_rows))
            group = np.repeat(np.arange(len(starts)), size)
            single = np.flatnonzero(size[group] > 1)
            sizes = np.cumsum(bounds[single + 1] - bounds[single])
            docs, places = [], []
            lo = 0
            while lo < len(single):
                hi = int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + BUILD_BYTES, "right"))
                hi = max(hi, lo + 1)
                while hi < len(single) and group[single[hi]] == group[single[hi - 1]]:
                    hi += 1
                own = single[lo:hi]
                length = bounds[own + 1] - bounds[own]
                ends = np.concatenate([[0], np.cumsum(length)])
                piece = data[np.arange(ends[-1]) + np.repeat(bounds[own] - ends[:-1], length)]
                found = repeated_windows(doc[own], start[own], piece, ends, inner[own], window)
                docs.append(found[0])
                places.append(found[1])
                lo = hi
            if sum(map(len, docs)):
                yield _spans(np.concatenate(docs), np.concatenate(places).astype(np.int64))
        yield from spans

    return rows


def _kept_rows(window: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            data, offsets = text_buffers(block["text"])
            raw = data.tobytes()
            copy, spans = block["copy"].to_pylist(), block["spans"]
            size = np.diff(offsets)
            removed, runs, digests = [], [], []
            for r in range(block.num_rows):
                text = raw[offsets[r] : offsets[r + 1]]
                if copy[r] and size[r] >= window:
                    removed.append(int(size[r]))
                    runs.append(1)
                    digests.append(hashlib.sha256(b"").hexdigest())
                    continue
                own = spans[r].values if spans[r].is_valid else None
                if own is None or not len(own):
                    removed.append(0)
                    runs.append(0)
                    digests.append(hashlib.sha256(text).hexdigest())
                    continue
                edge = np.zeros(size[r] + 1, np.int64)
                np.add.at(edge, own.field(0).to_numpy(), 1)
                np.add.at(edge, np.minimum(own.field(1).to_numpy() + window, size[r]), -1)
                gone = np.cumsum(edge[:-1]) > 0
                removed.append(int(gone.sum()))
                runs.append(int((gone & ~np.append(False, gone[:-1])).sum()))
                digests.append(hashlib.sha256(np.frombuffer(text, np.uint8)[~gone].tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [
                    block["doc_id"],
                    pa.array(size),
                    pa.array(removed, pa.int64()),
                    pa.array(runs, pa.int64()),
                    pa.array(digests, pa.string())
                ],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            )

    return rows


def suffix_dedup(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each document.

    Bytes covered by a ``window``-byte string that also starts earlier (in a document with a
    smaller doc_id, or before in the same one) are removed; strings are judged on the input.
    """
    parts = shuffle_partitions(docs.sparkSession)
    docs = texts_of(docs)
    known = docs.where("doc_id is not null")
    prints = known.where(F.octet_length("text") >= window).select(
        "doc_id",
        F.xxhash64("text").alias("x"),
        F.octet_length("text").alias("l"),
        F.crc32(F.col("text").cast("binary")).alias("c")
    )
    first = prints.groupBy("x", "l", "c").agg(
        F.min("doc_id").alias("first"),
        F.max("doc_id").alias("last")
    ).where("first < last").select("x", "l", "c", "first")
    copies = prints.join(first, ["x", "l", "c"]).where("doc_id > first").select("doc_id").distinct().withColumn("copy", F.lit(True))
    # the texts are dealt out by doc_id once: both uses of ``told`` read the same exchange
    told = known.repartition(parts, "doc_id").join(copies, "doc_id", "left").withColumn("copy", F.coalesce("copy", F.lit(False)))
    printed = known.where(F.octet_length("text") >= window).withColumn("x", F.xxhash64("text"))
    anchors = dealt(
        printed.mapInArrow(_anchor_rows(window, anchor), "anchor long, place long, doc_id long"),
        "anchor",
        "anchor"
    ).sortWithinPartitions("anchor", "place")
    shared = checkpointed(
        anchors.mapInArrow(_elsewhere, "anchor long, doc_id long").withColumn("anchor", F.col("anchor").bitwiseAND(F.lit(-2)))
    )
    hot = shared.groupBy("anchor").count().where(F.col("count") > HOT).select(
        "anchor",
        F.ceil(F.col("count") / HOT_ROWS).cast("int").alias("parts")
    )
    few = hot.limit(FEW + 1).count()
    split = shared.withColumn("parts", F.lit(0)) if not few else shared.join(
        F.broadcast(hot) if few <= FEW else hot,
        "anchor",
        "left"
    ).withColumn("parts", F.coalesce("parts", F.lit(0)))
    wanted = split.groupBy("doc_id").agg(F.collect_set(F.struct("anchor", "parts")).alias("anchors"))
    strings = told.join(wanted, "doc_id", "left").mapInArrow(_stretch_rows(window, anchor), STRINGS)
    strings = dealt(strings, "print", "anchor", "part").sortWithinPartitions("anchor", "part", "print", "verify", "doc_id", "start")
    spans = strings.mapInArrow(
        _repeat_rows(window),
        "doc_id long, first long, last long"
    ).groupBy("doc_id").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    told = told.join(spans, "doc_id", "left").select("doc_id", "text", "spans", "copy")
    without_id = docs.where("doc_id is null").select(
        "doc_id",
        "text",
        F.lit(None).cast("array<struct<first:bigint,last:bigint>>").alias("spans"),
        F.lit(False).alias("copy")
    )
    return told.unionByName(without_id).mapInArrow(
        _kept_rows(window),
        "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )
