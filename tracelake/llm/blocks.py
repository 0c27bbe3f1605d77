"""Blocks of texts as numpy arrays: the per-task helpers that the text operators share.

A block is a run of rows whose texts hold at most ``BLOCK_BYTES`` (one longer text is a
block of its own), so memory per task is bounded by the block and not by the partition.
Words are maximal runs of bytes other than 0x20 and 0x09-0x0D; a null text has none.
Names of words, shingles and symbols are 64-bit mixed polynomial fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
K1, K2, K3, K4 = (np.uint64(k) for k in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: each input bit reaches every output bit."""
    x = np.asarray(x, np.uint64).copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * K1)
_BYTE_VALUE_LOWER = _BYTE_VALUE.copy()
_BYTE_VALUE_LOWER[65:91] = _BYTE_VALUE[97:123]

_powers: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, or of the inverse base; kept between blocks."""
    key = "inverse" if inverse else "base"
    have = _powers.get(key)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        base = _INVERSE if inverse else _BASE
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 2 * BLOCK_BYTES:
            _powers[key] = have
    return have[:n]


def range_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A fingerprint of each ``values[start:end]``, the same wherever the range lies."""
    n = len(values)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(values * powers(n), out=total[1:])
    inverse = powers(n + 1, inverse=True)
    return mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64) * K4)


def word_hashes(value: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The fingerprint of each ``value[data[start:end]]``, a block of bytes at a time; ranges don't overlap and are in order."""
    out = np.empty(len(start), np.uint64)
    lo = 0
    while lo < len(start):
        hi = max(lo + 1, int(np.searchsorted(end, start[lo] + BLOCK_BYTES, "right")))
        first = start[lo]
        out[lo:hi] = range_hashes(value[data[first : end[hi - 1]]], start[lo:hi] - first, end[lo:hi] - first)
        lo = hi
    return out


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array and its n + 1 offsets; nulls count as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    where = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None or len(where) < 2:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[where[0] : where[-1]], where - where[0]


def blocks(batches: Iterable[pa.RecordBatch], column: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches that hold at most ``limit`` bytes of ``column``, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, where = text_buffers(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(where, where[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


class Words:
    """The words of a block: ``doc`` (row in the block), ``start`` and ``end`` (bytes), ``name``."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        self.data, self.offsets = text_buffers(texts)
        data, offsets = self.data, self.offsets
        self.rows = len(offsets) - 1
        inside = ~_SPACE[data]
        first, last = inside.copy(), inside.copy()
        if len(data):
            first[1:] &= ~inside[:-1]
            last[:-1] &= ~inside[1:]
            filled = offsets[:-1] < offsets[1:]
            heads, tails = offsets[:-1][filled], offsets[1:][filled] - 1
            first[heads] = inside[heads]
            last[tails] = inside[tails]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.doc = np.searchsorted(offsets, self.start, "right") - 1
        self.name = word_hashes(_BYTE_VALUE_LOWER if lower else _BYTE_VALUE, data, self.start, self.end)
        #: words of row r are bounds[r] .. bounds[r + 1]
        self.bounds = np.searchsorted(self.doc, np.arange(self.rows + 1))

    def __len__(self) -> int:
        return len(self.start)


def sorted_runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """From batches sorted by ``keys``: tables that hold whole groups, with the starts of the groups.

    Only for groups of bounded size: the last, perhaps unfinished group waits for the next batch.
    """
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        starts = group_starts(held, keys)
        if len(starts) > 1:
            yield held.slice(0, int(starts[-1])).combine_chunks(), starts[:-1]
            held = held.slice(int(starts[-1])).combine_chunks()
    if held is not None and held.num_rows:
        yield held.combine_chunks(), group_starts(held, keys)


def group_starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for key in keys:
        values = table.column(key).to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(new)


#: Names that a task remembers to have sent; more would only save more rows.
SEEN = 1 << 16


class Seen:
    """Names that this task has already sent on, each with the smallest document sent for it.

    Rows that repeat them need not meet at the name's task any more. Of fixed size: forgetting
    a name costs rows, never results.
    """

    def __init__(self):
        self.names, self.docs = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def least(self, names: np.ndarray) -> np.ndarray:
        """The smallest document sent for each name; the largest int64 where there is none."""
        out = np.full(len(names), np.iinfo(np.int64).max)
        if len(self.names):
            at = np.minimum(np.searchsorted(self.names, names), len(self.names) - 1)
            out = np.where(self.names[at] == names, self.docs[at], out)
        return out

    def add(self, names: np.ndarray, docs: np.ndarray) -> None:
        if not len(names):
            return
        if len(self.names) + len(names) > SEEN:
            self.names, self.docs, names, docs = self.names[:0], self.docs[:0], names[:SEEN], docs[:SEEN]
        names, docs = np.concatenate([self.names, names]), np.concatenate([self.docs, docs])
        order = np.lexsort((docs, names))
        names, docs = names[order], docs[order]
        once = np.append(True, names[1:] != names[:-1])
        self.names, self.docs = names[once], docs[once]


_ONE = np.uint64(1)


def marked(names: np.ndarray, decided: np.ndarray) -> np.ndarray:
    """Names whose lowest bit says that the row is decided and need not meet others."""
    return names & ~_ONE | decided.astype(np.uint64)


def is_marked(names: np.ndarray) -> np.ndarray:
    return (names & _ONE if names.dtype == np.uint64 else names & 1) == 1


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.asarray(x, np.uint64).view(np.int64))


def unsigned(column) -> np.ndarray:
    return np.asarray(
        column.to_numpy() if isinstance(column, pa.ChunkedArray) else column.to_numpy(zero_copy_only=False),
        np.int64
    ).view(np.uint64)


def lists(values: pa.Array, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), values)
