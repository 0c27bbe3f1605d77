"""Texts as arrays of words: what a task does with the words of a block of texts at once.

A word is a run of letters and digits with the marks within and after it, as in ``tokens``. Which characters
these are, and their lower case, is asked of Spark, whose rules of Unicode need not be Python's.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from . import text as T

#: Kinds of characters: what words are made of, marks within or after them, and white space that may end a sentence.
LETTER, MARK, WHITE = 1, 2, 3
#: Sizes of a step within a task: bytes of texts (one text at least), and what is asked of them.
BYTES_AT_ONCE, ASKED_AT_ONCE = 1_000_000, 50_000


@cache
def letters() -> tuple[np.ndarray, ...]:
    """First and last of each run of letters and digits, and those that are another one in ``tokens`` with that one, as Spark has them."""
    code = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")
    every = SparkSession.active().range(0x40000).where("id NOT BETWEEN 55296 AND 57343").select("id", code.alias("c"))
    told = every.where(F.col("c").rlike(r"[\p{L}\p{N}]")).select("id", T.folded(F.lower("c")).alias("low")).toArrow().sort_by("id")
    held = told["id"].to_numpy()
    low = np.array([ord(c) for c in told["low"].to_pylist()], np.int64)
    new = np.flatnonzero(np.diff(held) > 1)
    other = low != held
    return held[np.append(0, new + 1)], held[np.append(new, len(held) - 1)], held[other], low[other]


def tables(firsts: np.ndarray, lasts: np.ndarray, held: np.ndarray, lows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Kind of each character, and what it is in ``tokens``."""
    edges = np.zeros(0x110001, np.int8)
    edges[firsts] += 1
    edges[lasts + 1] -= 1
    kind, low = np.cumsum(edges[:-1], dtype=np.int8), np.arange(0x110000, dtype=np.uint32)
    kind[0x300:0x370], kind[[32, 9, 10, 13]] = MARK, WHITE
    low[held] = lows
    return kind, low


def lowered(text: Column) -> Column:
    """The text in lower case where a letter's depends on those around it, or else null: then ``letters`` tells it."""
    return F.when(F.contains(text, F.lit("Σ")), F.lower(text))


def firsts(values: np.ndarray) -> np.ndarray:
    """Where a run of equal values begins."""
    return np.flatnonzero(np.append(True, values[1:] != values[:-1])[: len(values)])


class Texts:
    """Texts cut into words: ``starts`` and ``ends`` of words in ``whole``, ``doc`` their texts, ``words`` as in ``tokens``;
    of each text its ``begin`` and ``end`` in ``whole``, its first word and number of words."""

    def __init__(self, texts: list[str], kind: np.ndarray, low: np.ndarray):
        self.whole = "\n".join(texts)
        codes = np.frombuffer(self.whole.encode("utf-32-le"), np.uint32)
        length = np.fromiter(map(len, texts), np.int64, len(texts))
        self.end = np.cumsum(length + 1) - 1
        self.begin = self.end - length
        of = kind[codes]
        letter, mark = np.flatnonzero(of == LETTER), of == MARK
        if mark.any():
            inside = np.concatenate([[False], mark | (of == LETTER), [False]])
            run_ends = np.flatnonzero(inside[:-1] & ~inside[1:])
            run = np.searchsorted(run_ends, letter, "right")
            first = firsts(run)
            self.ends = run_ends[run[first]]
        else:
            first = firsts(letter - np.arange(len(letter)))
            self.ends = letter[np.append(first[1:], len(letter))[: len(first)] - 1] + 1
        self.starts = letter[first]
        chars = low[codes[letter]]
        sizes = np.append(first, len(letter)).astype(np.int64) * 4
        self.words = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(sizes), pa.py_buffer(chars)])
        self.first = np.searchsorted(self.starts, self.begin)
        self.number = np.searchsorted(self.starts, self.end) - self.first
        self.doc = np.repeat(np.arange(len(texts)), self.number)
        self._codes, self._of = codes, of

    def sentences(self) -> np.ndarray:
        """Words that begin a text or follow a full stop or colon and white space."""
        stop = np.flatnonzero((self._codes == ord(".")) | (self._codes == ord(":")))
        dark = np.append(np.flatnonzero(self._of != WHITE), len(self._of))
        after = dark[np.searchsorted(dark, stop, "right")]
        after = after[after > stop + 1]
        place = np.searchsorted(self.starts, after)
        held = place < len(self.starts)
        place, after = place[held], after[held]
        return np.unique(np.concatenate([self.first[self.number > 0], place[self.starts[place] == after]]))


def steps(size: np.ndarray, asked: np.ndarray) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts of ``size`` bytes of which ``asked`` is asked: what a task takes at once."""
    lo = held = many = 0
    for k, (n, m) in enumerate(zip(size.tolist(), asked.tolist(), strict=True)):
        if k > lo and (held + n > BYTES_AT_ONCE or many + m > ASKED_AT_ONCE):
            yield lo, k
            lo, held, many = k, 0, 0
        held, many = held + n, many + m
    if lo < len(size):
        yield lo, len(size)


def bytes_of(texts: pa.Array) -> np.ndarray:
    return pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
