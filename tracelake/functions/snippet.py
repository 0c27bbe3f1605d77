"""Snippets: the window of a text that holds most of the asked phrases, with the phrases marked.

A window begins near a place of a phrase, or at the start of the sentence that holds it.
Distinct phrases count most, then places, then a start of a sentence; the first of the best
windows is shown, its places between '[' and ']', and '…' where the text goes on.

Texts are cut into words once for all that is asked of them, a block of texts at a time, and
the windows of many questions are weighed together as arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T
from .phrases import Phrases
from .words import Texts, bytes_of, firsts, letters, lowered, steps, tables

WIDTH = 12
#: Points of a window for a phrase's first place, for a sentence's start, and for the text's.
FIRST_PLACE, SENTENCE, TEXT_START = 1000, 100, 120
#: Places of phrases that a step within a task weighs at once (those of one question at least).
PLACES_AT_ONCE = 1_000_000


def _spread(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers from each ``lo`` to before its ``hi``, and which of them each is of."""
    count = hi - lo
    which = np.repeat(np.arange(len(count)), count)
    return np.arange(len(which)) - np.repeat(np.cumsum(count) - count - lo, count), which


def _best_windows(
    key: np.ndarray, at: np.ndarray, end: np.ndarray, sentence: np.ndarray, before: np.ndarray, total: np.ndarray, width: int
) -> tuple[np.ndarray, np.ndarray]:
    """Which questions have places, and the first words of their best windows.

    Places are in order of question, word and phrase: ``key`` is ``at`` plus the question times a number beyond all words,
    ``end`` the word after the phrase, ``sentence`` the word where the sentence starts, ``before`` the last
    place of the same phrase (-1: none), ``total`` the words of the text.
    """
    asked = key - at
    place = np.arange(len(key))
    # a window is tried once, for the first place that gives it
    near = firsts(key)
    begin = asked + sentence
    far = (sentence < at) & (total > width)
    far = np.flatnonzero(far & np.append(True, (begin[1:] != begin[:-1]) | ~far[:-1])[: len(key)])
    lo = np.concatenate([near, np.searchsorted(key, begin[far])])
    hi = np.searchsorted(key, np.concatenate([key[near], begin[far]]) + width)
    bonus = np.concatenate([np.zeros(len(near), np.int64), np.where(sentence[far] == 0, TEXT_START, SENTENCE)])
    inside, window = _spread(lo, hi)
    distinct = np.bincount(window[before[inside] < lo[window]], minlength=len(lo))
    points = (FIRST_PLACE - 1) * distinct + (hi - lo) + bonus
    # most points, then the first turn, in one number
    worth = (points << 32) - np.concatenate([2 * place[near], 2 * place[far] + 1])
    first, first_far = firsts(asked[near]), firsts(asked[far])
    best, named = np.maximum.reduceat(worth[: len(near)], first), asked[near][first]
    other = np.searchsorted(named, asked[far][first_far])
    best[other] = np.maximum(best[other], np.maximum.reduceat(worth[len(near) :], first_far))
    turn = -best & 0xFFFFFFFF
    x = turn >> 1
    last = np.searchsorted(key, key[x] + width) - 1
    spare = np.trunc((width - (end[last] - at[x])) / 2).astype(np.int64)
    centred = np.maximum(0, np.minimum(at[x] - spare, total[x] - width))
    return named, np.where(turn & 1, sentence[x], centred)


def _marks(key: np.ndarray, at: np.ndarray, end: np.ndarray, base: np.ndarray, start: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """(question, first word, word after) of what is marked in windows that begin at ``start``, of the questions ``base``
    (keys of their words from 0); places that overlap are marked as one."""
    longest = int((end - at).max(initial=1))
    lo = np.searchsorted(key, base + np.maximum(0, start - longest + 1))
    inside, which = _spread(lo, np.searchsorted(key, base + start + width))
    held = end[inside] > start[which]
    inside, which = inside[held], which[held]
    a = base[which] + np.maximum(at[inside], start[which])
    b = np.maximum.accumulate(base[which] + np.minimum(end[inside], (start + width)[which]))
    first = np.flatnonzero(np.append(True, a[1:] >= b[:-1])[: len(a)])
    which, last = which[first], np.append(first[1:], len(a))[: len(first)] - 1
    return which, a[first] - base[which], b[last] - base[which]


def snippets(texts: list[str], lows: list[str | None], doc: np.ndarray, asked: pa.Array, told: tuple[np.ndarray, ...], width: int = WIDTH) -> list[str]:
    """The snippet of text number ``doc`` for each of ``asked``: its phrases, parted by line breaks, their words by spaces.

    ``lows`` is what ``lowered`` gives of the texts, ``told`` what ``tables`` gives.
    """
    cut = Texts(texts, *told)
    same = all(x is None for x in lows)
    words = cut.words if same else Texts([t if x is None else x for t, x in zip(texts, lows, strict=True)], *told).words
    coded = pc.dictionary_encode(asked.fill_null(""))
    lists = [[p for p in q.split("\n") if p] for q in coded.dictionary.to_pylist()]
    numbers: dict[str, int] = {}
    flat = np.array([numbers.setdefault(p, len(numbers)) for q in lists for p in q], np.int64)
    tree = Phrases(list(numbers.values()), list(numbers))
    known = pa.array([w.encode("utf-32-le") for w in tree.words], pa.large_binary())
    found = pc.index_in(words, value_set=known).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    _, phrase, place = tree.found(found, cut.doc)
    far = len(cut.starts) + 2 * width + 1  # beyond every word of a text and a window after it
    order = np.lexsort((place, phrase))
    place, name = place[order], phrase[order] * far + place[order]
    long = np.array([p.count(" ") + 1 for p in numbers], np.int64)
    sentences = cut.sentences()
    # the phrases of each question, and the places of each in the question's text
    question = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum([len(q) for q in lists], dtype=np.int64)
    starts = ends - np.array([len(q) for q in lists], np.int64)
    pair, of = _spread(starts[question], ends[question])
    wanted = flat[pair] * far + cut.first[doc[of]]
    lo, hi = np.searchsorted(name, wanted), np.searchsorted(name, wanted + cut.number[doc[of]])
    places = np.append(0, np.cumsum(np.bincount(of, weights=hi - lo, minlength=len(doc)).astype(np.int64)))
    out: list[str] = []
    while len(out) < len(doc):
        a = len(out)
        b = max(a + 1, int(np.searchsorted(places, places[a] + PLACES_AT_ONCE, "right")) - 1)
        p, q = np.searchsorted(of, [a, b])
        inside, which = _spread(lo[p:q], hi[p:q])
        of_pair = of[p:q][which] - a
        text = doc[a:b][of_pair]
        at = place[inside] - cut.first[text]
        key = of_pair * far + at
        order = np.argsort(key, kind="stable")  # of one question and word, phrases stay in order
        spot = np.empty(len(order), np.int64)
        spot[order] = np.arange(len(order))
        before = np.full(len(order), -1, np.int64)
        again = np.flatnonzero(which[1:] == which[:-1]) + 1
        before[spot[again]] = spot[again - 1]
        end = (at + long[flat[pair[p:q][which]]])[order]
        text, key, at = text[order], key[order], at[order]
        sentence = sentences[np.searchsorted(sentences, cut.first[text] + at, "right") - 1] - cut.first[text]
        base, chosen = _best_windows(key, at, end, sentence, before, cut.number[text], width)
        start = np.zeros(b - a, np.int64)
        start[base // far] = chosen
        marks = _marks(key, at, end, base, chosen, width)
        out.extend(_shown(cut, doc[a:b], start, base // far, marks, width))
    return out


def _shown(cut: Texts, doc: np.ndarray, start: np.ndarray, marked: np.ndarray, marks: tuple[np.ndarray, ...], width: int) -> Iterator[str]:
    """The windows of texts number ``doc`` from word ``start``, with the ``marks`` of those numbered ``marked``."""
    which, a, b = marks
    which = marked[which]
    opens, closes = cut.starts[cut.first[doc[which]] + a].tolist(), cut.ends[cut.first[doc[which]] + b - 1].tolist()
    bounds = np.searchsorted(which, np.arange(len(doc) + 1)).tolist()
    first, goes_on = cut.first[doc] + start, start + width < cut.number[doc]
    begin, end = cut.begin[doc].copy(), cut.end[doc].copy()
    begin[start > 0] = cut.starts[first[start > 0]]
    end[goes_on] = cut.ends[first[goes_on] + width - 1]
    whole = cut.whole
    for k, (at, stop, inner, more) in enumerate(zip(begin.tolist(), end.tolist(), (start > 0).tolist(), goes_on.tolist(), strict=True)):
        said = ["…"] if inner else []
        for m in range(bounds[k], bounds[k + 1]):
            said += (whole[at : opens[m]], "[", whole[opens[m] : closes[m]], "]")
            at = closes[m]
        said.append(whole[at:stop])
        if more:
            said.append("…")
        yield "".join(said)


def asked_text(phrases: str | Column) -> Column:
    """Phrases, arrays of folded words, as one text."""
    return F.array_join(F.transform(T.col(phrases), lambda p: F.array_join(p, " ")), "\n")


def best_of(fields: list[tuple[pa.Array, pa.Array]], doc: np.ndarray, asked: pa.Array, told: tuple[np.ndarray, ...]) -> list[str]:
    """For each of ``asked``, of the fields (texts, and what ``lowered`` gives) the first snippet with a mark, or else the first that isn't empty."""
    best = [""] * len(doc)
    left = np.arange(len(doc))
    for texts, lows in fields:
        if not len(left):
            break
        said = snippets([t or "" for t in texts.to_pylist()], lows.to_pylist(), doc[left], asked.take(pa.array(left)), told)
        for k, s in zip(left.tolist(), said, strict=True):
            if "[" in s or not best[k]:
                best[k] = s
        left = left[np.array(["[" not in s for s in said], bool)]
    return best


def snippet(text: str | Column, phrases: str | Column, width: int = WIDTH) -> Column:
    """The best window of ``width`` words for ``phrases``, arrays of folded words; null texts count as empty."""
    kinds = letters()

    @F.arrow_udf("string")
    def of(texts: pa.Array, lows: pa.Array, asked: pa.Array) -> pa.Array:
        told, out = tables(*kinds), []
        for lo, hi in steps(bytes_of(texts), np.ones(len(texts), np.int64)):
            part = texts[lo:hi].to_pylist(), lows[lo:hi].to_pylist(), np.arange(hi - lo), asked[lo:hi]
            out += snippets(*part, told, width)
        return pa.array(out, pa.string())

    said = F.coalesce(T.col(text), F.lit(""))
    return of(said, lowered(said), asked_text(phrases))
