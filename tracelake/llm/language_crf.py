"""Language ID by a linear-chain conditional random field over the words of a text.

Method: each word has affix features (first and last 1 to 3 bytes), byte n-grams (2 to 4)
and, for the common words of the training rows, a lexicon feature. Their weights and the
transitions between the languages of neighbouring words are learned together by the
gradient of the sequence likelihood, on labelled texts spliced so that languages switch
inside a chain. Forward-backward gives every word the posterior of each language; a
document's prediction is the language with the largest mean posterior over its words.

The model is fitted on at most ``SAMPLE_ROWS`` labelled rows of at most ``SAMPLE_BYTES``
each, the first by a hash of doc_id and text. Prediction reads whole texts, as chains of
``CHAIN`` words.

Results by case: a null text, or one without a letter, is ``und`` with score 0; ties go to
the language that sorts first; repeated rows each get a row; a null doc_id counts as held
in; further columns are ignored; with no labelled row or no column ``lang`` every text is ``und``; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import K1, K2, K3, K4, blocks, mix, text_buffers, word_hashes
from .graph import sampled

SAMPLE_ROWS = 3000
SAMPLE_BYTES = 16_384
CHAIN = 64
TABLE_BITS = 17
#: Distinct words of a block whose features are in memory together.
WORDS_AT_ONCE = 8192
#: Bytes of the sampled texts whose letters the driver holds at a time.
TEXT_BYTES = 1 << 18
LEXICON = 4000
UNDETERMINED = "und"

_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[128:] = True
_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * K2)


def lowered(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z and the capitals of the Latin-1 letters in lower case."""
    data = data.copy()
    data[(data >= 65) & (data <= 90)] += 32
    if len(data) > 1:
        after = np.flatnonzero(data[:-1] == 0xC3) + 1
        capital = after[(data[after] >= 0x80) & (data[after] <= 0x9E) & (data[after] != 0x97)]
        data[capital] += 32
    return data


class Letters:
    """The letter runs of a block: bytes, ``start``, ``end``, row and name of each."""

    def __init__(self, texts: pa.Array):
        data, offsets = text_buffers(texts)
        self.data = lowered(data)
        inside = _LETTER[self.data]
        first, last = inside.copy(), inside.copy()
        if len(data):
            first[1:] &= ~inside[:-1]
            last[:-1] &= ~inside[1:]
            filled = offsets[:-1] < offsets[1:]
            heads, tails = offsets[:-1][filled], offsets[1:][filled] - 1
            first[heads], last[tails] = inside[heads], inside[tails]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.row = np.searchsorted(offsets, self.start, "right") - 1
        self.rows = len(offsets) - 1
        self.bounds = np.searchsorted(self.row, np.arange(self.rows + 1))
        self.name = word_hashes(_VALUE, self.data, self.start, self.end)

    def name_and_count(self) -> tuple[np.ndarray, np.ndarray]:
        """The names, and how many of them each row has."""
        return self.name, np.diff(self.bounds)


def word_features(
    data: np.ndarray, start: np.ndarray, end: np.ndarray, name: np.ndarray, lexicon: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """(word, cell) pairs: hashed features of each word, sorted by word."""
    length = end - start
    bounds = np.concatenate([[0], np.cumsum(length)])
    total = int(bounds[-1])
    owner = np.repeat(np.arange(len(start)), length)
    place = np.arange(total) - bounds[owner]
    text = _VALUE[data[np.repeat(start, length) + place]]
    words, cells = [], []
    grams = [text]
    for k in range(1, 4):
        grams.append(grams[-1][: total - k] * K1 + text[k:] if total > k else np.zeros(0, np.uint64))
    shift = np.uint64(64 - TABLE_BITS)
    for k in range(3):  # affixes of k + 1 bytes
        has = np.flatnonzero(length > k)
        for salt, at in ((np.uint64(11 + k), bounds[has]), (np.uint64(21 + k), bounds[has + 1] - k - 1)):
            words.append(has)
            cells.append(mix(grams[k][at] * K3 + salt) >> shift)
    for k in range(1, 4):
        at = np.flatnonzero(place[: max(total - k, 0)] + k < length[owner[: max(total - k, 0)]])
        words.append(owner[at])
        cells.append(mix(grams[k][at] * K4 + np.uint64(31 + k)) >> shift)
    if len(lexicon):
        at = np.searchsorted(lexicon, name)
        known = np.flatnonzero(lexicon[np.minimum(at, len(lexicon) - 1)] == name)
        words.append(known)
        cells.append(mix(name[known] + K1) >> shift)
    word, cell = np.concatenate(words), np.concatenate(cells).astype(np.int64)
    order = np.argsort(word, kind="stable")
    return word[order], cell[order]


@dataclass
class Crf:
    langs: list[str]
    weights: np.ndarray  # cells x langs
    transitions: np.ndarray  # langs x langs, log
    lexicon: np.ndarray  # sorted names

    def emissions(self, data, start, end, name) -> np.ndarray:
        """Log potentials of each word: the mean of its feature weights, scaled."""
        word, cell = word_features(data, start, end, name, self.lexicon)
        bounds = np.searchsorted(word, np.arange(len(start)))
        return SCALE * np.add.reduceat(self.weights[cell], bounds, axis=0) / np.diff(np.append(bounds, len(word)))[:, None]


SCALE = 4.0


def forward_backward(emission: np.ndarray, length: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors of each place of padded chains (chains x places x langs), and expected transitions."""
    chains, places, langs = emission.shape
    potential = np.exp(emission - emission.max(axis=2, keepdims=True))
    step = np.exp(transitions - transitions.max())
    alpha = np.empty_like(potential)
    now = np.full((chains, langs), 1.0 / langs)
    for t in range(places):
        now = (now if t == 0 else now @ step) * potential[:, t]
        now = now / now.sum(axis=1, keepdims=True)
        alpha[:, t] = now
    gamma = np.empty_like(alpha)
    beta = np.ones((chains, langs))
    expected = np.zeros((langs, langs))
    for t in range(places - 1, -1, -1):
        last = (t >= length - 1)[:, None]
        if t < places - 1:
            ahead = potential[:, t + 1] * beta
            joint = alpha[:, t, :, None] * step[None] * ahead[:, None, :]
            inside = t < length - 1
            sums = joint.sum(axis=(1, 2))
            expected += np.einsum("n,nij->ij", inside / sums, joint)
            beta = ahead @ step.T
            beta = beta / beta.sum(axis=1, keepdims=True)
        beta = np.where(last, 1.0, beta)
        both = alpha[:, t] * beta
        gamma[:, t] = both / both.sum(axis=1, keepdims=True)
    return gamma, expected


def posteriors(emission: np.ndarray, length: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """As ``forward_backward`` without the expected transitions, for scoring."""
    chains, places, langs = emission.shape
    potential = np.exp(emission - emission.max(axis=2, keepdims=True))
    step = np.exp(transitions - transitions.max()).astype(potential.dtype)
    alpha = np.empty((places, chains, langs), potential.dtype)
    potential = np.ascontiguousarray(potential.transpose(1, 0, 2))
    now = None
    for t in range(places):
        now = potential[t] if now is None else (now @ step) * potential[t]
        now /= now.sum(axis=1, keepdims=True)
        alpha[t] = now
    beta = np.ones((chains, langs), potential.dtype)
    for t in range(places - 2, -1, -1):
        beta = (potential[t + 1] * beta) @ step.T
        beta /= beta.sum(axis=1, keepdims=True)
        beta[t >= length - 1] = 1.0
        alpha[t] *= beta
    alpha /= alpha.sum(axis=2, keepdims=True)
    return alpha.transpose(1, 0, 2)


def _text_blocks(texts: pa.Array) -> Iterator[pa.Array]:
    for block in blocks([pa.RecordBatch.from_arrays([texts], names=["text"])], "text", TEXT_BYTES):
        yield block["text"]


def _cells(texts: pa.Array, names: np.ndarray, first: np.ndarray, lexicon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cells, bounds) of the features of each name, read where the name stands first in the texts."""
    order = np.argsort(first, kind="stable")
    cells_of, counts_of, before, done = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], 0, 0
    for block in _text_blocks(texts):
        letters = Letters(block)
        until = int(np.searchsorted(first[order], before + len(letters.start)))
        for lo in range(done, until, WORDS_AT_ONCE):
            own = order[lo : min(lo + WORDS_AT_ONCE, until)]
            at = first[own] - before
            word, cell = word_features(letters.data, letters.start[at], letters.end[at], names[own], lexicon)
            cells_of.append(cell.astype(np.int32))
            counts_of.append(np.bincount(word, minlength=len(own)))
        before, done = before + len(letters.start), until
    cell, lengths = np.concatenate(cells_of), np.concatenate(counts_of)
    del cells_of
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    starts, lengths = (np.cumsum(lengths) - lengths)[place], lengths[place]
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    out = np.empty(len(cell), np.int32)
    for lo in range(0, len(names), WORDS_AT_ONCE):
        hi = min(lo + WORDS_AT_ONCE, len(names))
        out[bounds[lo] : bounds[hi]] = cell[np.repeat(starts[lo:hi] - bounds[lo:hi], lengths[lo:hi]) + np.arange(bounds[lo], bounds[hi])]
    return out, bounds


def train(texts: pa.Array, labels: list[str], rounds: int = 160, chains: int = 192, places: int = 32, seed: int = 7) -> Crf:
    """A field fitted by Adagrad on spliced chains of the labelled texts."""
    langs = sorted(set(labels))
    number = {lang: i for i, lang in enumerate(langs)}
    held = [Letters(x).name_and_count() for x in _text_blocks(texts)]
    name, count = (np.concatenate(x) for x in zip((np.zeros(0, np.uint64), np.zeros(0, np.int64)), *held, strict=True))
    names, first, back, counts = np.unique(name, return_index=True, return_inverse=True, return_counts=True)
    back, starts = back.astype(np.int32), np.concatenate([[0], np.cumsum(count)])
    del held, name
    lexicon = np.sort(names[np.argsort(-counts, kind="stable")[:LEXICON]])
    field = Crf(langs, np.zeros((1 << TABLE_BITS, len(langs))), np.zeros((len(langs), len(langs))), lexicon)
    if not len(names) or len(langs) < 2:
        return field
    cell, bounds = _cells(texts, names, first, lexicon)
    share = 1.0 / np.maximum(np.diff(bounds), 1)
    label = np.array([number[x] for x in labels])
    usable = np.flatnonzero(count >= places)
    if not len(usable):
        usable = np.flatnonzero(count > 0)
    by_lang = [usable[label[usable] == k] for k in range(len(langs))]
    by_lang = [x for x in by_lang if len(x)]
    random = np.random.default_rng(seed)
    square, square_t = np.full_like(field.weights, 1e-6), np.full_like(field.transitions, 1e-6)
    for _ in range(rounds):
        ids, gold = np.empty((chains, places), np.int64), np.empty((chains, places), np.int64)
        for c in range(chains):
            cut = places if random.random() < 0.5 else int(random.integers(1, places))
            for lo, hi in ((0, cut), (cut, places)):
                if lo < hi:
                    group = by_lang[random.integers(len(by_lang))]
                    doc = group[random.integers(len(group))]
                    at = starts[doc] + (random.integers(count[doc]) + np.arange(hi - lo)) % count[doc]
                    ids[c, lo:hi], gold[c, lo:hi] = back[at], label[doc]
        used, local = np.unique(ids, return_inverse=True)
        lengths = bounds[used + 1] - bounds[used]
        ends = np.cumsum(lengths)
        cells = cell[np.repeat(bounds[used] - (ends - lengths), lengths) + np.arange(ends[-1])]
        score = SCALE * np.add.reduceat(field.weights[cells], ends - lengths, axis=0) * share[used][:, None]
        gamma, expected = forward_backward(score[local.reshape(ids.shape)], np.full(chains, places), field.transitions)
        gradient = -gamma.reshape(-1, len(langs))
        gradient[np.arange(ids.size), gold.ravel()] += 1
        per_word = np.zeros((len(used), len(langs)))
        np.add.at(per_word, local.ravel(), gradient)
        per_word *= SCALE * share[used][:, None] / chains
        touched, where = np.unique(cells, return_inverse=True)
        change = np.zeros((len(touched), len(langs)))
        np.add.at(change, where, np.repeat(per_word, lengths, axis=0))
        change -= 1e-4 * field.weights[touched]
        square[touched] += change**2
        field.weights[touched] += 0.3 * change / np.sqrt(square[touched])
        moves = -expected
        np.add.at(moves, (gold[:, :-1].ravel(), gold[:, 1:].ravel()), 1)
        moves /= chains
        square_t += moves**2
        field.transitions += 0.1 * moves / np.sqrt(square_t)
    return field


def predicted(field: Crf, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    """(language, score) of each text of a block."""
    langs = len(field.langs)
    letters = Letters(texts)
    mean = np.zeros((letters.rows, max(langs, 1)))
    count = np.diff(letters.bounds)
    if langs and len(letters.start):
        names, first, back = np.unique(letters.name, return_index=True, return_inverse=True)
        score = np.empty((len(names), langs), np.float32)
        for lo in range(0, len(names), WORDS_AT_ONCE):
            own = first[lo : lo + WORDS_AT_ONCE]
            score[lo : lo + WORDS_AT_ONCE] = field.emissions(
                letters.data,
                letters.start[own],
                letters.end[own],
                names[lo : lo + WORDS_AT_ONCE]
            )
        chains = -(-count // CHAIN)
        chain_first = np.concatenate([[0], np.cumsum(chains)])
        place = np.arange(len(back)) - letters.bounds[letters.row]
        chain = chain_first[letters.row] + place // CHAIN
        length = np.bincount(chain, minlength=chain_first[-1])
        # chains of like length together: padding stays small
        order = np.argsort(length, kind="stable")
        starts = np.concatenate([[0], np.cumsum(length)])
        for lo in range(0, len(order), 2048):
            own = order[lo : lo + 2048]
            places = int(length[own].max())
            grid = starts[own][:, None] + np.minimum(np.arange(places)[None], length[own][:, None] - 1)
            gamma = posteriors(score[back[grid]], length[own], field.transitions)
            gamma = gamma * (np.arange(places)[None] < length[own][:, None])[:, :, None]
            sums = gamma.sum(axis=1, dtype=np.float64)
            doc = letters.row[starts[own]]
            for k in range(langs):
                mean[:, k] += np.bincount(doc, weights=sums[:, k], minlength=letters.rows)
    lang, sure = [], np.zeros(letters.rows)
    best = mean.argmax(axis=1)
    latin = np.bincount(letters.row[letters.data[letters.start] < 128], minlength=letters.rows) > 0
    for r in range(letters.rows):
        if not langs or not count[r] or not latin[r] and not _has_letter(texts[r].as_py()):
            lang.append(UNDETERMINED)
        else:
            lang.append(field.langs[best[r]])
            sure[r] = min(1.0, mean[r, best[r]] / count[r])
    return lang, sure


def _predict(model):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            lang, sure = predicted(model.value, block["text"])
            yield pa.RecordBatch.from_pydict({"doc_id": block["doc_id"], "lang_pred": pa.array(lang, pa.string()), "score": pa.array(sure)})

    return rows


def _identified(model, least: float):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            lang, sure = predicted(model.value, block["text"])
            yield block.filter(pa.array((np.array(lang, object) != UNDETERMINED) & (sure >= least)))

    return rows


def _has_letter(text: str | None) -> bool:
    return text is not None and any(c.isalpha() for c in text)


def fold_of(doc_id: str | Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(folds))


def held_out(folds: int = 3, fold: int = 1) -> Column:
    return F.coalesce(fold_of("doc_id", folds) == fold, F.lit(False))


def fit(docs: DataFrame, rows: int = SAMPLE_ROWS) -> Crf:
    """The field, fitted on at most ``rows`` labelled rows that are not held out; without a column ``lang``, on none."""
    if "lang" not in docs.columns:
        return train(pa.array([], pa.string()), [])
    told = docs.where(~held_out()).where("lang is not null")
    short = told.where("text is not null").where(F.octet_length("text") <= SAMPLE_BYTES).select("doc_id", "text", "lang")
    told = sampled(short, rows, short.count(), 8).toArrow()
    return train(told["text"].combine_chunks(), told["lang"].to_pylist())


def language_id(docs: DataFrame, model: Crf | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each document."""
    docs = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        *[F.col("lang").cast("string").alias("lang")] * ("lang" in docs.columns)
    )
    shared = docs.sparkSession.sparkContext.broadcast(model or fit(docs))
    said = docs.select("doc_id", "text").mapInArrow(_predict(shared), "doc_id long, lang_pred string, score double")
    return said.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def labelled_words(model: Crf, text: str) -> list[tuple[str, str]]:
    """(letter run, most likely language) of each word of a code-switched text."""
    letters = Letters(pa.array([text], pa.string()))
    if not len(letters.start):
        return []
    score = model.emissions(letters.data, letters.start, letters.end, letters.name)
    best = posteriors(score[None].astype(np.float64), np.array([len(score)]), model.transitions)[0].argmax(axis=1)
    return [
        (
            letters.data[a:b].tobytes().decode("utf-8", "replace"),
            model.langs[k]
        ) for a, b, k in zip(letters.start, letters.end, best, strict=True)
    ]


def keep_identified(docs: DataFrame, least: float = 0.4, model: Crf | None = None) -> DataFrame:
    """``docs`` without those whose language is undetermined or scores under ``least``; all columns stay."""
    fitted = docs.sparkSession.sparkContext.broadcast(model or fit(docs))
    return docs.mapInArrow(_identified(fitted, least), docs.schema)
