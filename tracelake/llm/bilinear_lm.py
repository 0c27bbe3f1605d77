"""LM scoring: a log-bilinear neural model, trained in numpy with noise-contrastive estimation.

Method: the commonest ``CLASSES`` words have classes of their own, all other words share
one, and the text's end is one more. A token's class k follows from c1, the class before
it, and c2, the nearest class before that which isn't the shared one:

    score(k) = (r[c1] * w1 + r[c2] @ W2) . q[k] + b[k]

with embeddings r, q. Within the shared class, every word w that occurs at least
``LEARNED`` times has a vector and a bias of its own, so the vocabulary grows with the corpus:

    score(w) = h . v[w] + b[w] + log(share of w)

where h is the same context vector, of c1, or of c2 where the word before is of the shared
class too. Rarer words, and all unseen ones together, keep their smoothed share.

Both parts are trained with noise-contrastive estimation. The class model takes Adagrad
steps on the corpus-wide counts of its trigrams, which are dealt into ``PARTS`` fixed parts
whose parameters are averaged; so neither the number of partitions nor their order
matters. The word vectors are fitted where Spark brings all contexts of a word together,
each word by itself, against the expectation under the noise. Normalisers come from
batched matrix products: of all classes for each context, and of all words for each h.

Counts are of all training documents, and shuffled by word. The counts and vectors of the
commonest words, at most ``HEAD`` of them, are broadcast; a document's other words meet
theirs in a join. Words are told apart by 64-bit fingerprints.

Results by case: a null text counts as empty and has one token, the end; a null doc_id is
not held out; rows that repeat each get a row and each count in training; further columns
are ignored; with no training document every probability is 1 for the base and uniform over
the classes for the model; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import Words, blocks, lists, signed, sorted_runs, unsigned
from .graph import checkpointed, shuffle_partitions
from .language_crf import held_out

CLASSES = 254
#: Class numbers: 0 .. CLASSES - 1 words, then the shared one, the end, and the place before the start.
SHARED, LAST, START = CLASSES, CLASSES + 1, CLASSES + 2
KINDS = CLASSES + 3
HEAD = 100_000
#: Occurrences from which a word of the shared class has a vector.
LEARNED = 5
WIDTH = 24
NOISE = 10
ROUNDS = 4
PARTS = 16
MINIBATCH = 512
WORD_ROUNDS = 16
WORDS_AT_ONCE = 2048
#: How many occurrences the belief weighs that a word ignores its context.
BELIEF = 2.0
ALPHA = 0.1
END = np.uint64(0x0E0F)


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(name, row, bounds) of the tokens of a block: a row's words and its end."""
    words = Words(texts, lower=True)
    bounds = words.bounds + np.arange(words.rows + 1)
    name = np.full(len(words) + words.rows, END, np.uint64)
    row = np.repeat(np.arange(words.rows), np.diff(bounds))
    name[np.arange(len(words)) + words.doc] = words.name
    return name, row, bounds


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches, "text"):
        name, count = np.unique(_tokens(block["text"])[0], return_counts=True)
        yield pa.RecordBatch.from_arrays([signed(name), pa.array(count)], names=["name", "c"])


@dataclass
class Head:
    """The commonest words: sorted names with counts, classes and vectors, and the totals of all words."""

    names: np.ndarray
    counts: np.ndarray
    classes: np.ndarray
    total: int  # tokens
    kinds: int  # distinct tokens
    rest_total: int  # tokens of the shared class
    rest_kinds: int
    vectors: np.ndarray | None = None  # names x (WIDTH + 1), zero where a word has none

    def find(self, name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, whether it is there) of each name."""
        if not len(self.names):
            return np.zeros(len(name), np.int64), np.zeros(len(name), bool)
        at = np.minimum(np.searchsorted(self.names, name), len(self.names) - 1)
        return at, self.names[at] == name

    def kinds_of(self, name: np.ndarray) -> np.ndarray:
        at, hit = self.find(name)
        return np.where(hit, self.classes[at] if len(self.names) else 0, np.where(name == END, LAST, SHARED))

    def log_whole(self) -> float:
        """log10 of what the base's smoothed counts are shares of."""
        return math.log10(self.total + ALPHA * (self.kinds + 1)) if self.total else math.log10(ALPHA)

    def log_rest(self) -> float:
        """The same within the shared class."""
        return math.log10(self.rest_total + ALPHA * (self.rest_kinds + 1))


def head_of(counts: DataFrame, size: int) -> Head:
    """The words with the largest counts, at most ``size`` and those of the classes."""
    totals = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    grade = F.floor(F.log2("c") * 16).cast("int")
    told, bound = 0, 1 << 30
    for row in sorted(counts.groupBy(grade.alias("grade")).count().collect(), key=lambda r: -r["grade"]):
        told += row["count"]
        if told > size:
            break
        bound = row["grade"]
    top = counts.orderBy(F.desc("c"), "name").limit(CLASSES + 1).toArrow()
    rest = counts.where(grade >= bound).toArrow()
    name, at = np.unique(np.concatenate([unsigned(top["name"]), unsigned(rest["name"])]), return_index=True)
    count = np.concatenate([top["c"].to_numpy(), rest["c"].to_numpy()])[at]
    order = np.lexsort((name.view(np.int64), -count))
    classes = np.full(len(name), SHARED)
    words = order[name[order] != END][:CLASSES]
    classes[words] = np.arange(len(words))
    classes[name == END] = LAST
    own = classes != SHARED
    total, kinds = int(totals["n"] or 0), int(totals["v"])
    return Head(name, count, classes, total, kinds, total - int(count[own].sum()), kinds - int(own.sum()))


def contexts(kind: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The class before each token, and the nearest one before that which isn't shared; START before the text."""
    n = len(kind)
    first = np.repeat(bounds[:-1], np.diff(bounds))
    place = np.arange(n)
    one = np.full(n, START)
    one[1:] = kind[:-1]
    one[place == first] = START
    told = np.maximum.accumulate(np.where(kind != SHARED, place, -1)) if n else place
    near = np.full(n, -1)
    near[2:] = told[:-2]
    two = np.where((near >= first) & (place - 2 >= first), kind[np.maximum(near, 0)], START)
    return one, two


def word_context(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """What the words of the shared class are predicted from: the class before, or where that is shared, the other one."""
    return np.where(one == SHARED, KINDS + two, one)


def _trigram_rows(head):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            name, _, bounds = _tokens(block["text"])
            kind = head.value.kinds_of(name)
            one, two = contexts(kind, bounds)
            code, count = np.unique((two * KINDS + one) * KINDS + kind, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(code.astype(np.int32)), pa.array(count)], names=["code", "n"])

    return rows


def _word_rows(head):
    """(name, context, n) of the words of the shared class; words of the head go by their place in it, which packs better."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            name, _, bounds = _tokens(block["text"])
            kind = head.value.kinds_of(name)
            place, hit = head.value.find(name)
            name = np.where(hit, place.astype(np.uint64), name)
            context = word_context(*contexts(kind, bounds))
            at = np.flatnonzero(kind == SHARED)
            at = at[np.lexsort((context[at], name[at]))]
            name, context = name[at], context[at]
            starts = np.flatnonzero(np.append(True, (name[1:] != name[:-1]) | (context[1:] != context[:-1]))[: len(at)])
            yield pa.RecordBatch.from_arrays(
                [
                    signed(name[starts]),
                    pa.array(context[starts].astype(np.int16)),
                    pa.array(np.diff(np.append(starts, len(at))).astype(np.int32))
                ],
                names=["name", "context", "n"]
            )

    return rows


@dataclass
class ClassLogs:
    """What the log probability of a class is the sum of: a part of each context class, less the context's normaliser."""

    near: np.ndarray
    far: np.ndarray
    norm: np.ndarray

    def log10(self, two, one, kind) -> np.ndarray:
        return (self.near[one, kind] + self.far[two, kind] - self.norm[two, one]) / math.log(10)


@dataclass
class Bilinear:
    """Parameters as one flat array: r, q (classes x width), w1 (width), W2 (width x width), b (classes)."""

    flat: np.ndarray

    @classmethod
    def start(cls, unigram: np.ndarray, seed: int = 5) -> Bilinear:
        random = np.random.default_rng(seed)
        n = KINDS
        out = cls(np.zeros(2 * n * WIDTH + WIDTH + WIDTH * WIDTH + n))
        r, q, w1, w2, b = out.parts()
        r[:] = random.normal(0, 0.1, r.shape)
        q[:] = random.normal(0, 0.1, q.shape)
        w1[:] = 1.0
        w2[:] = 0.3 * np.eye(WIDTH)
        b[:] = np.log(unigram)
        return out

    def parts(self) -> tuple[np.ndarray, ...]:
        n, at, out = KINDS, 0, []
        for shape in ((n, WIDTH), (n, WIDTH), (WIDTH,), (WIDTH, WIDTH), (n,)):
            size = int(np.prod(shape))
            out.append(self.flat[at : at + size].reshape(shape))
            at += size
        return tuple(out)

    def step(self, square: np.ndarray, one, two, target, weight, noise, random, rate: float = 0.15) -> None:
        """One Adagrad step on the NCE gradient of a minibatch of weighted trigrams."""
        r, q, w1, w2, b = self.parts()
        h1, h2 = r[one], r[two]
        context = h1 * w1 + h2 @ w2
        drawn = np.searchsorted(noise[1], random.random((len(one), NOISE)))
        kinds = np.concatenate([target[:, None], drawn], axis=1)
        vectors = q[kinds]
        score = np.einsum("nd,nkd->nk", context, vectors) + b[kinds]
        odds = score - np.log(NOISE * noise[0][kinds])
        pull = -1.0 / (1.0 + np.exp(-np.clip(odds, -30, 30)))
        pull[:, 0] += 1.0
        pull *= (weight / weight.sum())[:, None]
        gradient = Bilinear(np.zeros_like(self.flat))
        gr, gq, g1, g2, gb = gradient.parts()
        back = np.einsum("nk,nkd->nd", pull, vectors)
        np.add.at(gq, kinds.ravel(), (pull[:, :, None] * context[:, None]).reshape(-1, WIDTH))
        gb += np.bincount(kinds.ravel(), pull.ravel(), minlength=len(gb))
        np.add.at(gr, one, back * w1)
        np.add.at(gr, two, back @ w2.T)
        g1 += (back * h1).sum(axis=0)
        g2 += h2.T @ back
        square += gradient.flat**2
        self.flat += rate * gradient.flat / np.sqrt(square + 1e-8)

    def classes(self) -> ClassLogs:
        """The normalised class probabilities, by batched products over all contexts."""
        r, q, w1, w2, b = self.parts()
        near, far = (r * w1) @ q[:START].T, (r @ w2) @ q[:START].T + b[:START]  # START is never predicted
        norm = np.empty((KINDS, KINDS))
        for two in range(KINDS):
            score = near + far[two]
            most = score.max(axis=1)
            norm[two] = most + np.log(np.exp(score - most[:, None]).sum(axis=1))
        return ClassLogs(near, far, norm)

    def word_contexts(self) -> np.ndarray:
        """h of every context of the shared class's words."""
        r, _, w1, w2, _ = self.parts()
        return np.concatenate([r * w1, r[SHARED] * w1 + r @ w2])


def _train_rows(flat: np.ndarray, unigram: np.ndarray, turn: int):
    noise = (unigram, np.cumsum(unigram)[:-1])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in sorted_runs(batches, ["part"]):
            code, n, part = table["code"].to_numpy().astype(np.int64), table["n"].to_numpy(), table["part"].to_numpy()
            for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(code)], strict=True):
                model, square = Bilinear(flat.copy()), np.zeros_like(flat)
                random = np.random.default_rng([turn, int(part[lo])])
                order = lo + random.permutation(hi - lo)
                for k in range(0, len(order), MINIBATCH):
                    own = order[k : k + MINIBATCH]
                    c = code[own]
                    model.step(square, c // KINDS % KINDS, c // KINDS**2, c % KINDS, n[own].astype(float), noise, random)
                yield pa.RecordBatch.from_pydict(
                    {
                        "part": pa.array([part[lo]], pa.int32()), "mass": pa.array([float(n[lo:hi].sum())]), "flat": lists(
                            pa.array(model.flat),
                            np.array([0, len(flat)])
                        )
                    }
                )

    return rows


def train(trigrams: DataFrame, rounds: int = ROUNDS) -> tuple[Bilinear, np.ndarray]:
    """The model fitted on (part, code, n), the counts of all class trigrams, each code once, whole parts in order."""
    kinds = trigrams.groupBy((F.col("code") % KINDS).alias("k")).agg(F.sum("n").alias("n")).collect()
    unigram = np.full(KINDS, 0.5)
    for row in kinds:
        unigram[row["k"]] += row["n"]
    unigram /= unigram.sum()
    model = Bilinear.start(unigram)
    if not kinds:
        return model, unigram
    for turn in range(rounds):
        said = sorted(
            trigrams.mapInArrow(_train_rows(model.flat, unigram, turn), "part int, mass double, flat array<double>").toArrow().to_pylist(),
            key=lambda r: r["part"]
        )
        mass = sum(r["mass"] for r in said)
        model = Bilinear(sum(np.array(r["flat"]) * (r["mass"] / mass) for r in said))
    return model, unigram


def whitened(h: np.ndarray, share: np.ndarray, longest: float = 5.0) -> np.ndarray:
    """The context vectors turned and scaled to spread alike in all directions under ``share``, and a column of ones."""
    h = h - share @ h
    value, turn = np.linalg.eigh((h * share[:, None]).T @ h)
    h = h @ turn / np.sqrt(value + 1e-4 * value.max() + 1e-12)
    h *= np.minimum(1.0, longest / np.maximum(np.linalg.norm(h, axis=1, keepdims=True), 1e-12))
    return np.concatenate([h, np.ones((len(h), 1))], axis=1)


def word_vectors(seen: np.ndarray, h: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Vector and bias of each word by Adagrad on its NCE objective; ``seen`` has how often it stood in each context.

    A word's own share is its noise, so its score is log odds against the contexts' shares.
    """
    count = seen.sum(axis=1, keepdims=True)
    own = (seen / count).astype(np.float32)
    h, noise = h.astype(np.float32), (NOISE * share).astype(np.float32)
    out, square = np.zeros((len(seen), h.shape[1]), np.float32), np.full((len(seen), h.shape[1]), 1e-6, np.float32)
    pull = np.concatenate([np.full(h.shape[1] - 1, BELIEF), [0.0]]).astype(np.float32) / count.astype(np.float32)
    for _ in range(WORD_ROUNDS):
        odds = 1.0 / (1.0 + np.exp(np.log(np.float32(NOISE)) - out @ h.T))
        gradient = (own - odds * (own + noise)) @ h - pull * out
        square += gradient * gradient
        out += 0.5 * gradient / np.sqrt(square)
    return out


def _vector_rows(head, h: np.ndarray, share: np.ndarray):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = head.value.names.view(np.int64)
        for table, starts in sorted_runs(batches, ["name"]):
            name, context, n = (table[c].to_numpy() for c in ("name", "context", "n"))
            if len(names):
                name = np.where((name >= 0) & (name < len(names)), names[np.clip(name, 0, len(names) - 1)], name)
            count = np.add.reduceat(n, starts)
            ends = np.append(starts[1:], len(n))
            often = np.flatnonzero(count >= LEARNED)
            for lo in range(0, len(often), WORDS_AT_ONCE):
                own = often[lo : lo + WORDS_AT_ONCE]
                size = ends[own] - starts[own]
                to = np.cumsum(size)
                at = np.repeat(starts[own] - (to - size), size) + np.arange(to[-1])
                seen = np.zeros((len(own), len(h)))
                seen[np.repeat(np.arange(len(own)), size), context[at]] = n[at]
                vector = word_vectors(seen, h, share)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(name[starts[own]]),
                        pa.array(count[own].astype(np.int64)),
                        lists(pa.array(vector.ravel(), pa.float32()), np.arange(len(own) + 1) * vector.shape[1])
                    ],
                    names=["name", "c", "vector"]
                )

    return rows


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of WIDTH + 1 numbers as rows; zeros for null."""
    out = np.zeros((len(column), WIDTH + 1))
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    if valid.any():
        out[valid] = column.drop_null().flatten().to_numpy().reshape(-1, WIDTH + 1)
    return out


def normalisers(vectors: DataFrame, h: np.ndarray, head: Head) -> np.ndarray:
    """For each context, the sum of the shared class's unnormalised probabilities."""
    rest = 10.0 ** head.log_rest()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(h))
        for batch in batches:
            for lo in range(0, batch.num_rows, WORDS_AT_ONCE):
                part = batch.slice(lo, WORDS_AT_ONCE)
                total += ((part["c"].to_numpy() + ALPHA) / rest) @ np.expm1(_matrix(part["vector"]) @ h.T)
        yield pa.RecordBatch.from_pydict({"k": pa.array(np.arange(len(h)), pa.int32()), "v": pa.array(total)})

    out = np.ones(len(h))  # all shares, those of words without a vector and of unseen ones included
    for row in vectors.mapInArrow(rows, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():
        out[row["k"]] += row["v"]
    return out


@dataclass
class Fitted:
    """The model: head, class probabilities, contexts h with log10 normalisers, and all words' counts and vectors."""

    head: Head
    classes: ClassLogs
    h: np.ndarray
    norm: np.ndarray
    counts: DataFrame
    vectors: DataFrame


def fit(training: DataFrame, size: int = HEAD) -> Fitted:
    context = training.sparkSession.sparkContext
    counts = checkpointed(training.mapInArrow(_count_rows, "name long, c long").groupBy("name").agg(F.sum("c").alias("c")))
    head = head_of(counts, size)
    shared = context.broadcast(head)
    trigrams = training.mapInArrow(_trigram_rows(shared), "code int, n long").groupBy("code").agg(F.sum("n").alias("n"))
    part = F.pmod(F.xxhash64("code"), F.lit(PARTS)).cast("int")
    trigrams = checkpointed(trigrams.withColumn("part", part).repartition(PARTS, "part").sortWithinPartitions("part", "code"))
    model, _ = train(trigrams)
    one, two = F.floor(F.col("code") / KINDS) % KINDS, F.floor(F.col("code") / KINDS**2)
    often = np.full(2 * KINDS, 1e-3)
    for row in trigrams.where(F.col("code") % KINDS == SHARED).groupBy(
        F.when(one == SHARED, KINDS + two).otherwise(one).alias("k")
    ).agg(F.sum("n").alias("n")).collect():
        often[row["k"]] += row["n"]
    share = often / often.sum()
    h = whitened(model.word_contexts(), share)
    # summed by word and context first, so that a common word brings each context once to the task that fits its vector
    words = training.mapInArrow(_word_rows(shared), "name long, context short, n int").groupBy("name", "context").agg(F.sum("n").alias("n"))
    words = words.repartition(shuffle_partitions(training.sparkSession), "name").sortWithinPartitions("name", "context")
    vectors = checkpointed(words.mapInArrow(_vector_rows(shared, h, share), "name long, c long, vector array<float>"))
    head.vectors = np.zeros((len(head.names), WIDTH + 1), np.float32)
    if len(head.names):
        told = vectors.where(F.col("c") >= int(head.counts.min())).toArrow()
        at, hit = head.find(unsigned(told["name"]))
        head.vectors[at[hit]] = _matrix(told["vector"].combine_chunks())[hit]
    return Fitted(head, model.classes(), h, np.log10(normalisers(vectors, h, head)), counts, vectors)


def _score_rows(fitted):
    """A row of each document's sums over the words of the head, and one of each other word and its context."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, logs, h, norm = fitted.value
        whole, rest = head.log_whole(), head.log_rest()
        for block in blocks(batches, "text"):
            name, row, bounds = _tokens(block["text"])
            at, held = head.find(name)
            kind = head.kinds_of(name)
            one, two = contexts(kind, bounds)
            count = np.where(held, head.counts[at] if len(head.names) else 0, 0)
            base = np.where(held, np.log10(count + ALPHA) - whole, 0.0)
            model = logs.log10(two, one, kind)
            own = np.flatnonzero(held & (kind == SHARED))
            context = word_context(one, two)
            for lo in range(0, len(own), 1 << 16):
                part = own[lo : lo + (1 << 16)]
                model[part] += np.log10(count[part] + ALPHA) - rest + np.einsum(
                    "nd,nd->n",
                    head.vectors[at[part]],
                    h[context[part]]
                ) / math.log(10) - norm[context[part]]
            rows_, uid = block.num_rows, block["uid"].to_numpy()
            sums = lambda x: np.bincount(row, weights=x, minlength=rows_)  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays(
                [pa.array(uid), pa.array(uid), block["doc_id"], pa.nulls(rows_, pa.int16()), pa.array(np.ones(rows_, np.int32)), pa.array(np.diff(bounds)), pa.array(sums(held).astype(np.int64)), pa.array(sums(base)), pa.array(sums(model))],
                names=["uid", "name", "doc_id", "context", "n", "n_tokens", "n_known", "base", "model"],
            )
            lone = np.flatnonzero(~held & (kind == SHARED))
            order = lone[np.lexsort((context[lone], name[lone], row[lone]))]
            new = np.ones(len(order), bool)
            if len(order):
                new[1:] = (row[order[1:]] != row[order[:-1]]) | (name[order[1:]] != name[order[:-1]]) | (
                    context[order[1:]] != context[order[:-1]]
                )
            starts = np.flatnonzero(new)
            first, n = order[starts], np.diff(np.append(starts, len(order)))
            none = np.zeros(len(first))
            yield pa.RecordBatch.from_arrays(
                [pa.array(uid[row[first]]), signed(name[first]), block["doc_id"].take(pa.array(row[first])), pa.array(context[first].astype(np.int16)), pa.array(n.astype(np.int32)), pa.array(none.astype(np.int64)), pa.array(none.astype(np.int64)), pa.array(none), pa.array(none)],
                names=["uid", "name", "doc_id", "context", "n", "n_tokens", "n_known", "base", "model"],
            )

    return rows


ROW = "uid long, doc_id long, n_rows long, n_tokens long, n_known long, base double, model double"


def _joined_rows(fitted):
    """The sums of each row: those of documents as they are, those of other words by their count and vector."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, _, h, norm = fitted.value
        whole, rest = head.log_whole(), head.log_rest()
        for batch in batches:
            context = batch["context"].fill_null(-1).to_numpy()
            word, n = context >= 0, batch["n"].to_numpy()
            count = batch["c"].fill_null(0).to_numpy()
            smoothed = np.log10(count + ALPHA)
            own = np.zeros(len(n))
            vector = np.flatnonzero(word & batch["vector"].is_valid().to_numpy(zero_copy_only=False))
            if len(vector):
                own[vector] = np.einsum("nd,nd->n", _matrix(batch["vector"].take(pa.array(vector))), h[context[vector]]) / math.log(10)
            base = np.where(word, n * (smoothed - whole), batch["base"].to_numpy())
            # the documents' rows hold the class of every token already
            model = np.where(word, n * (smoothed - rest + own - norm[np.maximum(context, 0)]), batch["model"].to_numpy())
            known = np.where(word, np.where(count > 0, n, 0), batch["n_known"].to_numpy())
            yield pa.RecordBatch.from_arrays(
                [
                    batch["uid"],
                    batch["doc_id"],
                    pa.array((~word).astype(np.int64)),
                    batch["n_tokens"],
                    pa.array(known),
                    pa.array(base),
                    pa.array(model)
                ],
                names=["uid", "doc_id", "n_rows", "n_tokens", "n_known", "base", "model"]
            )

    return rows


def lm_scores(docs: DataFrame, classes_head: int = HEAD) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each document.

    Learns from documents whose crc32(doc_id) mod 10 is not 0. Scores are log10 probabilities.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out_of_training = held_out(10, 0)
    model = fit(docs.where(~out_of_training).select("text"), classes_head)
    return scores(docs, model).select(
        "doc_id",
        out_of_training.alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model.head.total).cast("long").alias("train_tokens"),
        "base_score",
        "score"
    )


def scores(docs: DataFrame, model: Fitted) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score of each row; equal rows are summed once and told as often as they are there."""
    shared = docs.sparkSession.sparkContext.broadcast((model.head, model.classes, model.h, model.norm))
    rows = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("uid"))
    told = rows.mapInArrow(
        _score_rows(shared),
        "uid long, name long, doc_id long, context short, n int, n_tokens long, n_known long, base double, model double"
    )
    words = model.counts.join(model.vectors.select("name", "vector"), "name", "left")
    told = told.join(words, "name", "left").mapInArrow(_joined_rows(shared), ROW)
    told = told.groupBy("doc_id", "uid").agg(*[F.sum(c).alias(c) for c in ("n_rows", "n_tokens", "n_known", "base", "model")])
    each = lambda c: F.col(c) / F.col("n_rows")
    told = told.select(
        "doc_id",
        each("n_tokens").cast("long").alias("n_tokens"),
        each("n_known").cast("long").alias("n_known"),
        each("base").alias("base_score"),
        each("model").alias("score"),
        F.explode(F.sequence(F.lit(1), F.col("n_rows")))
    )
    return told.drop("col")
