"""Mixing sources to target weights.

Method: a classifier fitted on labelled rows gives every document a posterior over the
domains (soft membership). Its evidence is the document's words, by a multinomial, and the
source that the row declares, taken to be right with probability ``TRUST``; a row that
declares none is judged by its words. Projected-gradient least squares then fits a
nonnegative rate per document so that the expected tokens of each domain,

    sum over documents of rate * tokens * posterior,

match the target totals. The objective is the squared miss of the totals, each relative to
the larger of its target and its present total, plus
``RIDGE`` times the token-weighted mean squared distance of the rates from 1. Each round
is one distributed aggregation to as many numbers as there are domains; the rates
themselves never leave the cluster. A rate is the expected number of copies of its
document: the whole part always, one more by a hash of the document with the rest as
probability. The registered query and the pipeline mix the values of ``source`` to
``EQUAL`` shares of the tokens; ``mix_report`` gives tokens before, after and aimed at.

The classifier is fitted on at most ``SAMPLE_ROWS`` labelled rows of at most
``SAMPLE_BYTES`` each, the first by a hash of doc_id and text; totals, posteriors and rates cover
every document. At most ``MOST_DOMAINS`` labels are domains, those with most rows; the
others share ``OTHERS`` domains by a hash, so that no label is without one and nothing
that grows with the number of labels is gathered.

Rounds end when every domain is within ``MISS`` of its target. Targets that no rates reach
(posteriors that hardly differ) end with the least squares once a round no longer gains;
that is told as a warning, and each row shows what its domain misses.

Results by case: a null or word-less text has 0 tokens, the prior as posterior and rate 1;
a null label is not learned from but its row is mixed by its words; repeated rows have equal rates;
a label that the sample missed is a domain all the same; a table without the label's column is one without labels;
further columns stay; an empty table, or one without labels, is returned as it is, with
rate 1.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import Words, blocks, lists
from .graph import checkpointed, sampled, spare

SAMPLE_ROWS = 4000
SAMPLE_BYTES = 16_384
VOCABULARY = 20_000
#: Bytes of the sampled texts whose words the driver holds at a time.
TEXT_BYTES = 1 << 18
#: A declared source is taken to be right this often.
TRUST = 0.995
MOST_DOMAINS, OTHERS = 512, 16
#: Rounds end at the latest after so many; a round that lowers the squared miss by less than GAIN of it is the last.
ROUNDS, GAIN = 200, 1e-3
SMOOTHING = 0.7
RIDGE = 1e-4
#: Rounds end when every domain that can reach its target is this near to it.
MISS = 0.002
#: Words count less than independent evidence would; how much less is chosen by these on a part of the sample.
TEMPERS = (0.003, 0.01, 0.03, 0.1, 0.3, 1.0)
#: As targets: every domain has the same share of the tokens.
EQUAL = "equal"


@dataclass
class Classifier:
    domains: list[str]
    names: np.ndarray  # sorted word fingerprints
    weights: np.ndarray  # words x domains, log
    prior: np.ndarray  # log
    temper: float = 0.1

    def evidence(self, words: Words) -> np.ndarray:
        """Log probability of each row's words in each domain."""
        score = np.zeros((words.rows, len(self.domains)))
        if len(self.names) and len(words):
            at = np.minimum(np.searchsorted(self.names, words.name), len(self.names) - 1)
            hit = self.names[at] == words.name
            at, doc = at[hit], words.doc[hit]
            filled = np.unique(doc)
            if len(filled):
                score[filled] = np.add.reduceat(self.weights[at], np.searchsorted(doc, filled), axis=0)
        return score

    def posterior(self, words: Words, declared: np.ndarray) -> np.ndarray:
        """Shares of each row by its words and by the place of the domain that it declares, -1 for none."""
        score = self.temper * self.evidence(words) + self.prior
        known = np.flatnonzero(declared >= 0)
        if len(self.domains) > 1:
            score[known, declared[known]] += np.log(TRUST / (1 - TRUST) * (len(self.domains) - 1))
        return _shares(score)


def _shares(score: np.ndarray) -> np.ndarray:
    score = np.exp(score - score.max(axis=1, keepdims=True)) if score.shape[1] else score
    return score / score.sum(axis=1, keepdims=True)


def _summed(name: np.ndarray, label: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each (name, label) once, sorted, with the sum of its ``n``."""
    order = np.lexsort((label, name))
    name, label = name[order], label[order]
    starts = np.flatnonzero(np.append(True, (name[1:] != name[:-1]) | (label[1:] != label[:-1])))[: len(name)]
    return name[starts], label[starts], np.add.reduceat(n[order], starts) if len(starts) else n[:0]


def _text_blocks(texts: pa.Array) -> Iterator[Words]:
    for block in blocks([pa.RecordBatch.from_arrays([texts], names=["text"])], "text", TEXT_BYTES):
        yield Words(block["text"], lower=True)


def word_counts(texts: pa.Array, label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(name, label, count) of the words of each label; words are in memory for a block of the texts at a time."""
    told, at = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))], 0
    for words in _text_blocks(texts):
        told.append(_summed(words.name, label[at + words.doc], np.ones(len(words), np.int64)))
        at += words.rows
    return _summed(*(np.concatenate(x) for x in zip(*told, strict=True)))


def train(
    counted: tuple[np.ndarray, np.ndarray, np.ndarray], rows: dict[str, int], vocabulary: int = VOCABULARY
) -> Classifier:
    """Smoothed log word probabilities of each domain over the most frequent words.

    ``rows`` has how many rows each domain has in all; labels are the places of the sorted domains.
    """
    domains = sorted(rows)
    name, label, n = counted
    names, back = np.unique(name, return_inverse=True)
    counts = np.bincount(back, weights=n, minlength=len(names)).astype(np.int64)
    chosen = np.sort(np.argsort(-counts, kind="stable")[:vocabulary])
    place = np.full(len(names), -1)
    place[chosen] = np.arange(len(chosen))
    at = place[back]
    table = np.zeros((len(chosen), len(domains)))
    table[at[at >= 0], label[at >= 0]] = n[at >= 0]
    table += 0.5
    share = np.array([rows[x] for x in domains]) + 1.0
    return Classifier(domains, names[chosen], np.log(table / table.sum(axis=0)), np.log(share / share.sum()))


def calibrated(texts: pa.Array, labels: list[str], rows: dict[str, int]) -> Classifier:
    """A classifier of all the texts, whose temper suits every fifth of them best when they are left out."""
    number = {x: k for k, x in enumerate(sorted(rows))}
    label, left = np.array([number[x] for x in labels], np.int64), np.arange(len(texts)) % 5 == 0
    rest, own = (word_counts(texts.filter(pa.array(x)), label[x]) for x in (~left, left))
    model = train(_summed(*(np.concatenate(x) for x in zip(rest, own, strict=True))), rows)
    if model.domains and len(texts):
        without = train(rest, rows)
        evidence = np.concatenate([without.evidence(words) for words in _text_blocks(texts.filter(pa.array(left)))])
        own = label[left]
        model.temper = max(TEMPERS, key=lambda t: np.log(_shares(t * evidence + without.prior)[np.arange(len(own)), own] + 1e-300).sum())
    return model


def _posterior_rows(model, passed: list[str]):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Classifier = model.value
        for block in blocks(batches, "text"):
            words = Words(block["text"], lower=True)
            declared = pc.index_in(block["label"], pa.array(own.domains, pa.string())).fill_null(-1).to_numpy(zero_copy_only=False)
            score = own.posterior(words, declared)
            columns = {c: block[c] for c in passed}
            bounds = np.arange(words.rows + 1) * len(own.domains)
            yield pa.RecordBatch.from_pydict(
                columns | {"n_tokens": pa.array(np.diff(words.bounds)), "posterior": lists(pa.array(score.ravel()), bounds)}
            )

    return rows


def label_of(docs: DataFrame, label: str) -> Column:
    """The label as a string; null where ``docs`` has no such column."""
    return F.col(label).cast("string") if label in docs.columns else F.lit(None).cast("string")


def domain_of(docs: DataFrame, label: str, domains: list[str]) -> Column:
    """The domain that a row declares: its label, or for one that is no domain, one of the shared ones."""
    told = label_of(docs, label)
    other = F.concat(F.lit(OTHER), F.pmod(F.xxhash64(told), F.lit(OTHERS)).cast("string"))
    return F.when(told.isin(domains) | told.isNull(), told).otherwise(other) if any(d.startswith(OTHER) for d in domains) else told


#: How the shared domains' names begin.
OTHER = "other labels "


def fit(docs: DataFrame, label: str = "lang", rows: int = SAMPLE_ROWS, most: int | None = None) -> Classifier:
    """The classifier, fitted on at most ``rows`` rows with a label."""
    most = MOST_DOMAINS if most is None else most
    told = docs.select("doc_id", "text", label_of(docs, label).alias("label")).where("label is not null")
    short = F.col("text").isNotNull() & (F.octet_length("text") <= SAMPLE_BYTES)
    counts = told.groupBy("label").agg(F.count("*").alias("n"))
    first = counts.orderBy(F.desc("n"), "label").limit(most + 1).collect()
    domains = [r["label"] for r in first][: most if len(first) <= most else most - OTHERS]
    if len(first) > most:
        domains += [f"{OTHER}{k}" for k in range(OTHERS)]
    told = told.withColumn("label", domain_of(told, "label", domains))
    held = {
        r["label"]: (r["n"], r["eligible"]) for r in told.groupBy("label").agg(
            F.count("*").alias("n"),
            F.count_if(short).alias("eligible")
        ).collect()
    }
    told = sampled(told.where(short), rows, sum(eligible for _, eligible in held.values()), 3).toArrow()
    return calibrated(told["text"].combine_chunks(), told["label"].to_pylist(), {d: held.get(d, (0, 0))[0] for d in domains})


def posteriors(docs: DataFrame, model: Classifier, label: str = "lang") -> DataFrame:
    """doc_id, print of the text, label (the domain declared), n_tokens and posterior of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    declared = domain_of(docs, label, model.domains)
    told = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64("text").alias("x"),
        declared.alias("label"),
        F.col("text").cast("string").alias("text")
    )
    return told.mapInArrow(
        _posterior_rows(shared, ["doc_id", "x", "label"]),
        "doc_id long, x long, label string, n_tokens long, posterior array<double>"
    )


def rates_after(posterior: np.ndarray, tokens: np.ndarray, pulls: np.ndarray, step: float, ridge: float) -> np.ndarray:
    """The rates that projected gradient steps from 1 reach; each pull is the relative miss of the totals."""
    rate = np.ones(len(posterior))
    for pull in pulls:
        rate = np.maximum(0.0, rate - step * (posterior @ pull + ridge * (rate - 1.0)))
    return np.where(tokens > 0, rate, 1.0)


def _matrix(batch: pa.RecordBatch, domains: int) -> tuple[np.ndarray, np.ndarray]:
    return batch["posterior"].flatten().to_numpy().reshape(-1, domains), batch["n_tokens"].to_numpy()


def _totals(told: DataFrame, domains: int, pulls: np.ndarray, step: float, ridge: float, moments: bool = False) -> np.ndarray:
    """Expected tokens of each domain after the given steps, or their second moments."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(domains * domains if moments else domains)
        for batch in batches:
            posterior, tokens = _matrix(batch, domains)
            weight = tokens * rates_after(posterior, tokens, pulls, step, ridge)
            total += ((posterior * weight[:, None]).T @ posterior).ravel() if moments else weight @ posterior
        yield pa.RecordBatch.from_pydict({"k": pa.array(np.arange(len(total)), pa.int32()), "v": pa.array(total)})

    said = told.select("posterior", "n_tokens").mapInArrow(rows, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(domains * domains if moments else domains)
    for row in said:
        out[row["k"]] = row["v"]
    return out


def fit_rates(
    told: DataFrame, domains: int, targets: np.ndarray | None, rounds: int = ROUNDS, ridge: float = RIDGE
) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(``told`` with ``rate``, totals before, totals after) for target shares of the tokens.

    ``told`` has n_tokens and posterior. The goal is ``targets`` times all tokens; without
    targets, the present shares to the power SMOOTHING.
    """
    none = np.zeros((0, domains))
    before = _totals(told, domains, none, 0.0, ridge) if domains else none.sum(axis=1)
    total = before.sum()
    if not total:
        return told.withColumn("rate", F.lit(1.0)), before, before
    goal = goal_of(targets, before)
    scale = np.maximum(goal, before) / total
    scale[scale == 0] = 1.0
    spread = _totals(told, domains, none, 0.0, ridge, moments=True).reshape(domains, domains) / total / np.sqrt(np.outer(scale, scale))
    step = 1.0 / (float(np.linalg.eigvalsh(spread)[-1]) + ridge)
    pulls, now, last = none, before, np.inf
    for _ in range(rounds):
        pull = (now - goal) / total / scale
        missed = np.abs(now - goal) > MISS * goal
        gained, last = last - pull @ pull, pull @ pull
        if not missed[before > 0].any() or gained < GAIN * last:
            break
        pulls = np.vstack([pulls, np.round(pull, 12)])
        now = _totals(told, domains, pulls, step, ridge)
    missed = (np.abs(now - goal) > MISS * goal) & (before > 0)
    if missed.any():
        warnings.warn(
            f"{int(missed.sum())} of {domains} domains miss their targets, by {np.abs(now - goal)[missed].sum() / total:.2%} of the tokens",
            stacklevel=2
        )

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                posterior, tokens = _matrix(batch, domains)
                yield batch.append_column("rate", pa.array(rates_after(posterior, tokens, pulls, step, ridge)))

    return told.mapInArrow(rows, "doc_id long, x long, label string, n_tokens long, posterior array<double>, rate double"), before, now


def goal_of(targets: np.ndarray | None, before: np.ndarray) -> np.ndarray:
    """The tokens aimed at in each domain; together all tokens, a whole number."""
    if not before.sum():
        return before
    share = (before / before.sum()) ** SMOOTHING if targets is None else targets
    return share / share.sum() * np.rint(before.sum())


def copies_of(rate: str, *key: str) -> Column:
    """Whole copies of a row: the rate rounded up or down by a hash of the key."""
    chance = F.pmod(F.xxhash64(*key, F.lit(17)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return (F.floor(rate) + F.when(chance < F.col(rate) - F.floor(rate), 1).otherwise(0)).cast("int")


def shares_of(targets: dict[str, float] | str | None, domains: list[str]) -> np.ndarray | None:
    if targets == EQUAL:
        return np.ones(len(domains)) / max(1, len(domains))
    return None if targets is None else np.array([targets.get(x, 0.0) for x in domains])


def mixed_rates(
    docs: DataFrame, targets: dict[str, float] | str | None = None, label: str = "lang", model: Classifier | None = None
) -> tuple[DataFrame, Classifier, np.ndarray, np.ndarray]:
    """(doc_id, x, label, n_tokens, posterior, rate, copies; classifier; totals before; totals after).

    ``targets`` gives each domain's share of the tokens, or is EQUAL; by default the shares are smoothed.
    """
    model = model or fit(docs, label)
    told = checkpointed(posteriors(docs, model, label))
    rated, before, after = fit_rates(told, len(model.domains), shares_of(targets, model.domains))
    return rated.withColumn("copies", copies_of("rate", "doc_id", "x")), model, before, after


def mix_report(docs: DataFrame, targets: dict[str, float] | str, label: str = "lang") -> DataFrame:
    """label, before, after, target: tokens of the rows of each label, at rate 1, at their rates, at their copies, and as aimed at.

    Rows are counted by their own label, not by what their words say; the target is of the
    tokens of all rows, also those without a label.
    """
    rated, model, before, _ = mixed_rates(docs, targets, label)
    goals = dict(zip(model.domains, goal_of(shares_of(targets, model.domains), before).tolist(), strict=True)) if before.sum() else {}
    goal = F.create_map(*[F.lit(x) for pair in goals.items() for x in pair])[F.col("label")] if goals else F.lit(None).cast("double")
    told = rated.groupBy("label").agg(
        F.sum("n_tokens").alias("before"),
        F.sum(F.col("n_tokens") * F.col("rate")).alias("after"),
        F.sum(F.col("n_tokens") * F.col("copies")).alias("copied")
    )
    return told.withColumn("target", goal)


def mix_rates(docs: DataFrame, targets: dict[str, float] | str | None = None, label: str = "lang") -> DataFrame:
    """doc_id, n_tokens, domain (most likely), membership (its posterior), rate, copies for each document;
    and of the domain, the tokens before, aimed at and expected after."""
    rated, model, before, after = mixed_rates(docs, targets, label)
    names = F.array(*[F.lit(x) for x in model.domains]) if model.domains else F.array(F.lit(None).cast("string"))
    best = F.array_max("posterior")
    at = (F.array_position("posterior", best) - 1).cast("int")
    goal = goal_of(shares_of(targets, model.domains), before)
    told = {"domain_tokens": before, "domain_target": goal, "domain_expected": after}
    told = [
        F.get(
            F.array(*[F.lit(float(x)) for x in v]) if len(v) else F.array(F.lit(None).cast("double")),
            at
        ).alias(k) for k, v in told.items()
    ]
    return rated.select("doc_id", "n_tokens", F.get(names, at).alias("domain"), best.alias("membership"), "rate", "copies", *told)


def mixed(docs: DataFrame, targets: dict[str, float] | str | None = None, label: str = "lang") -> DataFrame:
    """``docs`` with each row as often as its rate says; all columns stay."""
    rated, model, _, _ = mixed_rates(docs, targets, label)
    # equal documents have equal rates, so one row a (doc_id, text print, label) is enough
    own, x, label_, n = spare(docs, "id", "x", "label", "copies")
    declared = domain_of(docs, label, model.domains)
    copies = rated.groupBy(F.col("doc_id").alias(own), F.col("x").alias(x), F.col("label").alias(label_)).agg(F.max("copies").alias(n))
    joined = docs.join(
        copies,
        docs["doc_id"].cast("long").eqNullSafe(copies[own]) & (F.xxhash64(docs["text"]) == copies[x]) & declared.eqNullSafe(copies[label_]),
        "left"
    )
    return joined.withColumn(
        own,
        F.explode(F.array_repeat(F.lit(0), F.coalesce(copies[n], F.lit(1))))
    ).select(*[docs[c] for c in docs.columns])
