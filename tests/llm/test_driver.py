"""What the pipeline's stages take of the driver: jobs, tasks and memory."""

from __future__ import annotations

import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tracelake.llm import graph, language_crf, mixing


def reached(edges):
    """The smallest node reachable, for each node that reaches a smaller one."""
    least = {x: x for edge in edges for x in edge}
    while True:
        before = dict(least)
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
        if least == before:
            return {x: m for x, m in least.items() if m < x}


STARS = [(k, k // 10 * 10) for k in range(40)]
PICK = random.Random(3)


@pytest.mark.parametrize(
    ("edges", "rounds"),
    [
        ([], 0),
        (STARS, 0),
        ([*STARS, *STARS], 0),
        ([(k, 0) for k in range(1, 300)] + [(k, 1) for k in range(2, 300)], 1),
        ([(k, k + 1) for k in range(60)], None),
        ([(5, 3), (3, 5), (5, 5), (4, 3)], 0),
        ([(PICK.randrange(150), PICK.randrange(150)) for _ in range(120)], None),
    ],
)
def test_components_end_when_edges_are_stars(spark, monkeypatch, edges, rounds):
    made = []
    monkeypatch.setattr(graph, "checkpointed", lambda df, f=graph.checkpointed: made.append(0) or f(df))
    rows = graph.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(rows) == len({r["node"] for r in rows})
    assert {r["node"]: r["component"] for r in rows} == reached(edges)
    assert rounds is None or len(made) == 1 + rounds


def sample(texts, words, size):
    pick = np.random.default_rng(5)
    vocabulary = np.array([f"Word{k}" for k in range(words)])
    return [" ".join(vocabulary[np.minimum(pick.zipf(1.3, size) - 1, words - 1)]) for _ in range(texts)]


def peak_mb(f):
    tracemalloc.start()
    try:
        return f(), tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_words_of_a_sample_are_counted_by_blocks(monkeypatch):
    texts, labels = [*sample(50, 400, 60), "", None, " \n", "One one ONE"], np.arange(54) % 3
    monkeypatch.setattr(mixing, "TEXT_BYTES", 700)
    name, label, n = mixing.word_counts(pa.array(texts), labels)
    wanted = Counter((w.lower(), k) for text, k in zip(texts, labels.tolist(), strict=True) for w in (text or "").split())
    assert sorted(n.tolist()) == sorted(wanted.values())
    assert np.bincount(label, weights=n).tolist() == [sum(c for (_, k), c in wanted.items() if k == x) for x in range(3)]
    assert len(np.unique(name)) == len({w for w, _ in wanted})
    rows = {"a": 5, "b": 6, "c": 7}
    small = mixing.calibrated(pa.array(texts), ["abc"[k] for k in labels], rows)
    monkeypatch.setattr(mixing, "TEXT_BYTES", 1 << 30)
    whole = mixing.calibrated(pa.array(texts), ["abc"[k] for k in labels], rows)
    assert (small.names == whole.names).all() and (small.weights == whole.weights).all() and small.temper == whole.temper


def test_a_mixing_sample_takes_little_memory():
    texts = sample(4000, 30_000, 350)
    _, mb = peak_mb(lambda: mixing.calibrated(pa.array(texts), ["ab"[k % 2] for k in range(4000)], {"a": 1, "b": 1}))
    assert mb < 60


def test_a_field_is_the_same_for_any_blocks_and_takes_little_memory(monkeypatch):
    texts = [*sample(200, 3000, 80), None, "", "123"]
    labels = ["xy"[k % 2] for k in range(len(texts))]
    monkeypatch.setattr(language_crf, "TEXT_BYTES", 1 << 30)
    whole = language_crf.train(pa.array(texts), labels, rounds=5)
    monkeypatch.setattr(language_crf, "TEXT_BYTES", 900)
    small = language_crf.train(pa.array(texts), labels, rounds=5)
    assert (small.weights == whole.weights).all() and (small.transitions == whole.transitions).all()
    monkeypatch.undo()
    texts = sample(3000, 8000, 350)
    _, mb = peak_mb(lambda: language_crf.train(pa.array(texts), ["xy"[k % 2] for k in range(3000)], rounds=2))
    assert mb < 70
