"""Licence notices against plain word positions and edit distances."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from tracelake.llm import license_scan as L

SCHEMA = "doc_id long, text string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def base(text):
    w = words(text)
    places = sorted(
        (k, label) for phrase, label in L.PHRASES.items() for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()
    )
    return len(w), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(
        sorted({x for _, x in places})
    )


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def check(got, texts):
    for r in got:
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == base(texts[r["doc_id"]])
        w = words(texts[r["doc_id"]])
        for s in r["spans"]:
            assert distance(
                L.NOTICES[s["notice"]][1],
                " ".join(w[s["first_word"] : s["first_word"] + s["words"]])
            ) == s["edits"] <= L.bound(L.NOTICES[s["notice"]][1])
        assert r["labels"] == ",".join(sorted(set(filter(None, r["base_labels"].split(","))) | {s["label"] for s in r["spans"]}))
        assert r["score"] == (1.0 if r["n_base"] else max([s["score"] for s in r["spans"]], default=0.0))


def test_given_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = L.license_labels(table).collect()
    check(got, {r["doc_id"]: r["text"] for r in table.collect()})
    clean = {r["doc_id"] for r in table.where(~F.lower("text").rlike("licen|copyright|rights")).collect()}
    assert not [r for r in got if r["doc_id"] in clean and r["labels"]] and [r for r in got if r["spans"]]


def test_odd_texts(spark):
    texts = {
        1: None, 2: "", 3: "MIT License", 4: "mit  license, MIT-LICENSE; summit license mit licenses", 5: "the GNU general\npublic license mit license apache license",
        6: "ümit license mit license", 7: "\x00mit\x7flicense", 8: "mit licenſe", 9: "x " * 50000 + "apache license", 10: "MIT LICENSE " * 3000, 11: "permission is hereby granted free of charge",
    }
    rows = [*texts.items(), (3, texts[3]), (None, "MIT License")]
    table = spark.createDataFrame(rows, SCHEMA).withColumn("labels", F.lit(1)).withColumn("score", F.lit("x"))
    got = L.license_labels(table).collect()
    assert len(got) == len(rows) and sum(r["doc_id"] is None for r in got) == 1
    check(got, texts | {None: "MIT License"})
    assert L.license_labels(spark.createDataFrame([], SCHEMA)).count() == 0


def noisy(rng, notice, edits):
    out = list(notice)
    for at in sorted(rng.sample(range(2, len(out) - 2), edits), reverse=True):
        kind = rng.randrange(3)
        out[at : at + 1] = ["q"] if kind == 0 else [] if kind == 1 else [out[at], "q"]
    return "".join(out)


def test_every_notice_within_its_bound_is_found():
    rng, scanner = random.Random(4), L.Scanner()
    for label, notice in L.NOTICES:
        for edits in range(L.bound(notice) + 1):
            changed = noisy(rng, notice, edits)
            said = f"lorem ipsum {changed} dolor sit"
            found = [(first, s) for first, _, s in L.spans_of(scanner, L.normalised(said))]
            near = [k for k, (_, other) in enumerate(L.NOTICES) if distance(other, changed) <= L.bound(other)]
            assert [first for first, _ in found] == [2], (label, changed, found)
            assert found[0][1].notice in near and found[0][1].edits <= edits
        far = noisy(rng, notice, min(3 * L.bound(notice) + 4, len(notice) // 2))
        if all(distance(other, far) > L.bound(other) for _, other in L.NOTICES):
            assert label not in {L.NOTICES[s.notice][0] for s in scanner.spans(f"a {far} b") if L.NOTICES[s.notice][1] == notice}


@pytest.mark.parametrize("stretch", [150, 400])
def test_stretches_change_nothing(monkeypatch, stretch):
    rng, scanner = random.Random(9), L.Scanner()
    said = " ".join(
        noisy(
            rng,
            n,
            rng.randrange(L.bound(n) + 1)
        ) if rng.random() < 0.6 else "é" * rng.randrange(1, 30) for _ in range(20) for _, n in L.NOTICES
    )
    whole = list(L.spans_of(scanner, said.encode()))
    monkeypatch.setattr(L, "STRETCH", stretch)
    pieces = list(L.spans_of(scanner, said.encode()))
    assert [(w, n, s.notice, s.edits) for w, n, s in pieces] == [(w, n, s.notice, s.edits) for w, n, s in whole] and len(whole) > 100
