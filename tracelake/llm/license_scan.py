"""Search for license notices in whole texts: exact phrases, and short notices with bounded errors.

Texts are read as words (letters a to z, digits and every character beyond ASCII, after A-Z
is lower-cased) with one space between. A notice of some length may differ by a few edits,
its bound. Split into one more piece than that, at least one piece must stand unchanged
(pigeonhole): an automaton finds the pieces of all notices in one pass, each piece names the
place where its notice would begin, and the regex library's bounded-error match verifies
the place and tells its edits and span. Of matches that overlap, the one with fewest edits
stays, then the longest, then the first.

The table of notices is small and fixed, so nothing is shuffled: Spark deals the texts.
A text is read in stretches that overlap by more than the longest notice, so that memory
grows with a few bytes for each byte of the longest text, not with its matches' windows.

Edge cases: a null or empty text has no words, no places, empty labels and score 0. Repeated
rows and ids are scanned each on their own; a null id stays null. An empty table gives no
rows. Further columns are not read, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import blocks
from .graph import texts_of

#: The phrases of the base and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Short notices, as words, by label.
NOTICES = [
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license"),
    ("gpl", "this work is licensed under the gnu general public license version"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license"),
    ("agpl", "under the terms of the gnu affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that"),
    ("bsd", "licensed under the 3 clause bsd license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nd", "licensed under cc by nd 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("proprietary", "all rights reserved"),
]
#: One edit for so many characters of a notice is borne.
CHARACTERS_AN_EDIT = 16
#: A text is searched in stretches of so many bytes.
STRETCH = 1 << 20

_WORD = bytes(b if b >= 0x80 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 0x20 for b in range(256))
SPAN = "array<struct<label:string,notice:int,first_word:long,words:long,edits:int,score:double>>"


class Span(NamedTuple):
    """Characters start to end of a normalised text that match a notice with so many edits."""

    start: int
    end: int
    edits: int
    notice: int


def bound(notice: str) -> int:
    return len(notice) // CHARACTERS_AN_EDIT


def pieces(notice: str) -> list[tuple[int, str]]:
    """(offset, piece) of one more piece than edits are borne."""
    count = bound(notice) + 1
    cuts = [len(notice) * k // count for k in range(count + 1)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def normalised(text: str | None) -> bytes:
    """The words of a text, lower case, with one space between, as UTF-8."""
    return re.sub(rb"  +", b" ", (text or "").encode().translate(_WORD)).strip(b" ")


def phrase_places(said: bytes, phrase: str) -> list[int]:
    """Bytes of a normalised text where the phrase's words stand."""
    return [m.start() for m in re.finditer(rb"(?:(?<=^)|(?<= ))(?=" + phrase.encode() + rb"(?: |$))", said)]


class Scanner:
    """The automaton of all pieces and the verifying patterns of a table of notices."""

    def __init__(self, notices: list[tuple[str, str]] = NOTICES):
        self.notices = notices
        self.automaton, owners = ahocorasick.Automaton(), {}
        for k, (_, notice) in enumerate(notices):
            for offset, piece in pieces(notice):
                owners.setdefault(piece, []).append((k, offset))
        for piece, told in owners.items():
            self.automaton.add_word(piece, (len(piece), told))
        self.automaton.make_automaton()
        self.margin = max(len(n) + 2 * bound(n) for _, n in notices) + 2
        self.patterns = [
            regex.compile(rf"(?b)(?<![^ ])(?:{regex.escape(n, literal_spaces=True)}){{e<={bound(n)}}}(?![^ ])") for _, n in notices
        ]
        self.verified = lru_cache(1 << 12)(self._verified)

    def _verified(self, notice: int, window: str) -> tuple[tuple[int, int, int], ...]:
        """(start, end, edits) of the notice in a window; windows that repeat are matched once."""
        return tuple((m.start(), m.end(), sum(m.fuzzy_counts)) for m in self.patterns[notice].finditer(window))

    def candidates(self, said: str) -> Iterator[tuple[int, int, int]]:
        """(notice, start, end) of the windows in which a piece stands unchanged; near ones are one."""
        begins: dict[int, list[int]] = {}
        for last, (size, owners) in self.automaton.iter(said):
            for notice, offset in owners:
                begins.setdefault(notice, []).append(last + 1 - size - offset)
        for notice, told in begins.items():
            slack, length = bound(self.notices[notice][1]), len(self.notices[notice][1])
            told.sort()
            first = previous = told[0]
            for at in [*told[1:], None]:
                if at is None or at > previous + 2 * slack:
                    yield notice, first - slack, previous + length + slack
                    first = at
                previous = at

    def spans(self, said: str) -> list[Span]:
        """Verified matches that don't overlap, in order."""
        found = set()
        for notice, start, end in self.candidates(said):
            # the window reaches a character further, so that a match ends where a word does
            start, end = max(start - 1, 0), min(end + 1, len(said))
            for a, b, edits in self.verified(notice, said[start:end]):
                if (start + a == 0 or said[start + a - 1] == " ") and (start + b == len(said) or said[start + b] == " "):
                    found.add(Span(start + a, start + b, edits, notice))
        return chosen(found)


def chosen(found: set[Span]) -> list[Span]:
    """The spans that stay where some overlap: fewest edits, then the longest, then the first."""
    out: list[Span] = []
    for run in runs(sorted(found)):
        kept: list[Span] = []
        for s in sorted(run, key=lambda s: (s.edits, s.start - s.end, s.start, s.notice)):
            if all(s.end <= k.start or s.start >= k.end for k in kept):
                kept.append(s)
        out += sorted(kept)
    return out


def runs(spans: list[Span]) -> Iterator[list[Span]]:
    """Spans, in order, cut where one begins behind all before it."""
    held: list[Span] = []
    end = 0
    for s in spans:
        if held and s.start >= end:
            yield held
            held = []
        held.append(s)
        end = max(end, s.end)
    if held:
        yield held


def spans_of(scanner: Scanner, said: bytes) -> Iterator[tuple[int, int, Span]]:
    """(first word, words, span) of a whole normalised text, read in stretches that overlap.

    A match belongs to the stretch in whose first part it begins; the next stretch begins
    at the first space behind that part and behind the matches told.
    """
    at = words = 0
    while at < len(said):
        piece = said[at : at + STRETCH + 4 * scanner.margin]
        if at + len(piece) < len(said):
            piece = piece[: piece.rfind(b" ")] if b" " in piece else said[at : (said.find(b" ", at + len(piece)) + 1 or len(said) + 1) - 1]
        cut = piece.rfind(b" ", 0, max(len(piece) - 4 * scanner.margin, 0)) if at + len(piece) < len(said) else -1
        text = piece.decode()
        limit = len(piece[:cut].decode()) if cut >= 0 else len(text)
        told = [s for s in scanner.spans(text) if s.start < limit]
        for s in told:
            yield words + text.count(" ", 0, s.start), text.count(" ", s.start, s.end) + 1, s
        used = text[: max([limit, *(s.end for s in told)]) + 1]
        words += used.count(" ")
        at += len(used.encode())


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scanner = Scanner()
    for block in blocks(batches, "text"):
        out = []
        for text in block["text"]:
            said = normalised(text.as_py())
            places = sorted((at, PHRASES[p]) for p in PHRASES for at in phrase_places(said, p))
            found = [
                {"label": NOTICES[s.notice][0], "notice": s.notice, "first_word": first, "words": words, "edits": s.edits, "score": 1 - s.edits / (bound(NOTICES[s.notice][1]) + 1)}
                for first, words, s in spans_of(scanner, said)
            ]
            word = lambda at: said.count(b" ", 0, at)  # noqa: B023, E731
            out.append(
                (
                    said.count(b" ") + bool(said),
                    len(places),
                    word(places[0][0]) if places else None,
                    word(places[-1][0]) if places else None,
                    ",".join(sorted({x for _, x in places})),
                    found
                )
            )
        columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int64()] * 4 + [pa.string(), SPANS], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [block["doc_id"], *columns],
            ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "spans"]
        )


SPANS = pa.list_(
    pa.struct(
        [
            ("label", pa.string()),
            ("notice", pa.int32()),
            ("first_word", pa.int64()),
            ("words", pa.int64()),
            ("edits", pa.int32()),
            ("score", pa.float64())
        ]
    )
)


def license_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels and ``spans``: the notices found, with words, edits and score."""
    schema = f"doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, spans {SPAN}"
    return texts_of(docs).mapInArrow(_scanned, schema)


def license_labels(docs: DataFrame) -> DataFrame:
    """The scan with ``labels``, those of the base and of the spans, and ``score``: 1 for a base phrase, else the best span's, else 0."""
    told = license_scan(docs)
    base = F.filter(F.split("base_labels", ","), lambda x: x != "")
    labels = F.array_join(F.array_sort(F.array_union(base, F.transform("spans", lambda s: s["label"]))), ",")
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)))
    return told.withColumn("labels", labels).withColumn("score", score)
