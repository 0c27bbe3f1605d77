"""Plain, slow versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text, lower=False):
    raw = (text or "").encode()
    return WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), raw) if lower else raw)


class Groups(dict):
    def find(self, x):
        while self.setdefault(x, x) != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self[max(a, b)] = min(a, b)


def shingles(text, width):
    w = words(text, True)
    return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def ngram_components(docs, width=3, part=90, whole=100):
    sets = {i: shingles(t, width) for i, t in docs}
    groups = Groups()
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and whole * len(sets[a] & sets[b]) >= part * len(sets[a] | sets[b]):
                groups.join(a, b)
    return {i: (len(sets[i]), groups.find(i)) for i in sets}


def word_windows(docs, width=13):
    first, out = {}, {}
    for i, t in sorted(docs):
        w = words(t)
        for k in range(len(w) - width + 1):
            first.setdefault(tuple(w[k : k + width]), i)
    for i, t in docs:
        w, gone = words(t), set()
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] < i:
                gone |= set(range(k, k + width))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    return out


def byte_windows(docs, width=100):
    seen, out = set(), {}
    for i, t in sorted(docs):
        raw, gone = (t or "").encode(), set()
        for k in range(len(raw) - width + 1):
            if raw[k : k + width] in seen:
                gone |= set(range(k, k + width))
            seen.add(raw[k : k + width])
        kept = bytes(x for k, x in enumerate(raw) if k not in gone)
        runs = sum(1 for k in gone if k - 1 not in gone)
        out[i] = (len(raw), len(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def unigram(docs):
    tokens = {i: [*words(t, True), None] for i, t in docs}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in tokens}
    count = Counter(w for i, x in tokens.items() if not held[i] for w in x)
    total, kinds = sum(count.values()), len(count)
    scale = math.log10(total + 0.1 * (kinds + 1))
    return {
        i: (
            held[i],
            len(x),
            sum(count[w] > 0 for w in x),
            total,
            sum(math.log10(count[w] + 0.1) - scale for w in x)
        ) for i, x in tokens.items()
    }
