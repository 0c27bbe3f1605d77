"""Phrases sought in numbered words: arrays in, arrays out."""

from __future__ import annotations

import numpy as np


class Phrases:
    """Phrases as a tree of words: an edge is a node and a word, as one number; ``ends`` is the phrase that ends at a node."""

    def __init__(self, ids: list[int], texts: list[str]):
        self.words: dict[str, int] = {}
        edges: dict[tuple[int, int], int] = {}
        ends: dict[int, int] = {}
        nodes = 1
        for number, text in zip(ids, texts, strict=True):
            node = 0
            for word in text.split(" "):
                edge = (node, self.words.setdefault(word, len(self.words)))
                if edge not in edges:
                    edges[edge] = nodes
                    nodes += 1
                node = edges[edge]
            ends[node] = number
        self.width = max(1, len(self.words))
        names = np.array([a * self.width + b for a, b in edges], np.int64)
        order = np.argsort(names)
        self.names, self.nodes = names[order], np.array(list(edges.values()), np.int64)[order]
        self.ends = np.full(nodes, -1, np.int64)
        self.ends[list(ends)] = list(ends.values())

    def found(self, words: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, phrase, first word) of every place where a phrase stands; ``words`` are numbers of words (-1: another),
        ``row`` their documents."""
        at, depth, rows, ids, starts = np.flatnonzero(words >= 0), 0, [], [], []
        node = np.zeros(len(at), np.int64)
        while len(at) and len(self.names):
            name = node * self.width + words[at + depth]
            place = np.minimum(np.searchsorted(self.names, name), len(self.names) - 1)
            good = self.names[place] == name
            at, node = at[good], self.nodes[place[good]]
            whole = self.ends[node] >= 0
            rows.append(row[at[whole]])
            ids.append(self.ends[node[whole]])
            starts.append(at[whole])
            depth += 1
            good = at + depth < len(words)
            at, node = at[good], node[good]
            good = (row[at + depth] == row[at]) & (words[at + depth] >= 0)
            at, node = at[good], node[good]
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *rows]), np.concatenate([none, *ids]), np.concatenate([none, *starts])
