"""SentencePiece encoding and decoding by suffix-array matching.

Method: the distinct stretches of a block of texts are concatenated and indexed by a
suffix array; a binary search finds the range of occurrences of every piece of the
vocabulary at once. The occurrences are the edges of a lattice over the text; sorted by
the position where they end, they are relaxed in one sweep. For a BPE vocabulary an edge
wins exactly if its piece may follow the last piece of the best path to its start, that
is if merging the two in order of score gives the two again; of the edges that end at a
place exactly one does, and the sweep yields the same ids as merging step by step.

Characters that no piece holds fall back to byte pieces. Stretches are cut wherever two
neighbouring bytes stand side by side in no piece, as no merge crosses such a place.
A space and U+2581 are the same symbol, as in the format; decoding gives a space.

Results by case: a null text stays null with 0 tokens and no ids; an empty text has no ids
and decodes to itself; texts of any length are one sequence; repeated rows each get a row;
a null doc_id stays null; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import K3, blocks, lists, mix, range_hashes, text_buffers

SPACE = 0xFF  # stands for U+2581; no UTF-8 text holds this byte
_MARK = "▁".encode()
_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * K3)
#: Bytes of text indexed at a time; an index takes about a hundred bytes for each.
BLOCK = 1 << 20


def model_file() -> str:
    """The default vocabulary of the machine; every worker has it in the same place."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _to_bytes(piece: str) -> bytes:
    return piece.encode().replace(_MARK, bytes([SPACE]))


@dataclass
class Vocabulary:
    """Pieces as arrays. Ids from ``size`` on stand for an unknown character of 1 to 4 bytes."""

    size: int
    text: list[bytes]
    length: np.ndarray
    rank: np.ndarray  # by score, 0 first; -1 for what no merge makes
    left: np.ndarray
    right: np.ndarray
    pair_key: np.ndarray  # sorted (left, right) of every way to join two pieces to one
    pair_rank: np.ndarray
    byte_id: np.ndarray
    order: np.ndarray  # pieces that an encoding may hold, sorted by their bytes
    adjacent: np.ndarray  # 256 x 256: whether some piece holds the two bytes side by side

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.vocab_size()
        text, score, byte_id = [], np.zeros(size), np.zeros(256, np.int64)
        plain = np.zeros(size, bool)
        for i in range(size):
            piece = model.id_to_piece(i)
            score[i] = model.get_score(i)
            if model.is_byte(i):
                byte_id[int(piece[1:-1], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                plain[i] = True
            text.append(_to_bytes(piece) if plain[i] else b"")
        return cls.build(text, score, plain, byte_id)

    @classmethod
    def build(cls, text: list[bytes], score: np.ndarray, plain: np.ndarray, byte_id: np.ndarray) -> Vocabulary:
        size = len(text)
        id_of = {text[i]: i for i in range(size) if plain[i]}
        dense = np.unique(-score, return_inverse=True)[1]
        rank, left, right = np.full(size + 5, -1, np.int64), np.full(size + 5, -1, np.int64), np.full(size + 5, -1, np.int64)
        made, pairs = np.zeros(size, bool), {}
        adjacent = np.zeros((256, 256), bool)
        for piece, i in id_of.items():
            for a, b in zip(piece, piece[1:], strict=False):
                adjacent[a, b] = True
            cuts = [k for k in range(1, len(piece)) if piece[k] & 0xC0 != 0x80 or piece[k] == SPACE]
            for k in cuts:
                a, b = id_of.get(piece[:k]), id_of.get(piece[k:])
                if a is not None and b is not None:
                    pairs[a * (size + 5) + b] = int(dense[i])
            if not cuts:
                made[i] = True
            else:
                rank[i] = dense[i]
        for i in sorted(np.flatnonzero(rank[:size] >= 0), key=lambda i: (len(text[i]), i)):
            parts = _merged([bytes(c) for c in _characters(text[i])], id_of, dense, stop_before_last=True)
            if len(parts) == 2:
                a, b = id_of.get(parts[0]), id_of.get(parts[1])
                if a is not None and b is not None:
                    left[i], right[i], made[i] = a, b, True
        keys = np.array(sorted(pairs), np.int64)
        order = np.array(sorted(np.flatnonzero(made), key=lambda i: text[i]), np.int64)
        length = np.array([len(x) for x in text] + [0, 1, 2, 3, 4], np.int64)
        return cls(
            size,
            text,
            length,
            rank,
            left,
            right,
            keys,
            np.array([pairs[k] for k in keys.tolist()], np.int64),
            byte_id,
            order,
            adjacent
        )

    def may_follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the text of piece a and piece b in order of score gives the two again.

        Undoes, from last to first, the merges that made the two; whenever two symbols stood
        at the seam, they must not have been merged before one of them was used up.
        """
        a, b = a.astype(np.int64), b.astype(np.int64)
        valid = np.ones(len(a), bool)
        until = np.full(len(a), np.iinfo(np.int64).max)  # rank of the merge that used up a seam symbol
        tie = np.zeros(len(a), bool)  # that merge lay to the right: an equal rank at the seam came first
        open_ = np.arange(len(a))
        while len(open_):
            x, y = a[open_], b[open_]
            key = x * (self.size + 5) + y
            at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
            joins = self.pair_key[at] == key if len(self.pair_key) else np.zeros(len(key), bool)
            r = self.pair_rank[at] if len(self.pair_key) else key
            bad = joins & ((r < until[open_]) | (tie[open_] & (r == until[open_])))
            valid[open_[bad]] = False
            rx, ry = self.rank[x], self.rank[y]
            done = bad | ((rx < 0) & (ry < 0))
            undo_left = rx > ry  # of equal ranks the right one was made later
            go = open_[~done]
            ul = undo_left[~done]
            lx, ry_ = go[ul], go[~ul]
            until[lx], tie[lx], a[lx] = self.rank[a[lx]], False, self.right[a[lx]]
            until[ry_], tie[ry_], b[ry_] = self.rank[b[ry_]], True, self.left[b[ry_]]
            open_ = go
        return valid


def _characters(text: bytes) -> list[bytes]:
    starts = [k for k in range(len(text)) if text[k] & 0xC0 != 0x80 or text[k] == SPACE]
    return [text[a:b] for a, b in zip(starts, [*starts[1:], len(text)], strict=True)]


def _merged(parts: list[bytes], id_of: dict[bytes, int], rank: np.ndarray, stop_before_last: bool = False) -> list[bytes]:
    """Merges by score, leftmost first; with ``stop_before_last``, down to two parts at least."""
    while len(parts) > (2 if stop_before_last else 1):
        best = min(((rank[id_of[j]], k) for k in range(len(parts) - 1) if (j := parts[k] + parts[k + 1]) in id_of), default=None)
        if best is None:
            break
        k = best[1]
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
    return parts


class Memo:
    """A direct-mapped table of known ``may_follow`` answers, of fixed size."""

    def __init__(self, vocabulary: Vocabulary, bits: int = 21):
        self.vocabulary, self.shift = vocabulary, np.uint64(64 - bits)
        self.key = np.full(1 << bits, -1, np.int64)
        self.value = np.zeros(1 << bits, bool)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * (self.vocabulary.size + 5) + b
        cell = ((key.astype(np.uint64) * K3) >> self.shift).astype(np.int64)
        out = self.value[cell]
        miss = np.flatnonzero(self.key[cell] != key)
        if len(miss):
            keys, first, back = np.unique(key[miss], return_index=True, return_inverse=True)
            said = self.vocabulary.may_follow(a[miss[first]], b[miss[first]])
            out[miss] = said[back]
            where = cell[miss[first]]
            self.key[where], self.value[where] = keys, said
            # two keys may have met in a cell: the last one written holds it, with its own answer
            self.value[where] = np.where(self.key[where] == keys, said, self.value[where])
        return out


class Coder:
    """Encodes and decodes blocks of texts with one vocabulary; made once a worker."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = v = vocabulary
        self.memo = Memo(v)
        self.pieces = v.order.astype(np.int32)
        texts = [v.text[i] for i in v.order]
        padded = np.zeros((len(texts), 16), np.uint8)
        for k, x in enumerate(texts):
            padded[k, : min(len(x), 16)] = np.frombuffer(x[:16], np.uint8)
        words = padded.view(">u8").astype(np.uint64)
        self.low1, self.low2 = words[:, 0].copy(), words[:, 1].copy()
        lengths = np.array([len(x) for x in texts])
        ones = np.uint64(0xFFFFFFFFFFFFFFFF)
        free1, free2 = np.clip(8 - lengths, 0, 8).astype(np.uint64) * np.uint64(8), np.clip(16 - lengths, 0, 8).astype(np.uint64) * np.uint64(8)
        fill = lambda free: np.where(free >= 64, ones, (np.uint64(1) << np.minimum(free, np.uint64(63))) - np.uint64(1))
        self.high1, self.high2 = self.low1 | fill(free1), self.low2 | fill(free2)
        self.lengths = lengths.astype(np.int32)
        all_text = list(v.text)
        for value, i in enumerate(v.byte_id.tolist()):
            all_text[i] = bytes([value])
        self.out_bounds = np.concatenate([[0], np.cumsum([len(x) for x in all_text])])
        self.out_bytes = np.frombuffer(b"".join(all_text), np.uint8)

    def _edges(self, data: np.ndarray, begins: np.ndarray, unit_end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, piece) of every occurrence of a piece that lies in one unit."""
        n = len(data)
        padded = np.concatenate([data, np.zeros(16, np.uint8)])
        k1 = np.zeros(n + 8, np.uint64)
        for k in range(8):
            k1[:n] |= padded[k : n + k].astype(np.uint64) << np.uint64(56 - 8 * k)
        first, second = k1[begins], k1[np.minimum(begins + 8, n)]
        suffix = np.lexsort((second, first))
        first, second, where = first[suffix], second[suffix], begins[suffix]
        lo, hi = np.searchsorted(first, self.low1, "left"), np.searchsorted(first, self.high1, "right")
        long = np.flatnonzero((self.lengths > 8) & (lo < hi))
        if len(long):
            lo[long], hi[long] = _bounded_search(
                second,
                self.low2[long],
                lo[long],
                hi[long],
                False
            ), _bounded_search(second, self.high2[long], lo[long], hi[long], True)
        count = np.maximum(hi - lo, 0)
        piece = np.repeat(np.arange(len(count), dtype=np.int32), count)
        ends = np.cumsum(count)
        start = where.astype(np.int32)[np.arange(len(piece)) + np.repeat(lo - (ends - count), count)]
        end = start + self.lengths[piece]
        inside = end <= unit_end[start]
        start, end, piece = start[inside], end[inside], piece[inside]
        more = np.flatnonzero(self.lengths[piece] > 16)
        if len(more):
            whole = np.ones(len(piece), bool)
            raw = data.tobytes()
            texts = self.vocabulary.text
            for k in more.tolist():
                whole[k] = raw[start[k] : end[k]] == texts[self.pieces[piece[k]]]
            start, end, piece = start[whole], end[whole], piece[whole]
        return start, end, self.pieces[piece]

    def encode_units(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds): the ids of each unit ``data[bounds[k]:bounds[k + 1]]``, one after another."""
        v, n = self.vocabulary, len(data)
        unit_size = np.diff(bounds)
        is_begin = ((data & 0xC0) != 0x80) | (data == SPACE)
        begins = np.flatnonzero(is_begin)
        unit_start, unit_end = np.repeat(bounds[:-1], unit_size), np.repeat(bounds[1:], unit_size)
        start, end, piece = self._edges(data, begins, unit_end)
        char_end = np.append(begins[1:], n)
        known = np.zeros(n + 1, bool)
        end_of_char = np.zeros(n + 1, np.int64)
        end_of_char[begins] = char_end
        known[start[end == end_of_char[start]]] = True
        lone = np.flatnonzero(~known[begins])
        start = np.concatenate([start, begins[lone].astype(np.int32)])
        end = np.concatenate([end, char_end[lone].astype(np.int32)])
        piece = np.concatenate([piece, (v.size + (char_end - begins)[lone]).astype(np.int32)])
        offset = end - unit_start.astype(np.int32)[start]
        order = np.argsort(offset.astype(np.uint16) if offset.max(initial=0) < 65_536 else offset, kind="stable")
        start, end, piece, offset = start[order], end[order], piece[order], offset[order]
        head = start == unit_start[start]
        last = np.full(n + 1, -2, np.int64)
        steps = np.flatnonzero(np.append(True, offset[1:] != offset[:-1])) if len(offset) else np.zeros(0, np.int64)
        for lo, hi in zip(steps.tolist(), [*steps[1:].tolist(), len(offset)], strict=False):
            s, p, at_head = start[lo:hi], piece[lo:hi], head[lo:hi]
            wins = at_head.copy()
            rest = np.flatnonzero(~at_head)
            if len(rest):
                # the place where a unit ends is the start of the next: only inner places are read
                before = last[s[rest]]
                rest, before = rest[before >= 0], before[before >= 0]
                wins[rest] = self.memo(before, p[rest].astype(np.int64))
            last[end[lo:hi][wins]] = p[wins]
        # walk back from the ends of the units
        at, unit = bounds[1:][unit_size > 0], np.flatnonzero(unit_size > 0)
        low = bounds[:-1][unit_size > 0]
        taken_unit, taken_id = [], []
        # a unit's end place may have been written by no other unit, as edges stay inside units
        while len(at):
            token = last[at]
            taken_unit.append(unit)
            taken_id.append(token)
            at = at - v.length[token]
            going = at > low
            at, unit, low = at[going], unit[going], low[going]
        if not taken_unit:
            return np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
        taken_unit, taken_id = np.concatenate(taken_unit[::-1]), np.concatenate(taken_id[::-1])
        order = np.argsort(taken_unit, kind="stable")
        ids, unit = taken_id[order], taken_unit[order]
        out_bounds = np.searchsorted(unit, np.arange(len(bounds)))
        unknown = np.flatnonzero(ids >= v.size)
        if len(unknown):  # byte pieces in place of the unknown characters
            size = np.where(ids >= v.size, ids - v.size, 1)
            place = np.concatenate([[0], np.cumsum(size)])
            spread = np.repeat(ids, size)
            # bytes of a unit's characters: positions follow from the lengths of its pieces
            length = v.length[ids]
            total = np.concatenate([[0], np.cumsum(length)])
            origin = bounds[unit] + total[:-1] - total[out_bounds[unit]]
            for k in unknown.tolist():
                spread[place[k] : place[k + 1]] = v.byte_id[data[origin[k] : origin[k] + size[k]]]
            ids, out_bounds = spread, place[out_bounds]
        return ids, out_bounds

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds) of the texts of a block."""
        raw, offsets = text_buffers(texts)
        if _MARK in raw.tobytes():
            texts = pa.array([None if x is None else x.replace("▁", " ") for x in texts.to_pylist()], pa.string())
            raw, offsets = text_buffers(texts)
        rows = len(offsets) - 1
        size = np.diff(offsets)
        shift = np.cumsum(size > 0)
        data = np.full(len(raw) + int(shift[-1] if rows else 0), SPACE, np.uint8)
        data[np.arange(len(raw)) + np.repeat(shift, size)] = np.where(raw == 32, SPACE, raw)
        offsets = offsets + np.concatenate([[0], shift])
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(rows + 1, np.int64)
        cut = np.ones(len(data), bool)
        cut[1:] = ~self.vocabulary.adjacent[data[:-1], data[1:]] & (((data[1:] & 0xC0) != 0x80) | (data[1:] == SPACE))
        cut[offsets[:-1][size > 0]] = True
        start = np.flatnonzero(cut)
        end = np.append(start[1:], len(data))
        name = range_hashes(_VALUE[data], start, end)
        _, first, back = np.unique(name, return_index=True, return_inverse=True)
        length = (end - start)[first]
        bounds = np.concatenate([[0], np.cumsum(length)])
        units = data[np.arange(bounds[-1]) + np.repeat(start[first] - bounds[:-1], length)]
        ids, id_bounds = self.encode_units(units, bounds)
        count = np.diff(id_bounds)[back]
        ends = np.cumsum(count)
        out = ids[np.arange(ends[-1]) + np.repeat(id_bounds[:-1][back] - (ends - count), count)]
        unit_bounds = np.searchsorted(start, offsets)
        return out, np.concatenate([[0], ends])[unit_bounds]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, bounds) of the texts that rows of ids stand for."""
        length = (self.out_bounds[1:] - self.out_bounds[:-1])[ids]
        ends = np.concatenate([[0], np.cumsum(length)])
        data = self.out_bytes[np.arange(ends[-1]) + np.repeat(self.out_bounds[:-1][ids] - ends[:-1], length)]
        at = ends[bounds]
        keep = np.ones(len(data), bool)
        full = at[:-1][at[:-1] < at[1:]]
        keep[full[data[full] == SPACE]] = False  # the space that encoding puts before a text
        place = np.concatenate([[0], np.cumsum(keep)])
        data = data[keep]
        return np.where(data == SPACE, 32, data).astype(np.uint8), place[at]


def _bounded_search(values: np.ndarray, wanted: np.ndarray, lo: np.ndarray, hi: np.ndarray, right: bool) -> np.ndarray:
    """np.searchsorted of each wanted value within its own sorted range."""
    lo, hi = lo.copy(), hi.copy()
    while (open_ := lo < hi).any():
        mid = (lo + hi) // 2
        value = values[np.minimum(mid, len(values) - 1)]
        up = open_ & ((value <= wanted) if right else (value < wanted))
        down = open_ & ~up
        lo[up] = mid[up] + 1
        hi[down] = mid[down]
    return lo


_coders: dict[str, Coder] = {}


def coder(path: str) -> Coder:
    """The coder of a vocabulary file, kept by the worker process."""
    if path not in _coders:
        _coders[path] = Coder(Vocabulary.load(path))
    return _coders[path]


def _encode_rows(path: str | None):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path or model_file())
        for block in blocks(batches, "text", BLOCK):
            ids, bounds = own.encode(block["text"])
            data, where = own.decode(ids, bounds)
            original, offsets = text_buffers(block["text"])
            data, original = data.tobytes(), original.tobytes()
            digest, same = [], []
            for r in range(block.num_rows):
                said = data[where[r] : where[r + 1]]
                digest.append(hashlib.sha256(said).hexdigest())
                same.append(said == original[offsets[r] : offsets[r + 1]].replace(_MARK, b" "))
            more = {name: block[name] for name in block.schema.names if name != "text"}
            yield pa.RecordBatch.from_pydict(
                more | {
                    "n_tokens": pa.array(np.diff(bounds)), "ids": lists(
                        pa.array(ids, pa.int32()),
                        bounds
                    ), "decoded_sha256": pa.array(digest, pa.string()), "round_trip": pa.array(same, pa.bool_())
                }
            )

    return rows


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids, decoded_sha256, round_trip for each document.

    ``ids`` are those of the vocabulary at ``path``; ``round_trip`` tells whether decoding
    them gives the text again, with U+2581 as a space.
    """
    return encode_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id"], path)


def encode_rows(docs: DataFrame, columns: list[str], path: str | None = None) -> DataFrame:
    """The given columns, n_tokens, ids, decoded_sha256 and round_trip of each row."""
    types = dict(docs.dtypes)
    named = "".join(f"`{c}` {types[c]}, " for c in columns)
    return docs.select(*columns, F.col("text").cast("string").alias("text")).mapInArrow(
        _encode_rows(path),
        named + "n_tokens long, ids array<int>, decoded_sha256 string, round_trip boolean"
    )


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text of a table of doc_id and ids."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path or model_file())
        for batch in batches:
            column = batch["ids"].fill_null([])
            bounds = column.offsets.to_numpy()
            data, where = own.decode(column.flatten().to_numpy().astype(np.int64), bounds - bounds[0])
            raw = data.tobytes()
            texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(where[:-1].tolist(), where[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "text": pa.array(texts, pa.string())})

    return encoded.select("doc_id", "ids").mapInArrow(rows, "doc_id long, text string")
