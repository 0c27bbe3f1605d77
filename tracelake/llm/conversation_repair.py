"""Repair of the role structure of conversations, at the least cost.

A conversation should read ``(s?(ua)+)?`` in the initials of its roles. Rows may be kept,
given another role, deleted, or inserted; a dynamic program over the four states of that
pattern finds the cheapest edits, and of equally cheap ones the ASCII-least.

Rows are dealt by conversation and sorted by turn; ``mapInPandas`` reads them as a stream
and carries the program's state, four costs and their order, from one Arrow batch to the
next. All a task keeps of a row is four bytes, where each state came from; those of a giant
conversation go to a file of the task's own scratch folder, block by block, and are read
once backwards. The digest of the repaired text is carried along in each state, so no text
is held or read twice. A conversation is the work of one task, however long; its memory
there is a block of pointers and the audit, a byte a row.

Faults are found before, by Spark: whether the role and text stood earlier is a row number
among equal digests, on the same partitioning.

Edge cases: null roles and texts count as one space, and so do null ids and turns in the
damage rule. A null conv_id is one conversation of its own. Rows with equal turns are taken
by role and then text; null turns come first. Roles other than the three keep their first
character as initial, and an empty role has none: such rows can't be kept. Repeated rows are
duplicates. Long texts are only hashed. An empty table gives none. Further columns are not
read, whatever their names.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .graph import shuffle_partitions

#: Characters that don't make a text other than blank, and the ends of a whole sentence.
SPACES, ENDS = " \t\n\x0b\x0c\r", ".!?"
DROPPED, FINE, BLANK, DUPLICATE, TRUNCATED = range(5)
KEEP, REROLE, DELETE, INSERT, OPEN_END = 0, 1, 2, 5, 5

#: States of the pattern: nothing yet, after s, after u, after a; the state that each role leads to.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
STEP = {(START, "s"): AFTER_S, (START, "u"): AFTER_U, (AFTER_S, "u"): AFTER_U, (AFTER_A, "u"): AFTER_U, (AFTER_U, "a"): AFTER_A}
ROLE = {"u": "user", "a": "assistant"}
FAR = 1 << 40
#: Rows whose pointers a task holds before they go to its scratch file.
HELD = 1 << 16


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, dropped: the rows after the damage that crc32 of conversation and turn deals them.

    0 of 20 drops the row (it stays, marked), 1 empties its text, 2 takes out its sentence
    ends, 3 repeats it, 4 makes its role user.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn"))) % 20
    text = F.when(fate == 1, "").when(fate == 2, F.translate(said("text"), ENDS, "")).otherwise(said("text"))
    told = rows.select(
        "conv_id",
        "turn",
        F.when(fate == 4, "user").otherwise(said("role")).alias("role"),
        text.alias("text"),
        (fate == 0).alias("dropped"),
        F.when(fate == 3, 2).otherwise(1).alias("_times")
    )
    return told.withColumn("_time", F.explode(F.sequence(F.lit(1), "_times"))).drop("_times", "_time")


def fault(text: str) -> Column:
    """Blank, truncated or fine, by the text alone."""
    bare = F.rtrim(F.col(text), F.lit(SPACES))
    return F.when(bare == "", BLANK).when(~F.right(bare, F.lit(1)).isin(*ENDS), TRUNCATED).otherwise(FINE)


def with_faults(rows: DataFrame) -> DataFrame:
    """The rows, dealt by conversation and sorted by turn, role and text within each, with ``fault``."""
    dealt = rows.repartition(shuffle_partitions(rows.sparkSession), "conv_id")
    dealt = dealt.withColumn("_said", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    earlier = F.row_number().over(W.partitionBy("conv_id", "dropped", "_said").orderBy("turn")) > 1
    told = dealt.withColumn("_again", earlier)
    kind = F.when(F.col("dropped"), DROPPED).when((fault("text") != BLANK) & F.col("_again"), DUPLICATE).otherwise(fault("text"))
    return told.select("conv_id", "turn", "role", "text", kind.alias("fault")).sortWithinPartitions("conv_id", "turn", "role", "text")


def _moves(initial: str, kind: int) -> list[tuple[int, str, int, int, str]]:
    """(state, letters, new state, cost, roles given) of all ways to deal with a row, insertions before it included."""
    out = []
    for state in range(4):
        at, letters, cost, given = state, "", 0, ""
        while True:
            open_end = OPEN_END if kind == TRUNCATED else 0
            out.append((state, letters + "D", at, cost + DELETE, given))
            if kind not in (BLANK, DUPLICATE):
                if (at, initial) in STEP:
                    out.append((state, letters + "K", STEP[at, initial], cost + KEEP + open_end, given + "k"))
                for role in ROLE:
                    if (at, role) in STEP:
                        out.append((state, letters + "R", STEP[at, role], cost + REROLE + open_end, given + role.upper()))
            if len(letters) == 2:
                break
            role = "a" if at == AFTER_U else "u"
            at, letters, cost, given = STEP[at, role], letters + "I", cost + INSERT, given + role
    return out


#: Ways to end: the inserted roles that complete the pattern.
ENDINGS = {START: "", AFTER_S: "ua", AFTER_U: "a", AFTER_A: ""}
LETTERS = [x + y for x in ("", "I", "II") for y in "DKR"]


class Program:
    """Steps of the dynamic program, kept for each state of costs and order that occurs: there are few.

    A state is (costs above the least, order of the four edit strings so far). Two strings
    that have used the same rows never begin one another, so their order is that of the
    strings before and then of the letters added.
    """

    def __init__(self):
        self.known: dict = {}

    def step(self, state: tuple, initial: str, kind: int) -> tuple:
        """The next state, what the least cost grew by, a pointer of four bytes, and (parent, roles given) for each new state."""
        key = (state, initial, kind)
        if key not in self.known:
            costs, ranks = state
            best: dict = {}
            for at, letters, to, cost, given in _moves(initial, kind):
                told = (costs[at] + cost, ranks[at], letters, at, given)
                if costs[at] < FAR and (to not in best or told[:3] < best[to][:3]):
                    best[to] = told
            least = min(t[0] for t in best.values())
            order = sorted(best, key=lambda s: best[s][1:3])
            pointer = sum((best[s][3] * len(LETTERS) + LETTERS.index(best[s][2])) << (8 * s) for s in best)
            now = (
                tuple(best[s][0] - least if s in best else FAR for s in range(4)),
                tuple(order.index(s) if s in best else 4 for s in range(4))
            )
            self.known[key] = (now, least, pointer, [(s, best[s][3], best[s][4]) for s in best])
        return self.known[key]


class Conversation:
    """One conversation as it streams by: counts, the program's state, digests of the four repaired texts, pointers."""

    def __init__(self, key):
        self.key = key
        self.blank = self.duplicate = self.truncated = self.illegal = self.cost = self.rows = 0
        self.state = ((0, FAR, FAR, FAR), (0, 4, 4, 4))
        self.texts = [(hashlib.sha256(), False), None, None, None]
        self.pointers, self.file, self.last = [], None, None
        self.turns, self.first_turn, self.last_turn = 0, None, None

    def add(self, program: Program, turn: int | None, role: str, text: str, kind: int) -> None:
        initial = role[:1]
        self.blank += kind == BLANK
        self.duplicate += kind == DUPLICATE
        self.truncated += kind == TRUNCATED
        if self.rows and self.last + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.last = initial
        self.rows += 1
        if turn is not None and turn != self.last_turn:
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn, self.turns = turn, self.turns + 1
        self.state, grown, pointer, came = program.step(self.state, initial, kind)
        self.cost += grown
        texts = [None] * 4
        for to, parent, given in came:
            texts[to] = _written(self.texts[parent], given, role, text)
        self.texts = texts
        self.pointers.append(pointer)
        if len(self.pointers) == HELD:
            self.file = self.file or tempfile.TemporaryFile()
            self.file.write(np.array(self.pointers, np.uint32).tobytes())
            self.pointers = []

    def result(self) -> tuple:
        costs, ranks = self.state
        ends = [(costs[s] + INSERT * len(end), ranks[s], "I" * len(end), s) for s, end in ENDINGS.items() if costs[s] < FAR]
        cost, _, letters, at = min(ends)
        digest, _ = _written(self.texts[at], ENDINGS[at], "", "")
        audit = bytearray(letters.encode())
        for block in self._blocks():
            for pointer in block.tolist():
                at, k = divmod(pointer >> (8 * at) & 255, len(LETTERS))
                audit += LETTERS[k][::-1].encode()
        audit.reverse()
        gaps = 0 if self.first_turn is None else self.last_turn - self.first_turn + 1 - self.turns
        return self.key, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost + cost, audit.decode(), digest.hexdigest()

    def _blocks(self) -> Iterator[np.ndarray]:
        """The pointers, the last first."""
        yield np.array(self.pointers[::-1], np.uint32)
        if self.file is not None:
            for k in range(self.file.tell() // (4 * HELD) - 1, -1, -1):
                self.file.seek(4 * HELD * k)
                yield np.frombuffer(self.file.read(4 * HELD), np.uint32)[::-1]
            self.file.close()


def _written(before: tuple, given: str, role: str, text: str) -> tuple:
    """The digest after the rows that ``given`` names: u and a inserted ones, k the row as it is, U and A under a new role."""
    if not given:
        return before
    digest, any_ = before[0].copy(), before[1]
    for g in given:
        said = f"{ROLE[g]}:" if g in ROLE else f"{role if g == 'k' else ROLE[g.lower()]}:{text}"
        digest.update(("\n" + said if any_ else said).encode())
        any_ = True
    return digest, any_


RESULT = "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
#: Results that a task gathers before it sends them on.
OUT = 1 << 12


def _repaired(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in RESULT.split(", ")]
    program, one, out = Program(), None, []
    for frame in frames:
        numbers = [None if null else turn for turn, null in zip(frame["turn"].tolist(), frame["no_turn"].tolist(), strict=True)]
        for key, turn, role, text, kind in zip(frame["conv"], numbers, frame["role"], frame["text"], frame["fault"].tolist(), strict=True):
            if one is None or key != one.key:
                if one is not None:
                    out.append(one.result())
                one = Conversation(key)
            if kind != DROPPED:
                one.add(program, turn, role, text, kind)
        if len(out) >= OUT:
            yield pd.DataFrame(out, columns=columns)
            out = []
    if one is not None:
        out.append(one.result())
    yield pd.DataFrame(out, columns=columns)


def repaired(rows: DataFrame) -> DataFrame:
    """conv_id and the faults, cheapest edits and digest of the repaired text of every conversation of ``with_faults``' rows."""
    told = rows.select(
        F.col("conv_id").cast("string").alias("conv"),
        F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"),
        F.col("turn").isNull().alias("no_turn"),
        "role",
        "text",
        "fault"
    )
    out = told.mapInPandas(_repaired, RESULT)
    return out.select(F.col("conv").cast(dict(rows.dtypes)["conv_id"]).alias("conv_id"), *[c for c in out.columns if c != "conv"])


def conversation_repair(conversations: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation, damaged first."""
    return repaired(with_faults(damaged(conversations)))
