"""Repair of conversations against costs to go, computed backwards, and a greedy walk."""

from __future__ import annotations

import hashlib
import random
import zlib
from functools import lru_cache

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tracelake.llm import conversation_repair as R
from tracelake.llm.oracles import OP12

SCHEMA = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\x0c\r"
NEXT = {("o", "s"): "s", ("o", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
NAME = {"u": "user", "a": "assistant"}


def harmed(rows):
    out = []
    for conv, turn, role, text in rows:
        show = lambda x: " " if x is None else str(x)
        fate = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = "user" if fate == 4 else show(role), "" if fate == 1 else show(text)
        text = text.translate({ord(c): None for c in ".!?"}) if fate == 2 else text
        out += [(turn, role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


def repaired(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, digest) of rows after damage."""
    seen, kinds = set(), []
    for _, role, text in rows:
        bare = text.strip(SPACE)
        kinds.append("b" if not bare else "d" if (role, text) in seen else "f" if bare[-1] in ".!?" else "t")
        seen.add((role, text))
    moves = {}

    @lru_cache(None)
    def to_go(i, state):
        """The least cost from row i in a state; each letter leads to one place only."""
        ways = []
        for letter, cost, j, new, _ in ways_of(i, state):
            if letter != "I":
                ways.append((cost + to_go(j, new), letter))
            else:
                # an insertion can't pay twice in a row but to end the pattern
                ways.append((cost + after_insert(i, new), letter))
        if i == len(rows) and state in "oa":
            ways.append((0, ""))
        best = min(ways) if ways else (10**9, "")
        moves[i, state] = best
        return best[0]

    @lru_cache(None)
    def after_insert(i, state):
        ways = [cost + to_go(j, new) for letter, cost, j, new, _ in ways_of(i, state) if letter != "I"]
        ways += [
            cost + min(
                [c + to_go(j, n) for l, c, j, n, _ in ways_of(i, new) if l != "I"] + [0 if i == len(rows) and new in "oa" else 10**9]
            ) for letter, cost, _, new, _ in ways_of(i, state) if letter == "I"
        ]
        return min(ways + [0 if i == len(rows) and state in "oa" else 10**9])

    def ways_of(i, state):
        out = [("I", 5, i, NEXT[state, r], f"{NAME[r]}:") for r in "ua" if (state, r) in NEXT]
        if i < len(rows):
            _, role, text = rows[i]
            more = 5 if kinds[i] == "t" else 0
            out.append(("D", 2, i + 1, state, None))
            if kinds[i] not in "bd":
                out += [("K", more, i + 1, NEXT[state, role[:1]], f"{role}:{text}")] if (state, role[:1]) in NEXT else []
                out += [("R", 1 + more, i + 1, NEXT[state, r], f"{NAME[r]}:{text}") for r in "ua" if (state, r) in NEXT]
        return out

    for i in range(len(rows), -1, -1):
        for state in "osua":
            to_go(i, state)
    cost = to_go(0, "o")
    i, state, audit, said, left, inserted = 0, "o", "", [], cost, 0
    while not (i == len(rows) and state in "oa" and left == 0):
        told = []
        for letter, price, j, new, text in ways_of(i, state):
            rest = after_insert(i, new) if letter == "I" else to_go(j, new)
            if price + rest == left:
                told.append((letter, price, j, new, text))
        letter, price, i, state, text = min(told, key=lambda t: t[0])
        audit, left = audit + letter, left - price
        said += [text] if text is not None else []
    turns = {t for t, _, _ in rows if t is not None}
    initials = [role[:1] for _, role, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return gaps, kinds.count("b"), kinds.count("d"), kinds.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest()


def values(row):
    return tuple(row[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"))


def by_conversation(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


def check(spark, rows, **more):
    got = {r["conv_id"]: values(r) for r in R.conversation_repair(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {conv: repaired(harmed(told)) for conv, told in by_conversation(rows).items()}


def odd_rows(seed, count):
    rng = random.Random(seed)
    roles, texts = ["user", "assistant", "system", "tool", "", None], [
        "Fine.",
        "Also fine!",
        "cut",
        "cut ",
        "  ",
        "",
        None,
        "end?\n",
        "Ü.",
        "x "
    ]
    rows = []
    for conv in [None, *range(count)]:
        for k in range(rng.randrange(1, 14)):
            rows.append(
                (
                    conv,
                    rng.choice([k, k, k, k // 2, None, 2 * k]),
                    rng.choices(roles, [6, 6, 3, 1, 1, 1])[0],
                    rng.choice(texts) if rng.random() < 0.5 else f"{k}{rng.choice(['.', '', '!'])}"
                )
            )
    return rows


def test_against_costs_to_go(spark):
    check(spark, odd_rows(5, 300))


def test_sql_twin_on_odd_rows(spark):
    rows = odd_rows(6, 200)
    con = duckdb.connect()
    con.register(
        "conversations",
        pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})
    )
    told = con.execute(OP12)
    names = [c[0] for c in told.description]
    want = {r[0]: values(dict(zip(names, r, strict=True))) for r in told.fetchall()}
    assert {r["conv_id"]: values(r) for r in R.conversation_repair(spark.createDataFrame(rows, SCHEMA)).collect()} == want


def test_given_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    check(spark, [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()])


def test_empty_table_clashing_columns_and_dropped_conversations(spark):
    assert R.conversation_repair(spark.createDataFrame([], SCHEMA)).count() == 0
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    table = spark.createDataFrame(
        [(gone, 0, "user", "Hello.")],
        SCHEMA
    ).withColumn("fault", F.lit("x")).withColumn("dropped", F.lit(1)).withColumn("conv", F.lit(2))
    row = R.conversation_repair(table).first()
    assert (row["conv_id"], *values(row)) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


@pytest.mark.parametrize("held", [7, 1 << 16])
def test_state_is_carried_over_batches_and_pointers_are_spilled(monkeypatch, held):
    """A long conversation in small frames, its pointers in many blocks of the scratch file."""
    monkeypatch.setattr(R, "HELD", held)
    rng = random.Random(held)
    rows = [
        (
            k,
            rng.choice(["user", "assistant", "system"]),
            f"{k}{rng.choice(['.', '', '!', '.'])}" if rng.random() < 0.9 else " "
        ) for k in range(400)
    ]
    kinds = [R.BLANK if not t.strip() else R.FINE if t[-1] in ".!" else R.TRUNCATED for _, _, t in rows]
    frame = pd.DataFrame(
        {
            "conv": ["1"] * len(rows), "turn": [r[0] for r in rows], "no_turn": False, "role": [r[1] for r in rows], "text": [r[2] for r in rows], "fault": kinds
        }
    )
    got = pd.concat(R._repaired(frame.iloc[k : k + 33] for k in range(0, len(frame), 33)))
    assert len(got) == 1 and values(got.iloc[0]) == repaired(rows)
