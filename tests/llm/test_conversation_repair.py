"""Conversation repair against a search over all edits, whole and in pieces."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from panelwright.llm import conversation_repair as cr

from .test_operators import clashing

SHAPE = re.compile("(s?(ua)+)?")


def plain_edits(states, most_insertions=4):
    """The cheapest audits of a few rows, by trying all: (cost, least audit)."""
    best = (10**9, "")
    options = []
    for initial, fault in states:
        extra = 3 if fault == cr.TRUNCATED else 0
        own = [("D", "", 4)]
        if fault in (cr.GOOD, cr.TRUNCATED):
            own += [("K", initial or "-", extra), ("R", "u", 3 + extra), ("R", "a", 3 + extra)]
        options.append(own)
    fills = [("".join(x), len(x)) for n in range(most_insertions + 1) for x in itertools.product("ua", repeat=n)]

    def go(k, audit, out, cost, left):
        nonlocal best
        if cost > best[0]:
            return
        for fill, n in fills:
            if n > left:
                break
            for letter, initial, price in options[k] if k < len(options) else [("", "", 0)]:
                now = (audit + "I" * n + letter, out + fill + initial, cost + 3 * n + price, left - n)
                if k < len(options):
                    go(k + 1, *now)
                elif SHAPE.fullmatch(now[1]) and (now[2], now[0]) < best:
                    best = (now[2], now[0])

    go(0, "", "", 0, most_insertions)
    return best


def test_walk_is_the_least_of_all_edits():
    rng = random.Random(5)
    for n in range(5):
        for _ in range(25):
            states = [(rng.choice("suauat "), rng.choice([cr.GOOD] * 4 + [cr.BLANK, cr.DUPLICATE, cr.TRUNCATED])) for _ in range(n)]
            assert (cr.costs(states)[0], "".join(e for e, _, _ in cr.walk(states))) == plain_edits(states, n + 2)


def test_checkpoints_and_full_vectors_agree():
    rng = random.Random(6)
    for n in (1, 2, 3, 9, 17, 400, 1_001):
        states = [(rng.choice("suaua"), rng.choice([cr.GOOD] * 3 + [cr.BLANK, cr.TRUNCATED])) for _ in range(n)]
        vectors = [cr.AT_END]
        for row in reversed(states):
            vectors.append(cr.before(row, vectors[-1]))
        vectors.reverse()
        edits, i, paid, state = list(cr.walk(states)), 0, 0, 0
        for edit, row, now in edits:
            assert row in (-1, i) and vectors[i][state] + paid == vectors[0][0]
            paid += {"D": 4, "I": 3, "K": 0, "R": 3}[edit] + (3 if edit in "KR" and states[i][1] == cr.TRUNCATED else 0)
            i, state = i + (edit != "I"), now
        assert i == n and state in (0, 3) and paid == cr.costs(states)[0]


def plain_result(rows):
    """The result of one conversation's rows (turn, role, text), as the contract says it."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
    seen, states, said = set(), [], []
    for _, role, text in rows:
        kept = re.sub("[\x20\x09-\x0d]+$", "", text)
        fault = cr.BLANK if not kept else cr.DUPLICATE if (role, text) in seen else cr.TRUNCATED if kept[-1] not in ".!?" else cr.GOOD
        seen.add((role, text))
        states.append((role[:1], fault))
    cost, audit = plain_edits(states, len(rows) + 2) if len(rows) < 6 else (cr.costs(states)[0], "".join(e for e, _, _ in cr.walk(states)))
    last, i = "", 0
    for edit in audit:
        want = "assistant" if last == "u" else "user"
        if edit == "I":
            said.append(f"{want}:")
        elif edit != "D":
            said.append(f"{rows[i][1] if edit == 'K' else want}:{rows[i][2]}")
        last = said[-1][0] if edit != "D" else last
        i += edit != "I"
    turns = [r[0] for r in rows if r[0] is not None]
    count = [f for _, f in states]
    wrong = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in itertools.pairwise(states))
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, count.count(cr.BLANK), count.count(cr.DUPLICATE), count.count(cr.TRUNCATED), wrong, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())


def plain_damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        name = lambda x: " " if x is None else str(x)
        role, text = name(role), name(text)
        kind = zlib.crc32(f"{name(conv)}:{name(turn)}".encode()) % 20
        mine = out.setdefault(conv, [])
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        mine += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def odd_turns():
    rng, rows = random.Random(8), []
    texts = ["Yes.", "No!", "why", "  ", "", None, "Ünïcode?\n", "a.b", "Tell me more. \x0b\f\r", "x" * 150_000]
    for conv in [*range(60), None]:
        n = rng.choice([1, 2, 3, 5, 9])
        rows += [(conv, rng.choice([None, *range(7), 3, 2**40]) if rng.random() < 0.3 else k, rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None]), rng.choice(texts)) for k in range(n)]
    return rows + rows[:9]


def asked(spark, rows, **options):
    turns = spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, conv string, there string").repartition(3)
    found = cr.repair(cr.damaged(turns), there_col="there").collect()
    assert len(found) == len({r.conv for r in found})
    return {r.conv: tuple(r)[1:] for r in found}


@pytest.fixture(scope="module")
def expected():
    return {conv: plain_result(mine) for conv, mine in plain_damage(odd_turns()).items()}


def test_damaged_conversations(spark, expected):
    assert asked(spark, odd_turns()) == expected
    assert cr.repair(cr.damaged(spark.createDataFrame([], "conv_id long, turn long, role string, text string")), there_col="there").count() == 0


def test_conversations_in_pieces(spark, monkeypatch, expected):
    """Every conversation of over two rows is cut into pieces of about three."""
    for name, value in (("WHOLE_ROWS", 2), ("PIECE_ROWS", 3), ("CHUNK_BYTES", 10)):
        monkeypatch.setattr(cr, name, value)
    assert asked(spark, odd_turns()) == expected


def test_a_conversation_of_most_rows(spark, monkeypatch):
    """One conversation with most rows, most of them the same: no task holds it, and the result is the one of a whole walk."""
    rng = random.Random(3)
    rows = [(1, 5, "user", "again and again.")] * 900 + [(1, k, rng.choice(["user", "assistant"]), f"turn {k}{rng.choice('.!x')}") for k in range(600)] + [(2, 0, "user", "Hi."), (2, 1, "assistant", "Yes?")]
    whole = asked(spark, rows)
    monkeypatch.setattr(cr, "WHOLE_ROWS", 100)
    monkeypatch.setattr(cr, "PIECE_ROWS", 200)
    pieces = []
    was = cr.stage
    monkeypatch.setattr(cr, "stage", lambda df, name: pieces.append(df.groupBy("conv", "piece").count().agg(F.max("count")).first()[0]) or was(df, name) if name == "repair-marked" else was(df, name))
    assert asked(spark, rows) == whole and pieces[0] < 700


def test_columns_with_the_names_used_inside(spark):
    rows = [(1, "Hello."), (1, "Hello."), (2, None), (None, "x")]
    table = clashing(spark, rows, "conv_id", "text").drop("turn", "role", "sha", "fault")
    table = table.withColumns({"turn": F.lit(1).cast("long"), "role": F.lit("user"), "sha": F.lit("s"), "fault": F.lit("f")})
    bare = table.select("conv_id", "turn", "role", "text")
    key = lambda t: sorted(map(str, cr.repair(t, conv_col="conv_id").collect()))
    assert key(table) == key(bare) and len(key(bare)) == 3
