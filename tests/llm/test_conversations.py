"""Conversation repair against plain dynamic programming over whole edit strings."""

import hashlib
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.llm import role_grammar as g
from plumbline.llm.conversation_queries import damaged
from plumbline.llm.conversations import conversation_pieces, repair_report

BLANK = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string, repaired string, Text string, n int"
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}


def plain_repair(rows):
    """(cost, audit, lines) of the cheapest edits: all strings of each state, row by row."""
    def put(found):
        for _ in range(4):
            for q, (cost, audit, lines) in list(found.items()):
                to = NEXT[q]
                new = (cost + 3, audit + "I", lines + [{"u": "user:", "a": "assistant:"}[to]])
                if to not in found or new[:2] < found[to][:2]:
                    found[to] = new
        return found

    now = put({"": (0, "", [])})
    for role, text, fault in rows:
        then = {}
        for q, (cost, audit, lines) in now.items():
            moves = [(4, "D", q, [])]
            if fault not in ("blank", "duplicate"):
                late, i = 3 * (fault == "truncated"), role[:1]
                if (i, q) in {("s", ""), ("u", ""), ("u", "s"), ("u", "a"), ("a", "u")}:
                    moves.append((late, "K", i, [f"{role}:{text}"]))
                moves.append((3 + late, "R", NEXT[q], [f"{({'u': 'user', 'a': 'assistant'})[NEXT[q]]}:{text}"]))
            for c, e, to, more in moves:
                new = (cost + c, audit + e, lines + more)
                if to not in then or new[:2] < then[to][:2]:
                    then[to] = new
        now = put(then)
    return min(now[q] for q in ("", "a") if q in now)


def plain_report(rows):
    """Per conversation what the contract asks for, from (conv, turn, role, text) after damage."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted(((t is not None, t or 0, r or " " if r is None else r, " " if x is None else x, t)
                      for c, t, r, x, n in rows if c == conv for _ in range(n)))
        seen, told = set(), []
        for _, _, role, text, _ in own:
            end = text.rstrip(BLANK)
            fault = ("blank" if not end else "duplicate" if (role, text) in seen else
                     "truncated" if end[-1] not in ".!?" else "none")
            seen.add((role, text))
            told.append((role, text, fault))
        cost, audit, lines = plain_repair(told)
        turns = {t for *_, t in own if t is not None}
        faults = [f for _, _, f in told]
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("blank"),
                     faults.count("duplicate"), faults.count("truncated"),
                     sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(told, told[1:])),
                     cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "", "x"]),
                          st.sampled_from(["none", "truncated", "blank"])), max_size=12))
def test_edits_are_the_cheapest_and_the_least(rows):
    told = [(r, "t", f) for r, f in rows]
    runs = g.collapse([(g.symbol(r, f == "blank", f == "truncated"), 1) for r, _, f in told])
    cost, audit, _ = plain_repair(told)
    assert g.cheapest_edits(runs, g.DONE, 0, True)[0] == audit
    costs = g.DONE
    for run in reversed(runs):
        costs = g.advance(run, costs)
    assert costs[0] == cost
    m = g.transition(runs)
    assert min(m[0][q] + g.DONE[q] for q in g.STATES) == cost


def test_long_runs():
    told = [("user", "t", "none")] * 203 + [("user", "t", "blank")] * 90 + [("assistant", "t", "truncated")] * 77
    runs = g.collapse([(g.symbol(r, f == "blank", f == "truncated"), 1) for r, _, f in told])
    assert len(runs) == 3
    assert g.cheapest_edits(runs, g.DONE, 0, True)[0] == plain_repair(told)[1]
    assert len(g.cheapest_edits([(2, 100_000), (0, 100_000)], g.DONE, 0, True)[0]) >= 200_000


def conversations(seed, many):
    rng, rows = random.Random(seed), []
    for conv in [None, *range(many)]:
        for turn in range(rng.randrange(8)):
            rows.append((conv, rng.choice([turn, turn, turn, None, 3]), rng.choice(
                ["system", "user", "assistant", "assistant", None, ""]), rng.choice(
                ["a.", "b!", "c? \n", "d", "", None, "\x0b", "é.", "x ", "." * 50]), rng.randrange(3)))
    for turn in range(150):  # one conversation with most rows
        rows.append((77, turn // 2, rng.choice(["user", "assistant"]), rng.choice(["a.", f"{turn}.", "d"]), 1))
    rows += [(77, 20, "user", "same.", 1)] * 30
    return rows


@pytest.mark.parametrize("piece_rows,piece_chars", [(3, 1 << 20), (16_384, 40), (16_384, 4 << 20)])
def test_report_equals_plain_python(spark, piece_rows, piece_chars):
    rows = conversations(piece_rows + piece_chars, 40)
    df = spark.createDataFrame([(*r[:4], "r", "T", r[4]) for r in rows], SCHEMA.replace(
        "repaired string, Text string", "repaired string, conv string")).repartition(5)
    pieces = conversation_pieces(df, copies=F.col("n"), piece_rows=piece_rows, piece_chars=piece_chars)
    assert pieces.filter("conv = '77'").count() > (1 if piece_rows == 3 else 0)
    got = {r[0]: tuple(r[1:]) for r in repair_report(df, copies=F.col("n"), piece_rows=piece_rows,
                                                     piece_chars=piece_chars).collect()}
    assert got == plain_report(rows)


def test_damage(spark):
    rows = [(c, t, r, x) for c in [None, *range(60)] for t, r, x in [
        (0, "system", "Be. Good"), (1, None, "a?b!"), (None, "user", None)]]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got, copies = damaged(df)
    want = []
    for c, t, r, x in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = " " if x is None else x
        want.append((c, None, None, None, 0) if kind == 0 else (
            c, t, "user" if kind == 4 else r, "" if kind == 1 else "".join(
                ch for ch in text if ch not in ".!?") if kind == 2 else text, 1 + (kind == 3)))
    key = repr
    assert sorted(map(key, map(tuple, got.select("conv_id", "turn", "role", "text", copies).collect()))) == sorted(map(key, want))


def test_empty_and_gone(spark):
    df = spark.createDataFrame([(1, 1, "user", "a."), (2, None, None, None)],
                               "conv_id long, turn long, role string, text string")
    none = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    got = {r[0]: tuple(r[1:]) for r in repair_report(df, copies=F.lit(0)).collect()}
    assert got == {1: none, 2: none}
    assert repair_report(df.limit(0)).count() == 0
    report = repair_report(df).filter("conv_id = 1").first()
    assert (report.cost, report.audit) == (3, "KI")
