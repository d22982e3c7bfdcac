"""Repair of the structure of conversations by a run-length dynamic program.

A row of a conversation is at fault if it is blank, repeats a role and text seen earlier, or stops
without ``.``, ``!`` or ``?``; the first of these counts. ``role_grammar`` finds the cheapest edits
that make the roles fit. Rows are range-partitioned by conversation and turn, so a conversation
mostly lies in one task, which repairs it as its rows stream by. Conversations that reach the border
of a partition, or that are longer than ``piece_rows`` rows or ``piece_chars`` characters, are cut
into pieces: a piece gives its (min, +) matrix, those of a conversation are folded from its end to the
costs to go behind each piece, every piece then unrolls its edits for each state it may begin in, and
the states are chained. No task holds more than a piece, and equal rows are counted before they move.

Cases: rows stand in the order of turn (nulls first), role and text. A null role or text is one
blank. Rows with ``copies`` below 1 are gone, but their conversation is still reported, with zeros if
no row is left. A null conversation id is a conversation of its own. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.role_grammar import (DELETE, DONE, INSERT, NEXT, REROLE, STATES, TRUNCATED, USER,
                                        Vector, advance, cheapest_edits, collapse, symbol, transition)
from plumbline.llm.text import BLANKS
from plumbline.session import materialize

_LEGAL = ("su", "ua", "au")
_ROW = pa.struct([("role", pa.string()), ("text", pa.string()), ("of", pa.int32()), ("n", pa.int64())])
_PIECE = pa.schema([
    ("conv", pa.string()), ("part", pa.int32()), ("no", pa.int64()), ("whole", pa.bool_()),
    ("rows", pa.list_(_ROW)), ("matrix", pa.list_(pa.int64())), ("first_turn", pa.int64()),
    ("last_turn", pa.int64()), ("turns", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()),
    ("truncated", pa.int64()), ("illegal", pa.int64()), ("first_role", pa.string()),
    ("last_role", pa.string()), ("audit", pa.string()), ("cost", pa.int64()),
    ("repaired", pa.string())])
_STATS = [f.name for f in _PIECE if f.name not in ("rows", "matrix", "audit", "cost", "repaired")]
_PIECE_SQL = (
    "conv string, part int, no long, whole boolean, "
    "rows array<struct<role:string,text:string,of:int,n:long>>, matrix array<long>, "
    "first_turn long, last_turn long, turns long, blank long, duplicate long, truncated long, "
    "illegal long, first_role string, last_role string, audit string, cost long, repaired string")


def repaired_text(rows: list[dict], audit: str, q: int) -> tuple[str, int]:
    """The lines (``role:text``) that edits make of the rows, and what the edits cost."""
    lines, cost, at = [], 0, 0
    for row in rows:
        for copy in range(row["n"]):
            of = 0 if copy else row["of"]
            while audit[at] == "I":
                q, at, cost = NEXT[q], at + 1, cost + INSERT
                lines.append("user:" if q == USER else "assistant:")
            edit, at = audit[at], at + 1
            if edit == "D":
                cost += DELETE
                continue
            if of and (of - 1) % 2:
                cost += TRUNCATED
            if edit == "R":
                q, cost = NEXT[q], cost + REROLE
                lines.append(f"{'user' if q == USER else 'assistant'}:{row['text']}")
            else:
                q = {0: 1, 1: 2, 2: 3}[(of - 1) // 2]
                lines.append(f"{row['role']}:{row['text']}")
    for _ in audit[at:]:
        q, cost = NEXT[q], cost + INSERT
        lines.append("user:" if q == USER else "assistant:")
    return "\n".join(lines), cost


def runs_of(rows: list[dict]) -> list[tuple[int, int]]:
    """The runs of rows; further copies of a row have to go."""
    return collapse([run for r in rows for run in ((r["of"], 1), (0, r["n"] - 1)) if run[1]])


@dataclass
class _Piece:
    """Rows of one conversation that stand together, and what is counted in them."""

    conv: str | None
    rows: list[dict] = field(default_factory=list)
    chars: int = 0
    first_turn: int | None = None
    last_turn: int | None = None
    turns: int = 0
    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    first_role: str | None = None
    last_role: str | None = None

    def add(self, row: dict) -> None:
        role, text, n = row["role"], row["text"], row["n"]
        if n < 1:
            return
        initial = role[:1]
        if row["blank"]:
            self.blank += n
        else:
            self.duplicate += n - (not row["seen"])
            self.truncated += row["cut"] and not row["seen"]
        self.illegal += n - 1 + (self.last_role is not None and self.last_role + initial not in _LEGAL)
        if self.first_role is None:
            self.first_role = initial
        self.last_role = initial
        if row["turn"] is not None and row["turn"] != self.last_turn:
            self.turns += 1
            self.last_turn = row["turn"]
            if self.first_turn is None:
                self.first_turn = row["turn"]
        self.rows.append({"role": role, "text": text, "n": n,
                          "of": symbol(role, row["blank"] or row["seen"], row["cut"])})
        self.chars += len(text)

    def record(self, part: int, no: int, whole: bool) -> dict:
        out = {"conv": self.conv, "part": part, "no": no, "whole": whole}
        out |= {k: getattr(self, k) for k in _STATS[4:]}
        runs = runs_of(self.rows)
        if whole:
            audit, _ = cheapest_edits(runs, DONE, 0, True)
            text, cost = repaired_text(self.rows, audit, 0)
            return out | {"audit": audit, "cost": cost, "repaired": text, "rows": None, "matrix": None}
        return out | {"rows": self.rows, "matrix": [c for line in transition(runs) for c in line],
                      "audit": None, "cost": None, "repaired": None}


def _cut_pieces(piece_rows: int, piece_chars: int):
    """Sorted rows to pieces; conversations that surely end in the partition are repaired."""
    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, no, made, size = TaskContext.get().partitionId(), 0, [], 0
        now, inside = None, False  # inside: the conversation began in this partition, uncut so far

        def close(whole: bool) -> None:
            nonlocal no, size
            made.append(now.record(part, no, whole))
            size += now.chars + 64 * len(now.rows) + 200
            no += 1

        for batch in batches:
            for row in batch.to_pylist():
                if now is None or row["conv"] != now.conv:
                    if now is not None:
                        close(inside)
                        inside = True
                    now = _Piece(row["conv"])
                elif len(now.rows) >= piece_rows or now.chars >= piece_chars:
                    inside = False
                    close(False)
                    now = _Piece(row["conv"])
                now.add(row)
                if size >= piece_chars:
                    yield pa.RecordBatch.from_pylist(made, _PIECE)
                    made, size = [], 0
        if now is not None:
            close(False)
        if made:
            yield pa.RecordBatch.from_pylist(made, _PIECE)

    return cut


def _tails(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The costs to go behind each piece of a conversation, and whether it is the last."""
    for batch in batches:
        out = []
        for pieces in batch["pieces"].to_pylist():
            costs: Vector = DONE
            for i, p in enumerate(reversed(pieces)):
                out.append({"part": p["part"], "no": p["no"], "after": list(costs), "last": not i})
                m = p["matrix"]
                costs = tuple(min(m[4 * q + k] + costs[k] for k in STATES) for q in STATES)
        yield pa.RecordBatch.from_pylist(out, pa.schema([
            ("part", pa.int32()), ("no", pa.int64()), ("after", pa.list_(pa.int64())),
            ("last", pa.bool_())]))


def _every_start(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edits of a piece for each state it may begin in, and the states they end in."""
    for batch in batches:
        out = []
        for runs, after, last in zip(batch["runs"].to_pylist(), batch["after"].to_pylist(),
                                     batch["last"].to_pylist()):
            runs = collapse([run for r in runs for run in ((r["of"], 1), (0, r["n"] - 1)) if run[1]])
            found = [cheapest_edits(runs, tuple(after), q, last) for q in STATES]
            out.append({"audits": [a for a, _ in found], "ends": [q for _, q in found]})
        made = pa.RecordBatch.from_pylist(out, pa.schema([("audits", pa.list_(pa.string())),
                                                          ("ends", pa.list_(pa.int32()))]))
        yield pa.RecordBatch.from_arrays([batch["conv"], batch["part"], batch["no"], *made.columns],
                                         ["conv", "part", "no", "audits", "ends"])


def _chain(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state each piece begins in."""
    for batch in batches:
        out = []
        for pieces in batch["pieces"].to_pylist():
            q = 0
            for p in pieces:
                out.append({"part": p["part"], "no": p["no"], "start": q})
                q = p["ends"][q]
        yield pa.RecordBatch.from_pylist(out, pa.schema([("part", pa.int32()), ("no", pa.int64()),
                                                         ("start", pa.int32())]))


def _repair(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces with the edits of the state they begin in."""
    for batch in batches:
        for one in range(len(batch)):  # one piece at a time leaves Arrow
            row = batch.slice(one, 1).to_pylist()[0]
            q = row.pop("start")
            row["audit"] = row.pop("audits")[q]
            row["repaired"], row["cost"] = repaired_text(row["rows"], row["audit"], q)
            row |= {"rows": None, "matrix": None}
            yield pa.RecordBatch.from_pylist([row], _PIECE)


def conversation_pieces(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
                        role_col: str = "role", text_col: str = "text", copies: Column | None = None, *,
                        piece_rows: int = 16_384, piece_chars: int = 4 << 20) -> DataFrame:
    """The repaired conversations in pieces, in the order of ``part`` and ``no``.

    Most conversations are one piece. A piece has its counts, ``audit``, ``cost`` and ``repaired``
    lines. ``copies`` is how many times each row of the input stands there (once, if not given).
    """
    spark = rows.sparkSession
    read = rows.select(
        F.col(conv_col).cast("string").alias("conv"), F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text_col), F.lit(" ")).alias("text"),
        (F.lit(1) if copies is None else copies).cast("long").alias("n"))
    equal = read.groupBy("conv", "turn", "role", "text").agg(F.sum("n").alias("n"))
    end = F.rtrim("text", F.lit(BLANKS))
    mark = [F.xxhash64(F.lit(s), "role", "text").alias(f"h{s}") for s in (1, 2)]
    told = equal.withColumn("blank", end == "").withColumn(
        "cut", ~F.right(end, F.lit(1)).isin(".", "!", "?")).select("*", *mark)
    # where a role and text first stand, if they stand at several turns
    turn = F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("_"),
                    "turn")
    first = read.filter("n > 0").select("conv", "turn", *mark).groupBy("conv", "h1", "h2").agg(
        F.min(turn).alias("at"), F.max(turn).alias("till")).filter("at <> till").select(
            F.col("conv").alias("_conv"), F.col("h1").alias("_h1"), F.col("h2").alias("_h2"),
            F.col("at.turn").alias("_turn"))
    seen = told.join(first, F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("h1") == F.col("_h1")) & (
        F.col("h2") == F.col("_h2")), "left").select(
        "conv", "turn", "role", "text", "n", "blank", "cut",
        (F.col("_h1").isNotNull() & ~F.col("turn").eqNullSafe(F.col("_turn"))).alias("seen"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pieces = materialize(spark, seen.repartitionByRange(
        parts, "conv", "turn", "role", F.left("text", F.lit(64))).sortWithinPartitions(
        "conv", "turn", "role", "text").mapInArrow(
            _cut_pieces(piece_rows, piece_chars), _PIECE_SQL), "conversation-pieces")
    open_ones = pieces.filter("not whole")
    order = F.sort_array(F.collect_list(F.struct("part", "no", "matrix"))).alias("pieces")
    tails = open_ones.groupBy("conv").agg(order).select("pieces").mapInArrow(
        _tails, "part int, no long, after array<long>, last boolean")
    starts = materialize(spark, open_ones.select(
        "conv", "part", "no", F.transform("rows", lambda r: F.struct(r["of"].alias("of"), r["n"].alias(
            "n"))).alias("runs")).join(tails, ["part", "no"]).mapInArrow(
                _every_start, "conv string, part int, no long, audits array<string>, ends array<int>"),
        "conversation-edits")
    chain = starts.groupBy("conv").agg(F.sort_array(F.collect_list(
        F.struct("part", "no", "ends"))).alias("pieces")).select("pieces").mapInArrow(
            _chain, "part int, no long, start int")
    closed = open_ones.join(starts.select("part", "no", "audits"), ["part", "no"]).join(
        chain, ["part", "no"]).select(*pieces.columns, "audits", "start").mapInArrow(_repair, _PIECE_SQL)
    return pieces.filter("whole").unionByName(closed).drop("rows", "matrix", "whole")


_REPORT = pa.schema([
    ("conv", pa.string()), ("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()),
    ("truncated", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()),
    ("repaired_sha256", pa.string())])


def _fold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order to one row per conversation; texts are hashed as they stream by."""
    now, made = None, []

    def close() -> None:
        turns = now["turns"] and now["last_turn"] - now["first_turn"] + 1 - now["turns"]
        made.append({"conv": now["conv"], "gaps": turns, "audit": "".join(now["audits"]),
                     "repaired_sha256": now["hash"].hexdigest()} | {
            k: now[k] for k in ("blank", "duplicate", "truncated", "illegal", "cost")})

    for batch in batches:
        for one in range(len(batch)):
            p = batch.slice(one, 1).to_pylist()[0]
            if now is None or p["conv"] != now["conv"]:
                if now is not None:
                    close()
                now = {"conv": p["conv"], "audits": [], "hash": hashlib.sha256(), "lines": False,
                       "turns": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0,
                       "last_role": None, "last_turn": None, "first_turn": None}
            for k in ("blank", "duplicate", "truncated", "illegal", "cost", "turns"):
                now[k] += p[k]
            if p["repaired"]:
                now["hash"].update(("\n" * now["lines"] + p["repaired"]).encode())
                now["lines"] = True
            now["audits"].append(p["audit"])
            if p["first_role"] is not None:
                if now["last_role"] is not None:
                    now["illegal"] += now["last_role"] + p["first_role"] not in _LEGAL
                now["last_role"] = p["last_role"]
            if p["first_turn"] is not None:
                if now["first_turn"] is None:
                    now["first_turn"] = p["first_turn"]
                now["turns"] -= now["last_turn"] == p["first_turn"]
                now["last_turn"] = p["last_turn"]
        if len(made) >= 1000:
            yield pa.RecordBatch.from_pylist(made, _REPORT)
            made = []
    if now is not None:
        close()
    if made:
        yield pa.RecordBatch.from_pylist(made, _REPORT)


def repair_report(rows: DataFrame, conv_col: str = "conv_id", **options) -> DataFrame:
    """One row per conversation: gaps, faults, illegal neighbours, cost, audit and the hash.

    A hash over all lines of a conversation has to read them in order, so the pieces of one
    conversation stream through one task, one at a time.
    """
    pieces = conversation_pieces(rows, conv_col, **options)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = pieces.repartition(parts, "conv").sortWithinPartitions("conv", "part", "no").mapInArrow(
        _fold, "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, "
               "cost long, audit string, repaired_sha256 string")
    kind = dict(rows.dtypes)[conv_col]
    return found.select(F.col("conv").cast(kind).alias(conv_col), *found.columns[1:])
