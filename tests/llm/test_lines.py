"""Line deduplication against plain Python."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from plumbline.llm.line_dedup import drop_repeated_lines

BLANK = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(BLANK))


def brute(rows, min_docs, min_chars, keep_first):
    texts = [(i, t or "") for i, t in rows]
    places = {}
    for d in sorted(set(texts), key=lambda r: (r[0] is not None, r[0])):
        for p, line in enumerate(d[1].split("\n")):
            places.setdefault(key(line), []).append((d, p))
    out = []
    for d in texts:
        kept, lines = [], d[1].split("\n")
        for p, line in enumerate(lines):
            found = places[key(line)]
            often = len(key(line)) >= min_chars and len({x for x, _ in found}) >= min_docs
            if not often or (keep_first and found[0] == (d, p)):
                kept.append(line)
        out.append((d[0], len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def random_rows(seed, count):
    rng = random.Random(seed)
    pool = [" Common Line ", "common line", "É\t", "é", "", "  ", "x", "\x0bTail\x0c"] + [
        f"own {i}" for i in range(30)]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.choice([1, 3, 9, 200]))))
            for i in range(count)]
    return rows + [rows[0], (None, "own 1\ncommon line"), (count, None), (count + 1, "")]


@pytest.mark.parametrize("keep_first", [True, False])
@pytest.mark.parametrize("min_docs,min_chars", [(2, 1), (5, 1), (3, 4)])
def test_against_plain_python(spark, keep_first, min_docs, min_chars):
    rows = random_rows(min_docs, 40)
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, _pos int")
    got = drop_repeated_lines(docs.repartition(3), min_docs=min_docs, min_chars=min_chars,
                              keep_first=keep_first)
    found = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in got.collect()), key=repr)
    assert found == brute(rows, min_docs, min_chars, keep_first)


def test_bitmap_words_are_sparse(spark):
    lines = [f"line {i}" for i in range(300)]
    lines[70] = lines[200] = "shared"
    docs = spark.createDataFrame([(1, "\n".join(lines)), (2, "shared"), (3, "alone")],
                                 "doc_id long, text string")
    got = {r.doc_id: r for r in drop_repeated_lines(docs, keep_first=False).collect()}
    assert [w.word for w in got[1].keep_bitmap] == [1, 3] and got[1].n_dropped == 2
    assert got[1].keep_bitmap[0].bits == ~(1 << 6)
    assert got[3].keep_bitmap is None and got[2].kept == ""
    assert hashlib.sha256(b"").hexdigest() == docs.select(F.sha2(F.lit(""), 256)).head()[0]
    assert drop_repeated_lines(docs.limit(0)).count() == 0


def test_lines_travel_once(spark):
    """The range partitioning serves the search for first occurrences; only small rows move again."""
    from plumbline.llm.line_dedup import _documents, _lines, line_verdicts

    docs = spark.createDataFrame([(1, "a\nb"), (2, "a")], "doc_id long, text string")
    plan = line_verdicts(_lines(_documents(docs, "doc_id", "text"), 1), 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange rangepartitioning") == 1 and plan.count("Exchange hashpartitioning") == 1
    assert plan.index("Exchange hashpartitioning(_h1") < plan.index("Window") < plan.index("Exchange rangepartitioning")
