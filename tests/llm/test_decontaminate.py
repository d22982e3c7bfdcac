"""Benchmark decontamination against plain Python."""

import random
import re

import pytest

from plumbline.llm.decontaminate import decontaminate, keep_clean


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items, window):
    parts = {}
    for i, t in items:
        w = words(t)
        for a in range(len(w) - min(window, len(w)) + 1):
            if w:
                parts.setdefault(tuple(w[a:a + min(window, len(w))]), set()).add(
                    "null" if i is None else str(i))
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for part, owners in parts.items():
            for a in range(len(w) - len(part) + 1):
                if tuple(w[a:a + len(part)]) == part:
                    hit |= set(range(a, a + len(part)))
                    found |= owners
        out.append((d, len(w), len(hit), tuple(sorted(found))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("window,limit", [(4, 10 ** 6), (10, 10 ** 6), (6, 0)])
def test_against_plain_python(spark, window, limit):
    rng = random.Random(window)
    vocabulary = ["the", "of", "Aa", "é", "x1", "b", "c", "d"]

    def text(n):
        return rng.choice([" ", ", ", "--"]).join(rng.choices(vocabulary, k=n))

    items = [(i, text(rng.choice([1, 2, 3, 5, 12, 25]))) for i in range(12)]
    items += [(3, text(14)), (None, "zz yy"), (90, None), (91, "..."), (92, items[4][1])]
    docs = []
    for i in range(60):
        parts = [text(rng.randint(0, 12))]
        for _ in range(rng.randint(0, 2)):
            parts += [rng.choice(items)[1] or "", text(rng.randint(0, 6))]
        docs.append((i, " ".join(parts)))
    docs += [docs[0], (None, "zz YY"), (70, None), (71, ""), (72, "the " * 3000 + "zz yy")]
    frame = spark.createDataFrame([(*d, "k") for d in docs], "doc_id long, text string, shingle string")
    bench = spark.createDataFrame([(*i, 0) for i in items], "item_id long, text string, doc_id int")
    got = decontaminate(frame, bench, window=window, broadcast_rows=limit).collect()
    want = brute(docs, items, window)
    assert sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r.item_ids)) for r in got), key=repr) == want
    clean = keep_clean(frame, bench, window=window, broadcast_rows=limit)
    assert clean.columns == frame.columns
    assert sorted((r.doc_id for r in clean.collect()), key=repr) == sorted(
        (d for d, _, n, _ in want if not n), key=repr)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    row = decontaminate(docs, none).head()
    assert (row.n_words, row.n_hit, row.item_ids, row.hit_spans) == (2, 0, [], [])
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontaminate(docs.limit(0), items).count() == 0
    assert decontaminate(docs, items).head().hit_spans[0].end == 2
