"""Repeated byte strings against brute force."""

from collections import Counter

import numpy as np
import pytest

from plumbline.llm.suffix_dedup import cut_repeats


def brute(texts, length):
    seen = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                gone[i:i + length] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]])))
        out.append(([tuple(e) for e in edges.reshape(-1, 2).tolist()],
                    bytes(np.frombuffer(t, np.uint8)[~gone])))
    return out


def corpus(rng, count):
    """Texts with shared passages of many lengths at many offsets, copies and periodic stretches."""
    pool = [bytes(rng.integers(97, 101, rng.integers(60, 400), dtype=np.uint8)) for _ in range(6)]
    texts = []
    for _ in range(count):
        parts = []
        for _ in range(rng.integers(1, 6)):
            kind = rng.integers(0, 4)
            if kind == 0:
                p = pool[rng.integers(len(pool))]
                a = rng.integers(0, len(p))
                parts.append(p[a:a + rng.integers(1, 400)])
            elif kind == 1:
                parts.append(b"ha " * int(rng.integers(1, 90)))
            elif kind == 2:
                parts.append("é\x00ü".encode() * int(rng.integers(1, 40)))
            else:
                parts.append(bytes(rng.integers(97, 123, rng.integers(1, 200), dtype=np.uint8)))
        texts.append(b"".join(parts))
    return texts + texts[:3]


def check(spark, texts, **options):
    rows = [(i, t.decode(), "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, place string").repartition(3)
    got = {r.doc_id: r for r in cut_repeats(docs, **options).collect()}
    assert len(got) == len(texts)
    for i, (spans, kept) in enumerate(brute(texts, options["length"])):
        r = got[i]
        assert [tuple(s) for s in r.removed] == spans, i
        assert bytes(r.kept) == kept and r.n_bytes == len(texts[i])


@pytest.mark.parametrize("seed", range(4))
def test_against_brute_force(spark, seed):
    check(spark, corpus(np.random.default_rng(seed), 40), length=80, gram=16)


@pytest.mark.parametrize("rows", [2, 5])
def test_large_buckets(spark, rows):
    check(spark, corpus(np.random.default_rng(7), 40), length=80, gram=16, bucket_rows=rows)


def test_production_length(spark):
    rng = np.random.default_rng(3)
    base = bytes(rng.integers(97, 123, 3000, dtype=np.uint8))
    texts = [base, base[500:1200] + b"tail", b"x" + base[700:1099], b"y" + base[1500:1900] + b"z",
             base[2000:2500] + base[2000:2500], b"q" * 5000, b"", b"short"]
    check(spark, texts, length=400, gram=64)


def test_long_text_over_buffers(spark, monkeypatch):
    from plumbline.llm import suffix_dedup

    monkeypatch.setattr(suffix_dedup, "_BUFFER", 700)
    check(spark, corpus(np.random.default_rng(5), 25), length=80, gram=16)


def test_odd_rows(spark):
    text = "abc" * 200
    docs = spark.createDataFrame([(None, text), (None, text), (1, None), (1, ""), (2, "own" * 3)],
                                 "doc_id long, text string")
    got = sorted((r.doc_id is not None, r.n_bytes, len(r.kept)) for r in cut_repeats(
        docs, length=400).collect())
    assert got == [(False, 600, 0), (False, 600, 0), (True, 0, 0), (True, 0, 0), (True, 9, 9)]
    assert cut_repeats(docs.limit(0)).count() == 0


def test_passages_go_by_bytes_not_words(spark, tmp_path):
    """Passages of 51 words in three documents each, of 399, 400 and 460 bytes; others share nothing."""
    from plumbline.llm.suffix_queries import op6_suffix_dedup

    rng = np.random.default_rng(11)

    def words(count, size):
        parts = np.full(count, (size - count + 1) // count)
        parts[:size - count + 1 - parts.sum()] += 1
        return " ".join("".join(map(chr, rng.integers(97, 123, k))) for k in parts)

    rows = []
    for size in (399, 400, 460):
        passage = words(51, size)
        assert len(passage) == size and len(passage.split()) == 51
        rows += [(f"{words(40, 300)}{gap}{passage}{gap}{words(60, 500)}", size) for gap in " \n\t"]
    rows += [(words(200, 1500), 0) for _ in range(4)]
    spark.createDataFrame([(i, text) for i, (text, _) in enumerate(rows)],
                          "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op6_suffix_dedup(spark, str(tmp_path)).collect()}
    for i, (text, size) in enumerate(rows):
        gone = size if size >= 400 else 0
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans) == (len(text), gone, int(gone > 0)), i
