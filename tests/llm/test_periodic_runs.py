"""Periodic runs against plain search over all periods and places."""

import hashlib
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import periodic_runs as pr
from plumbline.llm.periodic_runs import CoverExtensions, find_runs, periodic_runs
from plumbline.llm.run_queries import op11_periodic_runs, with_repeats


def plain_runs(words, least=24, times=3):
    """(start, end, period): maximal stretches of equal words p apart, with no shorter period."""
    out = {}
    n = len(words)
    for p in range(1, n // times + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            s = i
            while i + p < n and words[i] == words[i + p]:
                i += 1
            if i + p - s >= max(least, times * p):
                out.setdefault((s, i + p), p)
    return sorted((s, e, p) for (s, e), p in out.items())


def test_the_cover_has_all_differences():
    cover = pr._COVER
    assert {(a - b) % pr._MODULUS for a in cover for b in cover} == set(range(pr._MODULUS))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=1, max_size=12), st.integers(1, 60), st.integers(0, 400),
       st.randoms(use_true_random=False))
def test_extensions(block, repeat, at, rng):
    seq = np.array(block * repeat)
    if at < len(seq):
        seq[at] = 3
    n = len(seq)
    i = np.array([rng.randrange(n) for _ in range(30)])
    j = np.array([rng.randrange(n + 1) for _ in range(30)])
    i, j = i[i != j], j[i != j]
    got = CoverExtensions(seq)(i, j)
    for a, b, length in zip(i.tolist(), j.tolist(), got.tolist()):
        want = 0
        while max(a, b) + want < n and seq[a + want] == seq[b + want]:
            want += 1
        assert length == want


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=14),
                                   st.integers(1, 9)), max_size=5), max_size=5),
       st.sampled_from([(24, 3), (3, 2), (6, 3), (10, 2)]))
def test_runs_equal_plain_search(texts, bounds):
    texts = [[w for block, times in t for w in block * times] for t in texts]
    numbers = np.array([w for t in texts for w in t], np.int64)
    got = find_runs([len(t) for t in texts], numbers, *bounds).tolist()
    want = [[k, *r] for k, t in enumerate(texts) for r in plain_runs(t, *bounds)]
    assert got == sorted(want, key=lambda r: (r[0], r[1], r[3]))


def test_long_texts_and_portions(monkeypatch):
    rng = np.random.default_rng(3)
    same = np.zeros(30_000, np.int64)
    assert find_runs([30_000], same).tolist() == [[0, 0, 30_000, 1]]
    block = rng.integers(0, 5000, 2000)
    seq = np.concatenate([rng.integers(0, 5000, 500), np.tile(block, 4)[:7700], [1, 2]])
    monkeypatch.setattr(pr, "_POINTS", 1000)
    got = find_runs([len(seq)], seq).tolist()
    assert got == [[0, *r] for r in plain_runs(seq.tolist())]
    assert find_runs([], np.empty(0, np.int64)).shape == (0, 4)
    with pytest.raises(ValueError):
        find_runs([3], np.zeros(3, np.int64), 2, 2)


def plain_row(doc_id, text, damage=True):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if damage and h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = sorted(plain_runs(words), key=lambda r: (r[0], r[2]))
    best = min(runs, key=lambda r: (-Fraction(r[1] - r[0], r[2]), r[0], r[2]), default=None)
    drop = {i for s, e, p in runs for i in range(s + p, e)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *((best[0], best[1] - best[0], best[2],
                                  1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4),
            sha("".join(f"{s},{e - s},{p}\n" for s, e, p in runs)),
            sha(" ".join(w for i, w in enumerate(words) if i not in drop)))


def test_query_equals_plain_python(spark, tmp_path):
    rng = np.random.default_rng(9)
    rows = []
    for i in range(250):
        n = int(rng.integers(0, 400))
        words = [f"w{k}é" for k in rng.integers(0, 4 if i % 3 else 4000, n)]
        rows.append((i, rng.choice([" ", "\n", "\t\x0b "]).join(words) + " " * (i % 2), "x", i, 7))
    rows += [(1000, None, "x", 1, 7), (1001, "", "x", 1, 7), (1002, " \n", "x", 1, 7), (None, "a " * 50, "x", 1, 7),
             (5, "b c " * 30, "x", 1, 7), (5, "b c " * 30, "x", 1, 7), (1003, "z\x85z " * 20_000, "x", 1, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string, period int, Best int")
    df.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in op11_periodic_runs(spark, str(tmp_path)).collect()]
    small = [r for r in rows if r[0] != 1003]
    assert sorted(map(repr, [r for r in got if r[0] != 1003])) == sorted(
        repr(plain_row(r[0], r[1])) for r in small)
    assert [r[1:6] for r in got if r[0] == 1003] == [(1, 0, 20_000, 1, 20_000_000)]
    assert sum(zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in rows) > 15
    assert periodic_runs(with_repeats(df).limit(0)).count() == 0
