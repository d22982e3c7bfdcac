"""SimHash against brute force."""

import re

import numpy as np
import pytest
import xxhash

from plumbline.llm.components import components
from plumbline.llm.simhash import (block_links, fingerprint, fingerprint_links, near_duplicates,
                                   one_per_group, shingle_set, wide_sketch)


def brute_fingerprint(text, n):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    grams = [" ".join(words[i:i + n]) for i in range(len(words) - n + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_roots(fps, radius, same=lambda i, j: True):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if same(i, j) and (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]


def near_families(rng, families, radius):
    fps = set()
    for _ in range(families):
        x = int(rng.integers(0, 2 ** 64, dtype=np.uint64))
        for _ in range(rng.integers(1, 10)):
            for _ in range(rng.integers(0, radius + 2)):
                x ^= 1 << int(rng.integers(64))
            fps.add(x)
    return sorted(fps)


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 5])
def test_block_links_span_what_is_near(radius):
    rng = np.random.default_rng(radius)
    fps = near_families(rng, 40, radius)
    bins = np.unique(np.sort(rng.integers(0, 9, len(fps))), return_inverse=True)[1]
    raw = np.array(fps, np.uint64).view(np.uint8).reshape(-1, 8)
    links = list(zip(*(x.tolist() for x in block_links(raw, bins, radius))))
    assert all((fps[a] ^ fps[b]).bit_count() <= radius and bins[a] == bins[b] for a, b in links)
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    assert [find(i) for i in range(len(fps))] == brute_roots(
        fps, radius, lambda i, j: bins[i] == bins[j])


@pytest.mark.parametrize("block", [4, 8192])
def test_links_between_all_bins(spark, block):
    fps = near_families(np.random.default_rng(9), 30, 2)
    signed = [f - 2 ** 64 if f >> 63 else f for f in fps]
    frame = spark.createDataFrame([(f,) for f in signed], "fp long")
    got = {r.node: r.root for r in components(fingerprint_links(frame, 2, block=block)).collect()}
    roots = brute_roots(fps, 2)
    for i, r in enumerate(roots):
        group = [signed[k] for k, x in enumerate(roots) if x == r]
        assert got.get(signed[i], signed[i]) == min(group)


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7)],
                                  "a long, b long")
    got = {r.node: r.root for r in components(links).collect()}
    assert got == {i: 0 for i in range(1, 201)} | {501: 500}


def test_documents(spark):
    long = "word " * 30_000 + "end"
    texts = ["A b c d e f g", "a B c\td e\nf g", "", None, "  \n", "one", "One two", "é É x y z",
             long, long + " more", "a b c d e f h"]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(None, "one", 1), (0, texts[0], 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = near_duplicates(docs).collect()
    assert len(got) == len(rows)
    want = [brute_fingerprint(t or "", 3) for t in texts]
    roots = brute_roots(want, 2)
    for r in got:
        if r.doc_id is None:
            assert r.component_id == 5
        else:
            assert int(r.fingerprint, 16) == want[r.doc_id] == fingerprint(texts[r.doc_id] or "", 3)
            assert r.component_id == roots[r.doc_id]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(docs).count() == 0


@pytest.mark.parametrize("block", [3, 8192])
def test_one_per_group(spark, block):
    rng = np.random.default_rng(4)
    rows, family = [], []
    for f in range(25):
        words = [f"w{x}" for x in rng.integers(0, 3000, rng.integers(60, 400))]
        for copy in range(6):
            mine = list(words)
            if copy:
                for _ in range(max(1, len(mine) // 120)):
                    mine[rng.integers(len(mine))] = f"n{rng.integers(9999)}"
            family.append(f)
            rows.append((len(rows), " ".join(mine), "s"))
    docs = spark.createDataFrame(rows + rows[:2] + [(None, None, "s"), (None, "", "t")],
                                 "doc_id long, text string, fp string")
    kept = one_per_group(docs, block=block)
    assert kept.columns == docs.columns
    got = kept.collect()
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == [6 * f for f in range(25)]
    assert len(got) == 26  # texts without words are one group
    assert one_per_group(docs.limit(0)).count() == 0


def test_one_per_group_has_its_border_at_the_similarity(spark):
    rows, want = [], []

    def add(words, stays):
        if stays:
            want.append(len(rows))
        rows.append((len(rows), " ".join(words)))

    for pair in range(40):
        for common, own, apart in ((400, 50, False), (399, 51, True), (4, 0, False)):
            shared = [f"c{pair}-{common}-{x}" for x in range(common)]
            sides = [[f"{side}{pair}-{common}-{x}" for x in range(own)] for side in "ab"]
            add(shared + sides[0], True)
            add(shared + (sides[1] or ["e"]), apart)  # 400 of 500, 399 of 501, 4 of 5
    for member in range(60):  # a template: 360 of 480 between any two
        add([f"t{x}" for x in range(360)] + [f"m{member}-{x}" for x in range(60)], True)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for block in (8192, 16):
        got = one_per_group(docs, shingle=1, similarity=0.8, block=block)
        assert sorted(r.doc_id for r in got.collect()) == want


def test_repeated_passages_vote_once():
    words = [f"w{x}" for x in range(40_000)]
    often = words[:3000] * 30
    sketches = [wide_sketch(shingle_set(" ".join(text), 1), 8, 12)
                for text in (words, words + often, often + words, words[::-1] + often)]
    assert len(shingle_set(" ".join(words + often), 1)) == 40_000
    assert all(s == sketches[0] for s in sketches)


def test_long_texts_with_repeated_passages_are_one_group(spark):
    rng = np.random.default_rng(6)
    words = [f"w{x}" for x in rng.permutation(34_000)]
    rows = [(0, " ".join(words)), (1, " ".join(words + words[:1500] * 660))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r.doc_id for r in one_per_group(docs).collect()] == [0]
