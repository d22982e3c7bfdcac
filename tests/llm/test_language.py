"""Code lengths against a plain PPM, and held-out accuracy."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import language
from plumbline.llm.language import context_counts, fit_languages, identify_languages
from plumbline.llm.language_queries import op13_language


def plain_counts(texts, order, nodes):
    """Counts of (context, byte) for contexts of up to ``order`` bytes; the most frequent ones, of
    which equally frequent ones stay or go together."""
    found = Counter()
    for text in texts:
        data = b"\n" * order + text.encode()
        for i in range(order, len(data)):
            for k in range(order + 1):
                found[data[i - k:i], data[i]] += 1
    least = min((n for n in found.values() if sum(m >= n for m in found.values()) <= nodes), default=1 << 60)
    best = [x for x in found.items() if x[1] >= least]
    tree = {}
    for (context, byte), n in best:
        tree.setdefault(context, {})[byte] = n
    return tree


def plain_bits(tree, text, order):
    data, total = b"\n" * order + text.encode(), 0.0
    for i in range(order, len(data)):
        without = set()
        for k in range(order, -1, -1):
            seen = tree.get(data[i - k:i])
            if seen is None:
                continue
            seen = {b: n for b, n in seen.items() if b not in without}
            both = sum(seen.values()) + len(seen)
            if data[i] in seen:
                total += math.log2(both / seen[data[i]])
                break
            if seen:
                total += math.log2(both / len(seen))
            without |= set(seen)
        else:
            total += math.log2(256 - len(without))
    return total


TEXTS = {"x": ["ab abc abca é", "", "bca bca cab", "zz top, zz"], "y": ["0101 1100", "é è ê", "10 10 10 1"],
         "z": [""]}


@pytest.mark.parametrize("order,nodes", [(4, 100_000), (2, 100_000), (3, 25), (0, 100_000)])
def test_code_lengths_equal_plain_ppm(spark, monkeypatch, order, nodes):
    monkeypatch.setattr(language, "_SLICE", 7)
    rows = [(lang, t) for lang, own in TEXTS.items() for t in own]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    trees = {lang: plain_counts(own, order, nodes) for lang, own in TEXTS.items()}
    kept = {(r["lang"], r["size"], r["key"]): r["n"] for r in context_counts(df, order, nodes).collect()}
    assert kept == {(lang, len(c), int.from_bytes(c + bytes([b]), "big")): n for lang, tree in trees.items()
                    for c, own in tree.items() for b, n in own.items()}
    for cells in (1_000_000, 9, 0):  # code lengths do not depend on the table
        model = fit_languages(df, order=order, nodes=nodes, cells=cells)
        assert model.names == ["x", "y"]  # nothing was seen of z
        texts = ["abca", "zq", "", "é 10", "ab abc abca é, top\x00ÿ", "ab" * 40]
        got = model.code_lengths([t.encode() for t in texts])
        want = [[plain_bits(trees[name], t, order) for name in model.names] for t in texts]
        np.testing.assert_allclose(got, want, rtol=1e-5, atol=1e-4)


def test_the_code_is_complete(spark):
    """Over all bytes that may follow, the probabilities of a context sum to one."""
    df = spark.createDataFrame([("x", t) for t in TEXTS["x"]], "lang string, text string")
    tree = fit_languages(df, order=3).trees[0]
    for context in (b"\n\n\n", b"abc", b"qab", b"qqq"):
        pairs = np.array([int.from_bytes(context + bytes([b]), "big") for b in range(256)], np.uint64)
        assert abs(np.exp2(-tree.bits(pairs)).sum() - 1) < 1e-9


def test_held_out_accuracy_and_cases(spark, tmp_path):
    rng = random.Random(5)
    parts = {"en": "the ing tion and er re", "fr": "le eau tion é que ou", "de": "der ung sch ü ie keit"}
    rows = []
    for i in range(600):
        lang = rng.choice(list(parts))
        words = ["".join(rng.choices(parts[lang].split(), k=rng.randrange(1, 4))) for _ in range(30)]
        rows.append((i, " ".join(words), None if i % 50 == 7 else lang, 1.0, "und"))
    rows += [(1000, None, "en", 0.0, ""), (1001, "", "en", 0.0, ""), (1002, "12 34!", "fr", 0.0, ""),
             (None, "the tion", "xx", 0.0, ""), (5, "keit ung der ie", "fr", 0.0, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, Lang_pred string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = op13_language(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    truth = {r[0]: r[2] for r in rows[:600]}
    told = [(truth[r.doc_id], r.lang_pred, r.held_out) for r in got if truth.get(r.doc_id) and r.doc_id != 5]
    assert sum(h for *_, h in told) > 100 and all(a == b for a, b, _ in told)
    edge = {r.doc_id: (r.lang_pred, r.score) for r in got if r.doc_id is None or r.doc_id >= 1000}
    assert edge[1000] == edge[1001] == edge[1002] == ("und", 0.0) and edge[None][0] == "en"
    assert all(0 <= r.score <= 1 for r in got)
    nobody = identify_languages(df, F.lit(False)).select("lang_pred", "score").distinct().collect()
    assert [tuple(r) for r in nobody] == [("und", 0.0)]
    assert identify_languages(df.limit(0), F.lit(True)).count() == 0
