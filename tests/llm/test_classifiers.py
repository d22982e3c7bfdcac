"""Quality and toxicity classifiers: what they learn, and held-out accuracy."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm.quality import fit_rules, keep_quality, score_quality, with_statistics
from plumbline.llm.text import learns
from plumbline.llm.toxicity import ToxicityModel, fit_noisy_or, score_toxicity

WORDS = ["ran", "then", "over", "house", "maybe", "light", "seven", "paper", "walks", "under"]


def clean(rng, n=None):
    out = [" ".join(rng.choices(WORDS, k=rng.randint(4, 12))).capitalize() + "." for _ in range(
        n or rng.randint(1, 12))]
    return rng.choice([" ", "\n"]).join(out)


def junk(rng):
    kind = rng.randint(0, 2)
    if kind == 0:
        return "\n".join(w.upper() + "!!" for w in rng.choices(WORDS, k=60))
    if kind == 1:
        return " ".join(w for w in rng.choices(WORDS, k=6) for _ in range(20))
    return " ".join(w + "###$$" for w in rng.choices(WORDS, k=50))


def test_learns_follows_crc32(spark):
    got = spark.range(200).select("id", learns("id").alias("l")).collect()
    assert all(r.l == (zlib.crc32(str(r.id).encode()) % 4 != 2) for r in got)
    assert spark.range(1).select(F.lit(None).cast("long").alias("i")).select(learns("i")).head()[0] is False


def test_quality_separates_junk(spark):
    rng = random.Random(2)
    rows = [(i, junk(rng) if i % 4 == 0 else clean(rng), "en", float(i)) for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(0, 1200, 2)] + [
        (None, 0), (2, None)], "doc_id long, quality int")
    got = {r.doc_id: r.score for r in score_quality(docs, labels, learns("doc_id")).collect()}
    assert len(got) == 1200 and all(0 <= s <= 1 for s in got.values())
    assert np.mean([(got[i] >= 0.7) == (i % 4 != 0) for i in got]) > 0.98
    kept = keep_quality(docs, labels, learns("doc_id"))
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, s in got.items() if s >= 0.5}


def test_rules_are_sparse_and_compile(spark):
    rng = random.Random(3)
    docs = spark.createDataFrame([(i, junk(rng) if i % 2 else clean(rng)) for i in range(400)],
                                 "doc_id long, text string")
    examples = with_statistics(docs, "text").select(
        "stats", (F.col("doc_id") % 2).cast("int").alias("label")).cache()
    model = fit_rules(examples, trees=10)
    assert 0 < len(model.weights) < 60
    for row in examples.withColumn("s", model.score()).limit(50).collect():
        total = model.bias + sum(w for rule, w in model.weights.items() if all(
            low < row.stats[n] <= high for n, low, high in rule.bounds))
        assert row.s == pytest.approx(1 / (1 + np.exp(-total)))


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "a b"), (4, "word " * 100_000)],
                                 "doc_id long, text string")
    one_class = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")
    got = score_quality(docs, one_class, F.lit(True)).collect()
    assert len(got) == 4 and all(r.score == pytest.approx(0.75) for r in got)
    none = one_class.limit(0)
    assert {r.score for r in score_quality(docs, none, F.lit(True)).collect()} == {0.5}
    assert score_quality(docs.limit(0), one_class, F.lit(True)).count() == 0
    stats = {r.doc_id: r.stats for r in with_statistics(docs, "text").collect()}
    assert set(stats[1]) == set(stats[2]) == {0.0} and stats[4]["log_words"] > 11
    with pytest.raises(ValueError):
        with_statistics(docs.withColumn("stats", F.lit(1)), "text")


def toxic(rng, text):
    """Put one to three sentences with a bad word, or an ending of a bad stem, into a text."""
    parts = [s for s in text.replace("\n", " ").split(". ") if s]
    for _ in range(rng.randint(1, 3)):
        bad = rng.choice(["vilest", "grubbo" + rng.choice("aeiou") * rng.randint(1, 4)])
        parts.insert(rng.randint(0, len(parts)), f"You {bad} {rng.choice(WORDS)}")
    return ". ".join(parts)


def test_toxicity_learns_from_documents_and_finds_sentences(spark):
    rng = random.Random(4)
    rows = []
    for i in range(1500):
        text = clean(rng)
        rows.append((i, toxic(rng, text) if i % 5 == 0 else text, 0.5))
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(1500)] + [(None, 1), (3, None)],
                                   "doc_id long, toxic int")
    out = score_toxicity(docs, labels, learns("doc_id")).collect()
    held = [r for r in out if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(out) == 1500 and len(held) > 300
    assert np.mean([(r.score >= 0.3) == (r.doc_id % 5 == 0) for r in held]) > 0.98
    texts = {i: t for i, t, _ in rows}
    found = missed = 0
    for r in held:
        for s in r.offending:
            part = texts[r.doc_id][s.start:s.end]
            found += "vilest" in part or "grubbo" in part
            missed += not ("vilest" in part or "grubbo" in part)
    assert found > 50 and missed < found / 20


def test_noisy_or_needs_no_sentence_labels():
    rng = np.random.default_rng(5)
    bags, labels = [], []
    for _ in range(600):
        bag = [sorted(set(rng.integers(1, 12, 3).tolist())) for _ in range(rng.integers(1, 6))]
        y = int(rng.random() < 0.4)
        if y:
            bag[0] = sorted({0, *bag[0]})
        bags.append(bag)
        labels.append(y)
    weights, bias = fit_noisy_or(np.array(labels), np.zeros(600), bags, 12, np.zeros(12))
    assert weights[0] + bias > 1 and (weights[1:] + bias < -1).all()


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "bad"), (4, "İ bad. " * 20_000)],
                                 "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in score_toxicity(docs, none, F.lit(True)).collect()} == {0.5}
    model = ToxicityModel(-5.0, {"bad": 9.0})
    judge = model.scorer()
    assert judge("") == (0.0, [])
    text = "Fine words. A BAD one! İ bad"
    score, spans = judge(text)
    assert score > 0.99 and [text[a:b].strip() for a, b, _ in spans] == ["A BAD one!", "İ bad"]
    assert score_toxicity(docs.limit(0), none, F.lit(True)).count() == 0
