"""Toxicity by multiple-instance learning.

A text is a bag of sentences. A sentence has probability ``sigmoid(bias + sum of its features'
weights)``, and the text is toxic if any sentence is (noisy-or):
``1 - product(1 - sentence probability)``. Only texts carry labels, and the weights are fitted to
those; the sentence scores then say where a toxic text offends. Features are a sentence's words and
their first four and five characters, so that unseen endings of a known stem still count.

The fit reads at most about ``sample`` labelled texts of ``longest`` characters at most and about
``sample_chars`` together, drawn by hashes of their ids, and uses the ``vocabulary`` features that are
most surely commoner in toxic texts (chi-square). Scoring reads every text whole.

Cases: null and empty texts have no sentence and score 0. Labels that are null, or whose id is null,
are not learned from. Without two classes to learn from the vocabulary is empty and every text
scores the smoothed share of toxic labels. Repeated rows get equal scores and an empty table gives
an empty result. Only id and text are read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.sample import bounded_sample
from plumbline.llm.text import whole
from plumbline.session import materialize

_SENTENCE = re.compile(r"[^.!?\n]+[.!?\n]*")
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_STEMS = (4, 5)
_REMEMBERED = 200_000  # words whose features a task keeps at hand


def sentences(text: str) -> Iterator[tuple[int, int]]:
    """Start and end of each sentence."""
    return ((m.start(), m.end()) for m in _SENTENCE.finditer(text))


def word_features(word: str) -> list[str]:
    """A word and its stems, which end with a star."""
    return [word] + [word[:n] + "*" for n in _STEMS if len(word) > n]


def _features(words: Iterable[str]) -> set[str]:
    return {f for w in words for f in word_features(w)}


def _words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


@dataclass
class ToxicityModel:
    """Feature weights and the bias of a sentence."""

    bias: float
    weights: dict[str, float] = field(default_factory=dict)
    prior: float | None = None

    def scorer(self):
        """A function of a text: its score and its sentences with any known feature."""
        known: dict[str, float] = {}
        plain = np.log1p(-_sigmoid(self.bias))

        def weight(word: str) -> float:
            if word not in known:
                if len(known) >= _REMEMBERED:
                    known.clear()
                known[word] = sum(self.weights.get(f, 0.0) for f in word_features(word))
            return known[word]

        def score(text: str) -> tuple[float, list[tuple[int, int, float]]]:
            if self.prior is not None:
                return self.prior, []
            clean, found = 0.0, []
            lowered = text.lower()
            if len(lowered) != len(text):  # spans must fit the text
                lowered = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
            for start, end in sentences(lowered):
                words = set(_WORD.findall(lowered, start, end))
                total = 0.0
                for w in words:
                    total += known[w] if w in known else weight(w)
                if total:
                    p = float(_sigmoid(self.bias + total))
                    clean += np.log1p(-min(p, 1 - 1e-12))
                    found.append((start, end, p))
                elif words:
                    clean += plain
            return float(-np.expm1(clean)), found

        return score


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def _count_features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many toxic and other texts have each feature; partial sums of a partition."""
    counts: tuple[Counter, Counter] = Counter(), Counter()

    def flush() -> pa.RecordBatch:
        names = list(counts[0].keys() | counts[1].keys())
        out = pa.record_batch({"feature": pa.array(names, pa.string()),
                               "others": pa.array([counts[0][n] for n in names], pa.int64()),
                               "toxic": pa.array([counts[1][n] for n in names], pa.int64())})
        counts[0].clear()
        counts[1].clear()
        return out

    for batch in batches:
        for text, label in zip(batch["text"].to_pylist(), batch["label"].to_pylist()):
            counts[label].update(_features(set(_words(text))))
            if len(counts[0]) + len(counts[1]) > 2_000_000:
                yield flush()
    yield flush()


def _bags(vocabulary: dict[str, int]):
    """A function that turns texts into bags: known features by sentence, and other sentences."""
    def bags(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            plain, known = [], []
            for text in batch["text"].to_pylist():
                found, n = [], 0
                for start, end in sentences(text):
                    words = set(_words(text[start:end]))
                    ids = sorted({vocabulary[f] for f in _features(words) if f in vocabulary})
                    if ids:
                        found.append(ids)
                    else:
                        n += bool(words)
                plain.append(n)
                known.append(found)
            yield pa.record_batch({"label": batch["label"], "plain": pa.array(plain, pa.int64()),
                                   "known": pa.array(known, pa.list_(pa.list_(pa.int32())))})
    return bags


def fit_noisy_or(labels: np.ndarray, plain: np.ndarray, bags: list[list[list[int]]], features: int,
                 start: np.ndarray, *, bias: float = -6.0, decay: float = 1e-5,
                 steps: int = 500, rate: float = 0.1) -> tuple[np.ndarray, float]:
    """Weights and bias that fit noisy-or bags to their labels, by full-batch Adam.

    ``decay`` draws the weights towards ``start``, their log-odds over whole texts.
    """
    bag_of = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    rows = [s for b in bags for s in b]
    row_of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    ids = np.fromiter((i for r in rows for i in r), np.int64, len(row_of))
    theta = np.append(start, bias)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        p = _sigmoid(theta[-1] + np.bincount(row_of, theta[ids], len(rows)))
        p0 = _sigmoid(theta[-1])
        clean = np.bincount(bag_of, np.log1p(-np.minimum(p, 1 - 1e-12)), len(bags)) + (
            plain * np.log1p(-p0))
        q = np.exp(clean)
        # d loss / d sentence logit = p * pull, by the chain rule through the product
        pull = np.where(labels == 1, -q / np.maximum(1 - q, 1e-9), 1.0)
        by_row = p * pull[bag_of]
        grad = np.append(np.bincount(ids, by_row[row_of], features),
                         by_row.sum() + (plain * pull).sum() * p0) / len(bags)
        grad[:-1] += decay * (theta[:-1] - start)
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad * grad
        theta = theta - rate * (first / (1 - 0.9 ** step)) / (
            np.sqrt(second / (1 - 0.999 ** step)) + 1e-8)
    return theta[:-1], float(theta[-1])


def fit_toxicity(examples: DataFrame, *, vocabulary: int = 4000, min_texts: int = 4) -> ToxicityModel:
    """Learn from ``text`` and a 0/1 ``label``; the caller bounds the number of examples."""
    totals = {r["label"]: r["count"] for r in examples.groupBy("label").count().collect()}
    if len(totals) < 2:
        return ToxicityModel(0.0, prior=(totals.get(1, 0) + 1) / (sum(totals.values()) + 2))
    n0, n1 = totals[0], totals[1]
    a, b = F.col("toxic"), F.col("others")
    chi = (a * n0 - b * n1) * (a * n0 - b * n1) * (n0 + n1) / (
        (a + b) * F.greatest(n0 + n1 - a - b, F.lit(1)) * float(n0) * n1)
    chosen = examples.select("text", "label").mapInArrow(
        _count_features, "feature string, others long, toxic long").groupBy("feature").agg(
            F.sum("others").cast("double").alias("others"),
            F.sum("toxic").cast("double").alias("toxic")).filter(a + b >= min_texts).select(
                "feature", "others", "toxic", chi.alias("chi")).filter((F.col("chi") > 10.83) & (a * n0 > b * n1)).orderBy(
                    F.desc("chi"), "feature").limit(vocabulary).collect()
    names = {r["feature"]: i for i, r in enumerate(chosen)}
    odds = np.array([np.log((r["toxic"] + 0.1) / n1) - np.log((r["others"] + 0.1) / n0)
                     for r in chosen])
    found = examples.select("text", "label").mapInArrow(
        _bags(names), "label int, plain long, known array<array<int>>").collect()
    weights, bias = fit_noisy_or(
        np.array([r["label"] for r in found]), np.array([r["plain"] for r in found]),
        [r["known"] for r in found], len(names), np.clip(odds, 0, 8))
    return ToxicityModel(bias, {n: float(w) for n, w in zip(names, weights) if w})


def score_toxicity(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id",
                   text_col: str = "text", label_col: str = "toxic", *, sample: int = 20_000,
                   sample_chars: int = 64_000_000, longest: int = 1_000_000,
                   offends: float = 0.5) -> DataFrame:
    """Id, ``score`` and ``offending`` sentences (start, end, score) per row of ``docs``.

    ``learn`` is an expression over ``labels`` that says which rows may be learned from.
    """
    spark = docs.sparkSession
    read = docs.select(F.col(id_col).alias("_id"), whole(text_col).alias("text"))
    known = bounded_sample(labels.filter(learn & F.col(label_col).isin(0, 1)), id_col, sample)
    examples = materialize(spark, read.join(known.select(F.col(id_col).alias("_id"), F.col(
        label_col).cast("int").alias("label")), "_id").filter(F.char_length("text") <= longest).select(
            "text", "label", F.pmod(F.xxhash64(F.lit("length"), "_id"), F.lit(1 << 32)).alias("_draw")),
        "toxicity-examples")
    chars = examples.agg(F.sum(F.char_length("text"))).first()[0] or 0
    if chars > sample_chars:
        examples = examples.filter(F.col("_draw") < int(sample_chars / chars * (1 << 32)))
    model = fit_toxicity(examples.select("text", "label"))

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = model.scorer()
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()),
                                   ("score", pa.float64())]))
        for batch in batches:
            judged = [judge(t.as_py()) for t in batch["text"]]
            yield pa.record_batch({
                "_id": batch["_id"], "score": pa.array([s for s, _ in judged], pa.float64()),
                "offending": pa.array([[{"start": a, "end": b, "score": p} for a, b, p in found
                                        if p >= offends] for _, found in judged], kind)})

    kind = dict(read.dtypes)["_id"]
    out = read.mapInArrow(score, f"_id {kind}, score double, "
                                 "offending array<struct<start:int,end:int,score:double>>")
    return out.withColumnRenamed("_id", id_col)
