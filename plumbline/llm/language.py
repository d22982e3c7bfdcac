"""Language identification by prediction by partial matching (PPM) over bytes.

Each language has a tree of byte contexts of up to ``order`` bytes, with the counts of the bytes that
follow them in all texts of that language that may be learned from. A text's code length under frozen
counts is the sum over its bytes: the longest context known predicts the byte by its count, or an
escape is coded, with as many counts as the context has different bytes (method C), and the next
shorter context predicts among the bytes the longer one did not have; after the empty context all
remaining bytes are alike. The language with the shortest code is predicted, and the score is its
share of ``2 ** -bits`` over all languages.

A language keeps its most frequent counts over all orders, ``nodes`` at most; of equally frequent
ones it keeps all or none. A shorter context counts at least
as often, so what is kept is a tree again, deeper where there is more to tell. Code lengths of the
``cells`` most frequent pairs of context and byte are worked out once for all languages; those of other
pairs are worked out where they occur, by the same function.

Cases: a text that is null or has no letter is ``und`` with score 0, as is every text when there is no
language to learn from. A text begins after ``order`` line feeds. Ties go to the language that sorts
first. Repeated rows get equal results and an empty table gives an empty result. Only id, text and
language are read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.text import whole
from plumbline.session import materialize

_GROUP_BYTES = 4 << 20  # texts that are looked at together
_SLICE = 1 << 20  # positions looked at at once
_MIX = np.uint64(0x9E3779B97F4A7C15)
_NOTHING = np.iinfo(np.uint64).max


def joined(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts, each behind ``order`` line feeds, and where line feeds and texts begin in turn.

    Texts are not empty.
    """
    pad = b"\n" * order
    data = np.frombuffer(b"".join(part for t in texts for part in (pad, t)), np.uint8)
    sizes = np.array([n for t in texts for n in (order, len(t))], np.int64)
    return data, np.cumsum(sizes) - sizes


def grams(data: np.ndarray, begin: int, end: int, order: int) -> np.ndarray:
    """Per position, its byte and the ``order`` bytes before it as one number."""
    out = np.zeros(end - begin, np.uint64)
    for back in range(order, -1, -1):
        out <<= np.uint64(8)
        first = max(back - begin, 0)  # positions without so many bytes before them
        out[first:] |= data[begin + first - back:end - back]
    return out


def _grouped(texts: Iterable[str]) -> Iterator[list[bytes]]:
    group, size = [], 0
    for text in texts:
        group.append(text.encode())
        size += len(group[-1])
        if size >= _GROUP_BYTES:
            yield group
            group, size = [], 0
    if group:
        yield group


def _count(order: int):
    """Partial counts of the grams of each language."""
    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch["lang"].to_pylist()
            for lang in sorted(set(langs)):
                own = batch["text"].filter(pa.array([x == lang for x in langs]))
                for group in _grouped(t.as_py() for t in own):
                    data, starts = joined([t for t in group if t], order)
                    if not len(data):
                        continue
                    text = np.zeros(len(data) + 1, np.int8)
                    text[starts[1::2]] += 1
                    text[starts[2::2]] -= 1
                    inside = np.cumsum(text[:-1]).astype(bool)
                    for at in range(0, len(data), _SLICE * 4):
                        end = min(at + _SLICE * 4, len(data))
                        found, n = np.unique(grams(data, at, end, order)[inside[at:end]],
                                             return_counts=True)
                        yield pa.record_batch({"lang": pa.array([lang] * len(found), pa.string()),
                                               "gram": pa.array(found.astype(np.int64)),
                                               "n": pa.array(n, pa.int64())})
    return count


def context_counts(texts: DataFrame, order: int, nodes: int) -> DataFrame:
    """``lang``, ``size``, ``key`` and ``n``: the most frequent (context, byte) pairs per language, as
    many as fit in ``nodes`` with all that are as frequent.

    ``size`` is the number of context bytes and ``key`` has context and byte. ``texts`` has ``lang``
    and ``text``.
    """
    full = materialize(texts.sparkSession, texts.select("lang", "text").mapInArrow(
        _count(order), "lang string, gram long, n long").groupBy("lang", "gram").agg(
            F.sum("n").alias("n")), "language-grams")
    sizes = F.explode(F.array([F.struct(F.lit(k).alias("size"), F.lit((1 << 8 * (k + 1)) - 1).cast(
        "long").alias("mask")) for k in range(order + 1)]))
    pairs = full.select("lang", "n", "gram", sizes.alias("s")).groupBy(
        "lang", F.col("s.size").alias("size"), F.col("gram").bitwiseAND(F.col("s.mask")).alias(
            "key")).agg(F.sum("n").alias("n"))
    pairs = materialize(texts.sparkSession, pairs, "language-pairs")
    # few counts differ, so how many pairs have at least each count is a small table
    down = Window.partitionBy("lang").orderBy(F.desc("n"))
    least = pairs.groupBy("lang", "n").agg(F.count("*").alias("m")).withColumn(
        "_upto", F.sum("m").over(down)).filter(F.col("_upto") <= nodes).groupBy("lang").agg(
            F.min("n").alias("_least"))
    # one row per language, of which the model holds a tree each
    return pairs.join(F.broadcast(least), "lang").filter("n >= _least").drop("_least")


def _place(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of ``wanted`` in the sorted ``keys``, -1 where there is none."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


class ContextTree:
    """The frozen context tree of one language."""

    def __init__(self, order: int, sizes: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> None:
        self.order = order
        self.keys, self.counts, self.contexts = [], [], []
        self.total, self.kinds = [], []  # of a context: its counts and its different bytes
        self.rest, self.rest_kinds = [], []  # the same of the next shorter context, without its bytes
        for size in range(order + 1):
            own = np.flatnonzero(sizes == size)
            own = own[np.argsort(keys[own], kind="stable")]
            key, count = keys[own].astype(np.uint64), counts[own].astype(np.float64)
            context = key >> np.uint64(8)
            first = np.flatnonzero(np.diff(context, prepend=_NOTHING) != 0) if len(key) else np.empty(0, int)
            self.keys.append(key)
            self.counts.append(count)
            self.contexts.append(context[first])
            self.total.append(np.add.reduceat(count, first) if len(key) else np.empty(0))
            self.kinds.append(np.diff(first, append=len(key)).astype(np.float64))
            if size:
                shorter = self.counts[-2][_place(self.keys[-2], key & self._mask(size))]
                parent = _place(self.contexts[-2], self.contexts[-1] & self._mask(size - 1))
                gone = np.add.reduceat(shorter, first) if len(key) else np.empty(0)
                self.rest.append(self.total[-2][parent] - gone)
                self.rest_kinds.append(self.kinds[-2][parent] - self.kinds[-1])
            else:
                self.rest.append(np.empty(0))
                self.rest_kinds.append(np.empty(0))

    @staticmethod
    def _mask(count: int) -> np.uint64:
        return np.uint64((1 << 8 * count) - 1)

    def bits(self, pairs: np.ndarray) -> np.ndarray:
        """The code length of each pair of ``order`` context bytes and a byte."""
        out = np.zeros(len(pairs))
        left = np.arange(len(pairs))
        before = np.full(len(pairs), -1)  # the longer context an escape came from
        for size in range(self.order, -1, -1):
            if not len(left):
                break
            own = pairs[left]
            at = _place(self.contexts[size], (own >> np.uint64(8)) & self._mask(size))
            known = at >= 0
            longer = before >= 0
            total, kinds = np.ones(len(left)), np.zeros(len(left))
            fresh = known & ~longer
            total[fresh], kinds[fresh] = self.total[size][at[fresh]], self.kinds[size][at[fresh]]
            if size < self.order:
                total[longer] = self.rest[size + 1][before[longer]]
                kinds[longer] = self.rest_kinds[size + 1][before[longer]]
            pair = np.where(known, _place(self.keys[size], own & self._mask(size + 1)), -1)
            hit = pair >= 0
            both = total + kinds
            out[left[hit]] += np.log2(both[hit] / self.counts[size][pair[hit]])
            escape = known & ~hit & (kinds > 0)
            out[left[escape]] += np.log2(both[escape] / kinds[escape])
            left, before = left[~hit], np.where(known, at, before)[~hit]
        root = self.kinds[0][0] if len(self.kinds[0]) else 0
        out[left] += np.log2(max(256 - root, 1))
        return out


class LanguageModel:
    """Context trees of all languages, and a table of the code lengths of frequent pairs."""

    def __init__(self, names: list[str], trees: list[ContextTree], pairs: np.ndarray) -> None:
        self.names, self.trees, self.order = names, trees, trees[0].order if trees else 0
        self.keys = np.append(np.unique(pairs.astype(np.uint64)), _NOTHING)
        self.table = np.stack([t.bits(self.keys[:-1]).astype(np.float32) for t in trees]) if trees else None
        self.width = max(len(self.keys).bit_length() + 1, 4)
        self.slots = np.full(1 << self.width, -1, np.int32)
        rest, slot = np.arange(len(self.keys) - 1), self._slot(self.keys[:-1])
        while len(rest):  # each to the next slot that is free
            _, first = np.unique(slot, return_index=True)
            first = first[self.slots[slot[first]] < 0]
            self.slots[slot[first]] = rest[first]
            more = np.ones(len(rest), bool)
            more[first] = False
            rest, slot = rest[more], (slot[more] + 1) & ((1 << self.width) - 1)

    def _slot(self, pairs: np.ndarray) -> np.ndarray:
        return (pairs * _MIX >> np.uint64(64 - self.width)).view(np.int64)

    def find(self, pairs: np.ndarray) -> np.ndarray:
        """The row of the table of each pair, -1 where there is none."""
        slot = self._slot(pairs)
        at = self.slots[slot]
        wrong = np.flatnonzero((self.keys[at] != pairs) & (at >= 0))
        while len(wrong):
            slot[wrong] = (slot[wrong] + 1) & ((1 << self.width) - 1)
            at[wrong] = self.slots[slot[wrong]]
            wrong = wrong[(self.keys[at[wrong]] != pairs[wrong]) & (at[wrong] >= 0)]
        return at

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text under each language."""
        out = np.zeros((len(texts), len(self.trees)))
        used = [i for i, t in enumerate(texts) if t]
        if not used:
            return out
        data, starts = joined([texts[i] for i in used], self.order)
        sums = np.zeros((len(starts), len(self.trees)))
        for begin in range(0, len(data), _SLICE):
            end = min(begin + _SLICE, len(data))
            first = int(np.searchsorted(starts, begin, "right")) - 1
            last = int(np.searchsorted(starts, end, "left"))
            cuts = np.maximum(starts[first:last] - begin, 0)
            pairs = grams(data, begin, end, self.order)
            at = self.find(pairs)
            other = np.flatnonzero(at < 0)
            new, of = np.unique(pairs[other], return_inverse=True)
            for j, tree in enumerate(self.trees):
                bits = self.table[j][at] if self.table.shape[1] else np.zeros(len(at), np.float32)
                if len(other):
                    bits[other] = tree.bits(new).astype(np.float32)[of]
                sums[first:last, j] += np.add.reduceat(bits, cuts, dtype=np.float64)
        out[used] = sums[1::2]
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and score of each text."""
        told = [t is not None and any(map(str.isalpha, t)) for t in texts]
        out = [("und", 0.0)] * len(texts)
        if not self.trees:
            return out
        rows = [i for i, yes in enumerate(told) if yes]
        bits = self.code_lengths([texts[i].encode() for i in rows])
        best = np.argmin(bits, axis=1)
        share = 1 / np.exp2(np.minimum(bits.min(axis=1, initial=np.inf)[:, None] - bits, 0)).sum(axis=1)
        for i, j, p in zip(rows, best.tolist(), share.tolist()):
            out[i] = (self.names[j], p)
        return out


def fit_languages(texts: DataFrame, *, order: int = 4, nodes: int = 400_000,
                  cells: int = 4_000_000) -> LanguageModel:
    """Learn from all rows of ``lang`` and ``text``; the model's size is bounded, the counting is not."""
    counts = materialize(texts.sparkSession, context_counts(texts, order, nodes), "language-contexts")
    found = counts.toArrow()
    langs, sizes = np.array(found["lang"].to_pylist(), object), found["size"].to_numpy()
    keys, n = found["key"].to_numpy(), found["n"].to_numpy()
    names = sorted(set(langs.tolist()))
    trees = [ContextTree(order, *(x[langs == name] for x in (sizes, keys, n))) for name in names]
    whole_pairs = sizes == order
    often = np.argsort(-n[whole_pairs], kind="stable")[:cells // max(len(names), 1)]
    return LanguageModel(names, trees, keys[whole_pairs][often])


def identify_languages(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text",
                       lang_col: str = "lang", **options) -> DataFrame:
    """Id, ``lang_pred`` and ``score`` of every row; ``learn`` says which rows may be learned from."""
    spark = docs.sparkSession
    known = docs.filter(learn & F.col(lang_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), whole(text_col).alias("text"))
    model = spark.sparkContext.broadcast(fit_languages(known, **options))

    def predict(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, group, size = [], [], 0
            for text in batch["_text"]:
                group.append(text.as_py())
                size += len(group[-1] or "")
                if size >= _GROUP_BYTES:
                    found += model.value.predict(group)
                    group, size = [], 0
            found += model.value.predict(group)
            yield pa.record_batch({"_id": batch["_id"],
                                   "lang_pred": pa.array([x for x, _ in found], pa.string()),
                                   "score": pa.array([p for _, p in found], pa.float64())})

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(
        predict, f"_id {kind}, lang_pred string, score double").withColumnRenamed("_id", id_col)
