"""Maximal periodic runs of words, by longest common extensions at the points of harmonic grids.

A run of period p repeats its first p words; it is at least ``least`` words and ``times`` periods
long and cannot be longer at either end. For every period p a grid is laid over the text, so fine that
each run that is wanted holds a grid point i with i + p also inside; all grids together have about
n ln n points. At a point where words p apart are equal, the longest common extension of i and i + p
is taken forward and backward, and both ends of the run are known.

An extension first compares a few words. Two places that are still equal then have reached, at the
same distance from both, a pair of places of a difference cover: residues modulo 31 among which any
difference occurs. Only suffixes that begin at such places are sorted, by doubling blocks of 31 words;
their common prefixes stand in a sparse table of range minima. The cover of a text is built when the
first extension gets that far.

Texts are taken in groups, end to end, with marks that equal nothing between them.

Cases: a null text has no words, as has an empty one; both give no run and empty collapsed text. Rows
are treated one by one, so repeated rows and null ids need no rule. A text is held whole in one task.
Only id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.text import whole

#: Every difference modulo 31 is that of two of these residues.
_MODULUS, _COVER = 31, (0, 1, 3, 8, 12, 18)
_GROUP_WORDS = 1 << 17  # words of the texts that are searched together, at least
_POINTS = 1 << 21  # grid points looked at together


class CoverExtensions:
    """Longest common extensions to the right in an array of non-negative numbers.

    Beyond the end stand marks that equal nothing.
    """

    def __init__(self, seq: np.ndarray) -> None:
        self.size = len(seq)
        top = int(seq.max(initial=0)) + 1
        self.seq = np.concatenate([seq, top + np.arange(2 * _MODULUS + 1)]).astype(np.int64)
        cover = np.zeros(_MODULUS, bool)
        cover[list(_COVER)] = True
        # per difference d a residue r such that r and r + d are in the cover
        self.meet = np.array([next(r for r in _COVER if cover[(r + d) % _MODULUS])
                              for d in range(_MODULUS)])
        self.cover = cover
        self.ready = False

    def _sort_sample(self) -> None:
        """Ranks of the sampled suffixes, by doubling; common prefixes of neighbours; their minima."""
        places = np.flatnonzero(self.cover[np.arange(self.size) % _MODULUS])
        slot = np.full(self.size + 1, -1)
        slot[places] = np.arange(len(places))
        block, new = np.arange(len(places)), np.zeros(len(places), bool)
        for k in range(_MODULUS - 1, -1, -1):
            block = block[np.argsort(self.seq[places[block] + k], kind="stable")]
        for k in range(_MODULUS):
            new[1:] |= np.diff(self.seq[places[block] + k]) != 0
        rank = np.empty(len(places), np.int64)
        rank[block] = np.cumsum(new)
        order, levels, jump = block, [rank], _MODULUS
        while len(places) and rank.max() < len(places) - 1:
            to = places + jump
            behind = np.where(to < self.size, rank[slot[np.minimum(to, self.size)]], -1)
            order = np.lexsort([behind, rank])
            new = np.zeros(len(places), bool)
            new[1:] = (np.diff(rank[order]) != 0) | (np.diff(behind[order]) != 0)
            rank = np.empty_like(rank)
            rank[order] = np.cumsum(new)
            levels.append(rank)
            jump *= 2
        # neighbours in the order: whole equal blocks by descending levels, then words
        left, right = places[order[:-1]], places[order[1:]]
        length = np.zeros(len(left), np.int64)
        for level in range(len(levels) - 1, -1, -1):
            a, b = np.minimum(left + length, self.size), np.minimum(right + length, self.size)
            inside = (a < self.size) & (b < self.size)
            same = inside & (levels[level][slot[a]] == levels[level][slot[b]])
            length += np.where(same, _MODULUS << level, 0)
        alive = np.ones(len(left), bool)
        for _ in range(_MODULUS):
            alive &= self.seq[left + length] == self.seq[right + length]
            length += alive
        self.rank, self.slot = rank, slot
        self.minima = [length]
        while 2 << (len(self.minima) - 1) <= len(length):
            last, half = self.minima[-1], 1 << (len(self.minima) - 1)
            self.minima.append(np.minimum(last[:-half], last[half:]))
        self.ready = True

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from ``i`` and ``j`` (different places, the end at most) are equal."""
        reach = (self.meet[(j - i) % _MODULUS] - i) % _MODULUS
        out = np.zeros(len(i), np.int64)
        open_ = np.arange(len(i))
        for step in range(_MODULUS):
            open_ = open_[(reach[open_] > step)]
            equal = self.seq[i[open_] + step] == self.seq[j[open_] + step]
            out[open_[equal]] += 1
            open_ = open_[equal]
            if not len(open_):
                break
        far = np.flatnonzero(out == reach)
        a, b = i[far] + reach[far], j[far] + reach[far]
        inside = (a < self.size) & (b < self.size)
        far, a, b = far[inside], a[inside], b[inside]
        if len(far):
            if not self.ready:
                self._sort_sample()
            a, b = self.rank[self.slot[a]], self.rank[self.slot[b]]
            low, high = np.minimum(a, b), np.maximum(a, b)
            level = np.frexp((high - low).astype(float))[1] - 1
            for one in np.unique(level).tolist():
                own, table = level == one, self.minima[one]
                out[far[own]] += np.minimum(table[low[own]], table[high[own] - (1 << one)])
        return out


def grid_steps(periods: np.ndarray, least: int, times: int) -> np.ndarray:
    """The distance of grid points at which no run of these periods lies between two of them."""
    return np.maximum(least, times * periods) - periods


def _grid(sizes: np.ndarray, starts: np.ndarray, least: int, times: int):
    """Grid points and their periods, all texts together, in portions of bounded size."""
    text = np.repeat(np.arange(len(sizes)), np.where(sizes >= least, sizes // times, 0))
    first = np.flatnonzero(np.diff(text, prepend=-1))
    period = np.arange(len(text)) - np.repeat(first, np.diff(first, append=len(text))) + 1
    step = grid_steps(period, least, times)
    count = (sizes[text] - period - 1) // step + 1
    upto = np.cumsum(count)
    begin = 0
    while begin < len(text):
        base = upto[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(upto, base + _POINTS, "right")))
        own = count[begin:end]
        nth = np.arange(int(own.sum())) - np.repeat(np.cumsum(own) - own, own)
        yield (np.repeat(starts[text[begin:end]], own) + nth * np.repeat(step[begin:end], own),
               np.repeat(period[begin:end], own))
        begin = end


def find_runs(sizes: list[int], numbers: np.ndarray, least: int = 24, times: int = 3) -> np.ndarray:
    """(text, start, end, period) of all runs of texts laid end to end, in this order.

    ``numbers`` are the words of all texts; equal words have equal numbers. A run lies in one text,
    in which its start and end count.
    """
    if times < 2 or least < 3:
        raise ValueError("runs of two periods and three words at least")
    lengths = np.array(sizes, np.int64)
    text = np.repeat(np.arange(len(lengths)), lengths)
    # a mark before each text, so that no extension leaves it
    seq = np.empty(len(numbers) + len(lengths), np.int64)
    starts = np.cumsum(lengths + 1) - lengths
    seq[starts - 1] = int(numbers.max(initial=-1)) + 1 + np.arange(len(lengths))
    seq[np.arange(len(numbers)) + text + 1] = numbers
    size = len(seq)
    forward, backward = CoverExtensions(seq), None
    found = [np.empty((0, 3), np.int64)]
    for i, p in _grid(lengths, starts, least, times):
        j = i + p
        equal = seq[i] == seq[j]
        i, j, p = i[equal], j[equal], p[equal]
        # two words at least are equal in a wanted run, so one beside the point is
        side = (forward.seq[i + 1] == forward.seq[j + 1]) | (seq[i - 1] == seq[j - 1])
        i, j, p = i[side], j[side], p[side]
        if not len(i):
            continue
        right = forward(i, j)
        if backward is None:
            backward = CoverExtensions(seq[::-1])
        left = backward(size - i, size - j)
        length = left + right + p
        wanted = length >= np.maximum(least, times * p)
        some = np.column_stack([i - left, j + right, p])[wanted]
        if len(some):
            found.append(_shortest_periods(some))
    runs = _shortest_periods(np.concatenate(found))
    owner = np.searchsorted(starts, runs[:, 0], "right") - 1
    runs = np.column_stack([owner, runs[:, :2] - starts[owner, None], runs[:, 2]])
    return runs[np.lexsort((runs[:, 3], runs[:, 1], runs[:, 0]))]


def _shortest_periods(runs: np.ndarray) -> np.ndarray:
    """Of equal stretches the one with the shortest period."""
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    return runs[np.any(np.diff(runs[:, :2], axis=0, prepend=-1) != 0, axis=1)]


def collapse_runs(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds behind its first period."""
    if not runs:
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    for start, end, period in runs:
        edge[start + period] += 1
        edge[end] -= 1
    return b" ".join([w for w, n in zip(words, np.cumsum(edge).tolist()) if not n])


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _search(least: int, times: int):
    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: list[list[bytes]] = []
        ids: list = []
        words = 0

        def result(kind: pa.DataType) -> pa.RecordBatch:
            known: dict[bytes, int] = {}
            numbers = np.fromiter((known.setdefault(w, len(known)) for t in texts for w in t),
                                  np.int64, words)
            sizes = [len(t) for t in texts]
            runs = find_runs(sizes, numbers, least, times)
            own: dict[int, list] = {}
            for text, start, end, period in runs.tolist():
                own.setdefault(text, []).append((start, end, period))
            best, lists, kept = [], [], []
            for text, split in enumerate(texts):
                mine = own.get(text, [])
                best.append(min(mine, key=lambda r: (-Fraction(r[1] - r[0], r[2]), r[0], r[2]))
                            if mine else None)
                lists.append([{"start": s, "length": e - s, "period": p} for s, e, p in mine])
                kept.append(collapse_runs(split, mine).decode())
            best = [r and {"start": r[0], "length": r[1] - r[0], "period": r[2]} for r in best]
            return pa.record_batch({"_id": pa.array(ids, kind), "runs": pa.array(lists, pa.list_(_RUN)),
                                    "best": pa.array(best, _RUN),
                                    "collapsed": pa.array(kept, pa.string())})

        kind = None
        for batch in batches:
            kind = batch.schema.field("_id").type
            for own, text in zip(batch["_id"], batch["_text"]):  # one text at a time leaves Arrow
                texts.append(text.as_py().encode().split())  # at x20 and x09 to x0D
                ids.append(own.as_py())
                words += len(texts[-1])
                if words >= _GROUP_WORDS or len(texts) >= 10_000:
                    yield result(kind)
                    texts, ids, words = [], [], 0
        if texts:
            yield result(kind)

    return search


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
                  least: int = 24, times: int = 3) -> DataFrame:
    """Per row: id, ``runs`` (start, length, period in words), ``best`` and ``collapsed`` text.

    ``best`` is the run of the greatest length by period; ``collapsed`` are the words that no run
    holds behind its first period, joined by blanks.
    """
    kind = dict(docs.dtypes)[id_col]
    run = "struct<start:long,length:long,period:long>"
    return docs.select(F.col(id_col).alias("_id"), whole(text_col).alias("_text")).mapInArrow(
        _search(least, times), f"_id {kind}, runs array<{run}>, best {run}, collapsed string"
    ).withColumnRenamed("_id", id_col)
