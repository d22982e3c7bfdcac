"""Nearest neighbours by inner product from randomly rotated one-bit codes.

Rows are filed in cells around centres, which are fitted on a bounded sample; every row is in the
index. What a row differs from its centre by is coded in ``levels`` steps: scaled to length 1,
rotated by a random orthogonal matrix of that step and kept as its signs, one bit a dimension; the
next step codes what is left. With ``f``, the inner product of the rotated rest and its code
(scaled to length 1), the code divided by ``f`` is an unbiased estimate of the rest, so the inner
product with a query is estimated from centre, packed bits and one scalar a step. The error is
beyond ``epsilon * |rest| * sqrt((1 - f^2) / f^2 / (dimension - 1))`` times the query's length only
with the probability of ``epsilon`` standard deviations. Rows whose upper bound reaches the k-th best
score known so far are scored exactly on the original vectors.

A query first meets the lane (cells of about ``lane_rows`` rows together, or a part of a larger
cell) of its nearest centre, which gives a k-th best score. Then it meets the other lanes, but only
those with a cell in reach: a row is within its cell's radius of the centre, so by Cauchy and
Schwarz no row scores more than centre times query plus radius times the query's length. Data
without clusters has no cell out of reach, and then every query meets every code.

Cases: vectors that are null, empty, zero, or hold a null or a number that is not finite take no
part, nor do rows without id. Of rows that share an id the one with the smallest vector counts.
Vectors of different dimensions never meet. Ties go to the smaller id. A query with fewer candidates
than k gets them all. An empty table gives an empty result. Only id and vector are read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.sample import bounded_sample
from plumbline.session import materialize

_AT_ONCE = 128  # queries whose estimates are held at once
_BLOCK = 4096  # index rows that meet them
_PAIRS = 1 << 15  # pairs scored exactly at once
_FOUND = "query_id long, vec_id long, score double"
_ASKED = ["dim", "lane", "_id", "_v", "bound"]
_ROUNDING = 4e-6  # of a row's length, for estimates in single precision


def rotation(dim: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix that depends on dimension and seed only."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def lengths_of(rows: np.ndarray) -> np.ndarray:
    """Euclidean lengths, without overflow on the way."""
    top = np.abs(rows).max(axis=1, initial=0)
    unit = rows / np.where(top > 0, top, 1)[:, None]
    return top * np.sqrt((unit * unit).sum(axis=1))


def usable_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``_id`` and ``_v`` (doubles) of the vectors that take part, one per id."""
    v = F.col("_v")
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    rows = df.select(F.col(id_col).cast("long").alias("_id"),
                     F.col(vector_col).cast("array<double>").alias("_v")).filter(
        F.col("_id").isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0))
    return rows.groupBy("_id").agg(F.min("_v").alias("_v"))


def encode(rests: np.ndarray, turns: list[np.ndarray], epsilon: float) -> tuple[np.ndarray, ...]:
    """Packed signs of every step, the scalar of every step, and the error bound, per row."""
    dim = rests.shape[1]
    codes, scales = [], []
    for step, turn in enumerate(turns):
        length = lengths_of(rests)
        turned = rests / np.where(length > 0, length, 1)[:, None] @ turn.T
        signs = np.where(turned > 0, 1.0, -1.0)
        f = np.maximum(np.abs(turned).sum(axis=1) / np.sqrt(dim), 1e-9)
        last = step == len(turns) - 1
        scale = length * (1 / f if last else f) / np.sqrt(dim)
        codes.append(np.packbits(turned > 0, axis=1, bitorder="little"))
        scales.append(scale)
        if last:
            spread = np.sqrt(np.maximum(1 - f * f, 0) / (f * f) / max(dim - 1, 1))
            return np.hstack(codes), np.column_stack(scales), epsilon * length * spread
        rests = rests - scale[:, None] * (signs @ turn)
    raise ValueError("at least one step")


def decode(codes: np.ndarray, scales: np.ndarray, turns: list[np.ndarray]) -> np.ndarray:
    """The estimates of the coded rests."""
    dim, wide = turns[0].shape[0], codes.shape[1] // len(turns)
    total = np.zeros((len(codes), dim))
    for step, turn in enumerate(turns):
        signs = np.unpackbits(codes[:, step * wide:(step + 1) * wide], axis=1, count=dim,
                              bitorder="little") * 2.0 - 1
        total += (signs * scales[:, step:step + 1]) @ turn
    return total


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def fit_centres(rows: np.ndarray, cells: int, rounds: int = 8) -> np.ndarray:
    """Centres of at most ``cells`` cells by Lloyd's rounds from evenly spaced rows."""
    centres = np.unique(rows[np.linspace(0, len(rows) - 1, min(cells, len(rows))).astype(int)], axis=0)
    for _ in range(rounds):
        home = nearest_centre(rows, centres)
        counts = np.bincount(home, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, home, rows)
        centres = np.where(counts[:, None] > 0, total / np.maximum(counts, 1)[:, None], centres)
    return centres


def nearest_centre(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres * centres).sum(axis=1) / 2
    return np.concatenate([np.argmax(rows[at:at + _BLOCK] @ centres.T - half, axis=1)
                           for at in range(0, len(rows), _BLOCK)] or [np.empty(0, int)])


@dataclass
class VectorIndex:
    """Coded rows (``dim, cell, _id, code, scale, bound, _v``), centres and radii of the cells."""

    rows: DataFrame
    centres: dict[int, np.ndarray]
    radii: dict[int, np.ndarray]
    counts: dict[int, np.ndarray]
    seed: int
    levels: int

    def turns(self, dim: int) -> list[np.ndarray]:
        return [rotation(dim, self.seed + step) for step in range(self.levels)]


def build_index(df: DataFrame, id_col: str, vector_col: str, *, seed: int = 11, epsilon: float = 3.0,
                levels: int = 3, cell_rows: int = 2048, cells: int = 1024,
                sample: int = 32_768) -> VectorIndex:
    """The index of all usable vectors.

    There is a cell for about every ``cell_rows`` rows of a dimension, ``cells`` at most, and their
    centres are fitted on about ``sample`` rows of the whole table.
    """
    spark = df.sparkSession
    kept = materialize(spark, usable_vectors(df, id_col, vector_col).withColumn(
        "dim", F.size("_v")), "vectors")
    sizes = {r["dim"]: r["count"] for r in kept.groupBy("dim").count().collect()}
    drawn: dict[int, list] = {}
    for r in bounded_sample(kept, "_id", sample).select("dim", "_id", "_v").collect():
        drawn.setdefault(r["dim"], []).append((r["_id"], r["_v"]))
    centres = {}
    for dim, count in sizes.items():
        rows = np.array([v for _, v in sorted(drawn.get(dim, []))]).reshape(-1, dim)
        rows = rows if len(rows) else np.zeros((1, dim))
        centres[dim] = fit_centres(rows, min(cells, -(-count // cell_rows)))

    def codes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            dims = batch["dim"].to_numpy()
            for dim in np.unique(dims).tolist():
                own = batch.filter(pa.array(dims == dim))
                if dim not in turns:
                    turns[dim] = [rotation(dim, seed + step) for step in range(levels)]
                vectors = _matrix(own["_v"])
                cell = nearest_centre(vectors, centres[dim])
                rests = vectors - centres[dim][cell]
                packed, scales, bound = encode(rests, turns[dim], epsilon)
                length = lengths_of(vectors) + lengths_of(centres[dim])[cell]
                yield pa.record_batch({
                    "dim": own["dim"], "cell": pa.array(cell, pa.int32()), "_id": own["_id"],
                    "code": pa.array([c.tobytes() for c in packed], pa.binary()),
                    "scale": pa.array(list(scales), pa.list_(pa.float64())),
                    "bound": pa.array(bound + _ROUNDING * length),
                    "away": pa.array(lengths_of(rests) * (1 + 1e-9) + 1e-9 * length), "_v": own["_v"]})

    index = materialize(spark, kept.select("dim", "_id", "_v").mapInArrow(
        codes, "dim int, cell int, _id long, code binary, scale array<double>, bound double, "
               "away double, _v array<double>"), "vector-index")
    radii = {d: np.full(len(c), -np.inf) for d, c in centres.items()}
    counts = {d: np.zeros(len(c), np.int64) for d, c in centres.items()}
    for r in index.groupBy("dim", "cell").agg(F.max("away").alias("away"),
                                              F.count("*").alias("n")).collect():
        radii[r["dim"]][r["cell"]], counts[r["dim"]][r["cell"]] = r["away"], r["n"]
    return VectorIndex(index, centres, radii, counts, seed, levels)


def plan_lanes(counts: np.ndarray, lane_rows: int) -> list[tuple[int, int, int]]:
    """Per cell (cell, first lane, lanes): large cells are split, small neighbours share a lane."""
    plan, lane, filled = [], -1, lane_rows
    for cell, n in enumerate(counts.tolist()):
        if n > lane_rows:
            parts = -(-n // lane_rows)
            plan.append((cell, lane + 1, parts))
            lane, filled = lane + parts, lane_rows
        else:
            if filled + n > lane_rows:
                lane, filled = lane + 1, 0
            filled += n
            plan.append((cell, lane, 1))
    return plan


class _Best:
    """The best k of every query so far: scores (descending) and ids."""

    def __init__(self, queries: int, k: int, floor: np.ndarray) -> None:
        self.k = k
        self.floor = floor
        self.scores = np.full((queries, k), -np.inf)
        self.ids = np.full((queries, k), np.iinfo(np.int64).max)

    def least(self, part: slice) -> np.ndarray:
        """What a row has to reach."""
        return np.maximum(self.floor[part], self.scores[part, -1])

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """New candidates of the queries ``rows``."""
        touched = np.unique(rows)
        row = np.concatenate([np.repeat(touched, self.k), rows])
        score = np.concatenate([self.scores[touched].ravel(), scores])
        own = np.concatenate([self.ids[touched].ravel(), ids])
        order = np.lexsort((own, -score, row))
        row, score, own = row[order], score[order], own[order]
        first = np.searchsorted(row, touched)
        place = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))
        keep = place < self.k
        self.scores[row[keep], place[keep]] = score[keep]
        self.ids[row[keep], place[keep]] = own[keep]


def _exact(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Row-wise inner products, added up from the first dimension to the last."""
    total = np.zeros(len(left))
    for j in range(left.shape[1]):
        total += left[:, j] * right[:, j]
    return total


def search_block(best: _Best, query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray,
                 estimates: np.ndarray, bound: np.ndarray, vectors: np.ndarray) -> None:
    """Meet one index block with a query set."""
    lengths = lengths_of(queries)
    unit = float(max(np.abs(estimates).max(), bound.max())) or 1.0
    # a row's bound is one more dimension, in which a query is 1 long
    rows = np.column_stack([estimates, bound]) / unit
    rows = rows.astype(np.float32)
    asked = np.column_stack([queries / lengths[:, None], np.ones(len(queries))]).astype(np.float32)
    for begin in range(0, len(queries), _AT_ONCE):
        part = slice(begin, begin + _AT_ONCE)
        stretch = lengths[part] * unit
        reach = asked[part] @ rows.T
        least = best.least(part)
        if len(ids) > best.k and np.isneginf(least).any():
            # k + 1 rows, one of which may be the query itself, surely reach their lower bounds
            low = reach - 2 * rows[:, -1]
            kth = np.partition(low, -best.k - 1, axis=1)[:, -best.k - 1]
            least = np.maximum(least, (kth - 1e-6) * stretch)
        cut = least / stretch
        cut = (cut - 1e-6 * np.abs(cut) - 1e-6).astype(np.float32)
        col, row = np.nonzero(reach >= cut[:, None])
        other = ids[row] != query_ids[col + begin]
        row, col = row[other], col[other]
        for at in range(0, len(row), _PAIRS):
            r, c = row[at:at + _PAIRS], col[at:at + _PAIRS]
            score = np.einsum("ij,ij->i", vectors[r], queries[c + begin])
            near = score >= least[c] - 1e-9 * np.abs(least[c]) - 1e-9 * stretch[c]
            r, c = r[near], c[near]
            if len(r):
                best.add(c + begin, _exact(vectors[r], queries[c + begin]), ids[r])
                least = np.maximum(least, best.least(part))


def _search(k: int, index_seed: int, levels: int, centres: dict[int, np.ndarray]):
    """Streams ``place`` groups: the query rows first, then index rows, block by block."""
    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, queries, ready, best, turns = None, [], None, None, []

        def result() -> pa.RecordBatch:
            found = best.scores > -np.inf
            rows = np.nonzero(found)[0]
            return pa.record_batch({"query_id": pa.array(ready[0][rows]),
                                    "vec_id": pa.array(best.ids[found]),
                                    "score": pa.array(best.scores[found])})

        for batch in batches:
            keys = np.column_stack([batch[c].to_numpy() for c in ("place", "_kind")])
            edges = np.flatnonzero(np.any(keys[1:] != keys[:-1], axis=1)) + 1
            for begin, end in zip([0, *edges], [*edges, len(keys)]):
                if keys[begin][0] != group:
                    if best is not None:
                        yield result()
                    group, queries, ready, best = keys[begin][0], [], None, None
                own = batch.slice(begin, end - begin)
                if keys[begin][1] == 0:
                    queries.append((own["_id"].to_numpy(), _matrix(own["_v"]),
                                    own["bound"].to_numpy()))
                    continue
                if not queries:
                    continue
                if best is None:
                    ready = (np.concatenate([i for i, _, _ in queries]),
                             np.concatenate([v for _, v, _ in queries]))
                    best = _Best(len(ready[0]), k, np.concatenate([f for _, _, f in queries]))
                    dim = ready[1].shape[1]
                    turns = [rotation(dim, index_seed + step) for step in range(levels)]
                for first in range(0, len(own), _BLOCK):
                    rows = own.slice(first, _BLOCK)
                    packed = np.frombuffer(b"".join(rows["code"].to_pylist()), np.uint8)
                    estimates = centres[dim][rows["cell"].to_numpy()] + decode(
                        packed.reshape(len(rows), -1), _matrix(rows["scale"]), turns)
                    search_block(best, *ready, rows["_id"].to_numpy(), estimates,
                                 rows["bound"].to_numpy(), _matrix(rows["_v"]))
        if best is not None:
            yield result()

    return search


def _lanes_in_reach(index: VectorIndex, lanes: dict[int, list[tuple[int, int, int]]], home: bool):
    """Each query once per lane it meets: the lane of its nearest centre, or all others in reach."""
    def lanes_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch["dim"].to_numpy()
            for dim in np.unique(dims).tolist():
                own = batch.filter(pa.array(dims == dim))
                vectors, floor = _matrix(own["_v"]), own["bound"].to_numpy()
                used = np.flatnonzero(counts[dim])
                near = used[nearest_centre(vectors, centres[dim][used])]
                first = {cell: lane for cell, lane, _ in lanes[dim]}
                at_home = np.array([first[c] for c in near.tolist()], int)
                if home:
                    yield own.append_column("lane", pa.array(at_home, pa.int32())).select(_ASKED)
                    continue
                top = vectors @ centres[dim].T + lengths_of(vectors)[:, None] * radii[dim]
                in_reach = top >= (floor - 1e-9 * np.abs(floor))[:, None]
                meets: dict[int, np.ndarray] = {}
                for cell, lane, parts in lanes[dim]:
                    for one in range(lane, lane + parts):
                        meets[one] = meets.get(one, False) | in_reach[:, cell]
                for one, asks in meets.items():
                    rows = own.filter(pa.array(asks & (at_home != one)))
                    if len(rows):
                        yield rows.append_column("lane", pa.array(np.full(
                            len(rows), one, np.int32))).select(_ASKED)

    centres, radii, counts = index.centres, index.radii, index.counts
    return lanes_of


def nearest(df: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding",
            *, k: int = 20, seed: int = 11, epsilon: float = 3.0, query_set: int = 4096,
            lane_rows: int = 16_384, **options) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score`` of the k nearest of each query.

    ``is_query`` is an expression over ``df``. A task meets about ``query_set`` queries with a lane
    of about ``lane_rows`` rows. ``options`` go to ``build_index``.
    """
    spark = df.sparkSession
    index = build_index(df, id_col, vector_col, seed=seed, epsilon=epsilon, **options)
    queries = materialize(spark, usable_vectors(df.filter(is_query), id_col, vector_col).select(
        F.size("_v").alias("dim"), "_id", "_v", F.lit(float("-inf")).alias("bound")), "vector-queries")
    lanes, offset = {}, 0
    for dim, counts in sorted(index.counts.items()):
        lanes[dim] = [(cell, lane + offset, parts) for cell, lane, parts in plan_lanes(counts, lane_rows)]
        offset = max(lane + parts for _, lane, parts in lanes[dim])
    if not lanes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    cells = spark.createDataFrame([(dim, *cell) for dim, own in lanes.items() for cell in own],
                                  "dim int, cell int, first int, parts int")
    rows = index.rows.join(cells, ["dim", "cell"]).withColumn(
        "lane", (F.col("first") + F.pmod(F.xxhash64("_id"), "parts")).cast("int"))
    search = _search(k, index.seed, index.levels, index.centres)
    found = None
    for home in (True, False):
        asked = materialize(spark, queries.mapInArrow(
            _lanes_in_reach(index, lanes, home), "dim int, lane int, _id long, _v array<double>, "
                                                 "bound double"), "lane-queries")
        sets = [(r["lane"], -(-r["count"] // query_set)) for r in asked.groupBy(
            "lane").count().orderBy("lane").collect()]
        if not sets:
            continue
        places = np.cumsum([0] + [n for _, n in sets])
        known = spark.createDataFrame([(lane, n, int(at)) for (lane, n), at in zip(sets, places)],
                                      "lane int, sets int, base int")
        met = asked.join(known, "lane").select(
            (F.col("base") + F.pmod(F.xxhash64("_id"), "sets")).cast("int").alias("place"),
            F.lit(0).alias("_kind"), "_id", "_v", "bound").unionByName(
            rows.join(known, "lane").select(
                F.explode(F.sequence("base", F.col("base") + F.col("sets") - 1)).alias("place"),
                F.lit(1).alias("_kind"), "_id", "_v", "bound", "cell", "code", "scale"),
            allowMissingColumns=True)
        own = materialize(spark, met.repartitionById(int(places[-1]), "place").sortWithinPartitions(
            "place", "_kind", "_id").mapInArrow(search, _FOUND), "lane-found")
        found = own if found is None else found.unionByName(own)
        # the k-th best of the home lane is what the others have to reach
        floors = own.groupBy(F.col("query_id").alias("_id")).agg(
            F.when(F.count("*") >= k, F.min("score")).otherwise(float("-inf")).alias("bound"))
        queries = queries.drop("bound").join(floors, "_id", "left").select(
            "dim", "_id", "_v", F.coalesce("bound", F.lit(float("-inf"))).alias("bound"))
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
