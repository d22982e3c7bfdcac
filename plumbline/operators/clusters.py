"""Clusters of vectors: distributed k-means with a bounded number of centres, and medoids.

Seeds are drawn in rounds by weighted sampling without replacement: a row's draw is -ln(u) / d^2,
with u from a hash of its id and the round and d its distance to the nearest seed so far, and the
rows with the smallest draws are the next seeds. Tasks send the few best draws only. Seeds are
weighed by the rows around them and thinned to ``k`` centres, which then move by Lloyd's rounds with
map-side sums. The driver holds seeds and centres, never rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.session import materialize

_BLOCK = 4096


def usable(df: DataFrame, item: str, vector: str, dim: int) -> DataFrame:
    """``_i`` and ``_v`` (doubles) of rows with an id and a finite vector of the dimension."""
    v = F.col(vector).cast("array<double>")
    good = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return df.where(F.col(item).isNotNull() & (F.size(vector) == dim) & good).select(
        F.col(item).alias("_i"), v.alias("_v"))


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def to_centres(rows: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row, ties to the first, and the distance to it.

    Centres are compared by products; the distance itself is taken from differences.
    """
    middle = centres.mean(axis=0)  # keeps digits where all vectors lie far from the origin
    near = centres - middle
    half = (near * near).sum(axis=1) / 2
    which = np.concatenate([np.argmax((rows[at:at + _BLOCK] - middle) @ near.T - half, axis=1)
                            for at in range(0, len(rows), _BLOCK)] or [np.empty(0, np.int64)])
    rest = rows - centres[which]
    return which, np.sqrt(np.einsum("ij,ij->i", rest, rest))


def weighted_seeds(rows: np.ndarray, weights: np.ndarray, k: int, seed: int) -> np.ndarray:
    """``k`` of some weighted rows, each drawn by weight and squared distance to those before it."""
    rng = np.random.default_rng(seed)
    gap = np.full(len(rows), np.inf)
    chosen: list[int] = []
    while len(chosen) < min(k, len(rows)):
        share = weights * (np.ones(len(rows)) if not chosen else gap)
        if not share.sum() > 0:
            break
        chosen.append(int(np.searchsorted(np.cumsum(share), rng.random() * share.sum(), "right")))
        step = rows - rows[chosen[-1]]
        gap = np.minimum(gap, np.einsum("ij,ij->i", step, step))
    return rows[chosen]


def lloyd(rows: np.ndarray, weights: np.ndarray, centres: np.ndarray, rounds: int) -> np.ndarray:
    """Move centres to the means of the weighted rows nearest to them."""
    for _ in range(rounds):
        which, _ = to_centres(rows, centres)
        total = np.zeros_like(centres)
        np.add.at(total, which, rows * weights[:, None])
        mass = np.bincount(which, weights, len(centres))
        centres = np.where(mass[:, None] > 0, total / np.where(mass > 0, mass, 1)[:, None], centres)
    return centres


def _draws(seeds: np.ndarray, turn: int, most: int):
    """The rows of a partition with the smallest draws, ``most`` at most."""
    def draw(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: pa.Table | None = None
        for batch in batches:
            _, gap = to_centres(matrix(batch["_v"]), seeds)
            u = (batch["_u"].to_numpy().astype(np.uint64) >> np.uint64(11)).astype(np.float64)
            u = (u + 0.5) / float(1 << 53)
            with np.errstate(divide="ignore"):
                weigh = np.where(gap > 0, -np.log(u) / (gap * gap), np.inf)
            here = np.argsort(weigh, kind="stable")[:most]
            here = here[np.isfinite(weigh[here])]
            own = pa.table({"_i": batch["_i"].take(pa.array(here)), "_v": batch["_v"].take(
                pa.array(here)), "_d": pa.array(weigh[here])})
            best = own if best is None else pa.concat_tables([best, own])
            if len(best) > 4 * most:
                best = best.take(np.argsort(best["_d"].to_numpy(), kind="stable")[:most])
        if best is not None and len(best):
            best = best.take(np.argsort(best["_d"].to_numpy(), kind="stable")[:most])
            yield from best.combine_chunks().to_batches()
    return draw


def _sums(centres: np.ndarray):
    """Rows and sums of coordinates by nearest centre, one row per number."""
    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(centres), centres.shape[1] + 1))
        for batch in batches:
            rows = matrix(batch["_v"])
            which, _ = to_centres(rows, centres)
            np.add.at(total, which, np.column_stack([rows, np.ones(len(rows))]))
        flat = total.ravel()
        used = np.flatnonzero(flat)
        yield pa.record_batch({"at": pa.array(used), "s": pa.array(flat[used])})
    return add


def _collect_sums(rows: DataFrame, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts and means of the rows nearest to each centre."""
    found = rows.select("_v").mapInArrow(_sums(centres), "at long, s double").groupBy("at").agg(
        F.sum("s").alias("s")).collect()
    flat = np.zeros(len(centres) * (centres.shape[1] + 1))
    for r in found:
        flat[r["at"]] = r["s"]
    total = flat.reshape(len(centres), -1)
    count = total[:, -1]
    return count, np.where(count[:, None] > 0, total[:, :-1] / np.where(count > 0, count, 1)[:, None],
                           centres)


def find_centres(df: DataFrame, item: str, vector: str, *, dim: int, k: int, seed_rounds: int = 3,
                 rounds: int = 10, seed: int = 1) -> np.ndarray:
    """At most ``k`` centres of all usable vectors; fewer where fewer vectors differ."""
    if k < 1:
        raise ValueError("k must be at least 1")
    rows = materialize(df.sparkSession, usable(df, item, vector, dim), "cluster-rows")
    kind = dict(rows.dtypes)["_i"]
    first = rows.orderBy(F.xxhash64(F.lit(seed), "_i"), "_i").limit(1).collect()
    if not first:
        return np.empty((0, dim))
    seeds = np.array([first[0]["_v"]])
    for turn in range(seed_rounds):
        drawn = rows.withColumn("_u", F.xxhash64(F.lit(seed), F.lit(turn), "_i")).mapInArrow(
            _draws(seeds, turn, k), f"_i {kind}, _v array<double>, _d double")
        new = drawn.orderBy("_d", "_i").limit(k).collect()
        if not new:
            break
        seeds = np.concatenate([seeds, np.array([r["_v"] for r in new])])
    weights, _ = _collect_sums(rows, seeds)
    centres = lloyd(seeds, weights, weighted_seeds(seeds, weights, k, seed), 5)
    for _ in range(rounds):
        _, moved = _collect_sums(rows, centres)
        still = np.abs(moved - centres).max() <= 1e-9 * (1 + np.abs(centres).max())
        centres = moved
        if still:
            break
    return centres


def assign_clusters(df: DataFrame, item: str, vector: str, centres: np.ndarray) -> DataFrame:
    """``item``, ``cluster`` and ``distance`` to its centre of every usable row."""
    if not len(centres):
        raise ValueError("there is no centre")
    rows = usable(df, item, vector, centres.shape[1])

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, gap = to_centres(matrix(batch["_v"]), centres)
            yield pa.record_batch({"_i": batch["_i"], "cluster": pa.array(which, pa.int32()),
                                   "distance": pa.array(gap)})

    return rows.mapInArrow(place, f"_i {dict(rows.dtypes)['_i']}, cluster int, distance double"
                           ).withColumnRenamed("_i", item)


def medoids(assigned: DataFrame, item: str, cluster: str = "cluster", distance: str = "distance"
            ) -> DataFrame:
    """The item nearest to the centre of each cluster, ties to the smallest, and the cluster's size."""
    return assigned.groupBy(cluster).agg(
        F.min_by(item, F.struct(F.col(distance), F.col(item))).alias(item),
        F.min(distance).alias(distance), F.count(F.lit(1)).alias("members"))


def group_distances(df: DataFrame, item: str, group: str, vector: str, dim: int) -> DataFrame:
    """``item``, ``group`` and ``distance`` to the mean of its group, for groups that are given."""
    v = F.col(vector).cast("array<double>")
    rows = df.where(F.size(vector) == dim).select(item, group, v.alias("_v"))
    means = rows.groupBy(group).agg(F.array(*[F.avg(F.get("_v", F.lit(j))) for j in range(dim)]).alias(
        "_m"))
    gaps = F.zip_with("_v", "_m", lambda a, b: (a - b) * (a - b))
    return rows.join(means, group).select(item, group, F.sqrt(F.aggregate(
        gaps, F.lit(0.0), lambda t, x: t + x)).alias("distance"))


def clustered_candidates(df: DataFrame, item: str, vector: str, *, dim: int, k: int,
                         keep: Sequence[str | Column] = (), **options) -> DataFrame:
    """``keep`` columns, ``cluster`` and ``distance`` of every usable item, with centres found here."""
    centres = find_centres(df, item, vector, dim=dim, k=k, **options)
    return df.select(item, *keep).join(assign_clusters(df, item, vector, centres), item)
