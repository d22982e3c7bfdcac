"""Diverse choice of items for labelling, and thinning of vector banks."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import rules
from plumbline.operators.governance import derived_id
from plumbline.session import materialize


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(
        len(column), -1)


def _scaled(vectors: np.ndarray) -> np.ndarray:
    """Directions of the rows; a zero row has none and stays."""
    length = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
    return vectors / np.maximum(length, np.finfo(float).tiny)[:, None]


def _squared_gap(units: np.ndarray, picks: np.ndarray) -> np.ndarray:
    """Smallest squared distance of each row to the picks, from similarities."""
    own = np.einsum("ij,ij->i", units, units)
    theirs = np.einsum("ij,ij->i", picks, picks)
    likeness = np.stack([np.einsum("ij,j->i", units, p) for p in picks], axis=1)
    return np.min(own[:, None] + theirs[None, :] - 2.0 * likeness, axis=1)


class _Choice:
    """Greedy choice among rows that are held here: units, ids and gaps so far."""

    def __init__(self, ids: list, units: np.ndarray, gaps: np.ndarray) -> None:
        self.ids, self.units, self.gaps = ids, units, gaps.copy()
        self.open = np.ones(len(ids), bool)

    def farthest(self) -> int:
        """The open row with the greatest gap, ties to the smallest id."""
        most = self.gaps[self.open].max()
        return int(min(np.flatnonzero(self.open & (self.gaps == most)), key=lambda i: self.ids[i]))

    def take(self, i: int) -> None:
        self.open[i] = False
        self.gaps = np.minimum(self.gaps, _squared_gap(self.units, self.units[i:i + 1]))


def spread_out(ids: list, vectors: np.ndarray, k: int) -> list[int]:
    """Rows of a greedy k-centre choice that starts at the greatest first component."""
    units = _scaled(vectors)
    choice = _Choice(ids, units, units[:, 0])
    first = choice.farthest()
    choice.gaps = np.full(len(ids), np.inf)
    choice.take(first)
    picks = [first]
    while len(picks) < min(k, len(ids)):
        picks.append(choice.farthest())
        choice.take(picks[-1])
    return picks


def _directions(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if len(batch):
            units = _scaled(_matrix(batch["vector"]))
            yield pa.record_batch({"item": batch["item"], "unit": pa.array(
                list(units), pa.list_(pa.float64())), "gap": pa.array(np.full(len(units), np.inf))})


def _closer(picks: np.ndarray):
    """Lower the stored gaps by the new picks only."""
    def lower(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                gaps = np.minimum(batch["gap"].to_numpy(), _squared_gap(
                    _matrix(batch["unit"]), picks))
                yield pa.record_batch({"item": batch["item"], "unit": batch["unit"],
                                       "gap": pa.array(gaps)})
    return lower


def diverse_top_k(df: DataFrame, item: str, vector: str, k: int, pool: int = 256) -> DataFrame:
    """Exact greedy k-centre choice: rows (pick, item), picks numbered from 1.

    Vectors are scaled to length one; the start is the greatest first component, then always the
    item farthest from all chosen ones, ties to the lowest id. With k >= n everything is chosen in
    id order.

    Every item's gap to the chosen ones is stored, and a pass lowers it by the picks that came
    since. A pass returns only the ``pool`` farthest items. Gaps only shrink, so while the best of
    the pool beats the first item left outside it is the global choice and needs no further pass.
    The driver holds pool + k vectors, never the table.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    spark = df.sparkSession
    schema = T.StructType([T.StructField("pick", T.IntegerType()), df.schema[item]])
    few = [r[0] for r in df.select(item).orderBy(item).limit(k + 1).collect()]
    if len(few) <= k:
        return spark.createDataFrame([(i, v) for i, v in enumerate(few, 1)], schema)

    kind = df.schema[item].dataType.simpleString()
    columns = f"item {kind}, unit array<double>, gap double"
    state = materialize(spark, df.select(F.col(item).alias("item"), F.col(vector).alias("vector"))
                        .mapInArrow(_directions, columns), "diverse")
    start = state.orderBy(F.get("unit", F.lit(0)).desc(), "item").limit(1).head()
    chosen, new = [start["item"]], [start["unit"]]
    while len(chosen) < k:
        state = materialize(spark, state.mapInArrow(_closer(np.array(new)), columns), "diverse")
        # the list has k entries at most
        far = state.where(~F.col("item").isin(chosen)).orderBy(F.col("gap").desc(), "item").limit(
            pool + 1).collect()
        outside = far[pool]["gap"] if len(far) > pool else -np.inf
        choice = _Choice([r["item"] for r in far[:pool]], np.array([r["unit"] for r in far[:pool]]),
                         np.array([r["gap"] for r in far[:pool]]))
        new = []
        while len(chosen) < k and choice.open.any():
            best = choice.farthest()
            if new and choice.gaps[best] <= outside:
                break
            choice.take(best)
            chosen.append(choice.ids[best])
            new.append(choice.units[best])
    return spark.createDataFrame([(i, v) for i, v in enumerate(chosen, 1)], schema)


def hash_group(item: Column, groups: int) -> Column:
    """One of ``groups`` groups by the SHA-256 of the id's text."""
    head = F.conv(F.substring(F.sha2(item.cast("string"), 256), 1, 8), 16, 10).cast("long")
    return (head % groups).cast("int")


def _grouped_directions(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if len(batch):
            units = _scaled(_matrix(batch["vector"]))
            yield pa.record_batch({
                "_g": batch["_g"], "item": batch["item"],
                "unit": pa.array(list(units), pa.list_(pa.float64())),
                "gap": pa.array(np.full(len(units), np.inf)),
                "open": pa.array(np.ones(len(units), bool))})


def _closer_in_groups(new: dict[int, tuple[list, np.ndarray]]):
    """Lower the stored gaps by the new picks of each row's group and close the picked rows."""
    def lower(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                units, group = _matrix(batch["unit"]), batch["_g"].to_numpy()
                gaps = batch["gap"].to_numpy().copy()
                free = batch["open"].to_numpy(zero_copy_only=False).copy()
                for g, (items, picks) in new.items():
                    own = np.flatnonzero(group == g)
                    gaps[own] = np.minimum(gaps[own], _squared_gap(units[own], picks))
                    free[own] &= ~pc.is_in(batch["item"].take(pa.array(own)), pa.array(
                        items, batch["item"].type)).to_numpy(zero_copy_only=False)
                yield pa.record_batch({"_g": batch["_g"], "item": batch["item"],
                                       "unit": batch["unit"], "gap": pa.array(gaps),
                                       "open": pa.array(free)})
    return lower


def _spread_out_in_groups(rows: DataFrame, share: int, pool: int) -> list:
    """Items of the greedy choice of ``share`` rows in every group ``_g`` of item and vector.

    As in ``diverse_top_k`` a pass over the stored gaps returns only the ``pool`` farthest rows of a
    group, found by a ranking that tasks cut to ``pool`` before rows meet, and serves all groups.
    """
    spark = rows.sparkSession
    columns = f"_g int, item {dict(rows.dtypes)['item']}, unit array<double>, gap double, open boolean"
    state = materialize(spark, rows.mapInArrow(_grouped_directions, columns), "thinned")

    def farthest(order: Column, most: int) -> dict[int, list]:
        rank = F.row_number().over(Window.partitionBy("_g").orderBy(order.desc(), "item"))
        out: dict[int, list] = {}
        for r in state.where("open").withColumn("rank", rank).where(
                F.col("rank") <= most).orderBy("_g", "rank").collect():
            out.setdefault(r["_g"], []).append(r)
        return out

    new = {g: ([r[0]["item"]], np.array([r[0]["unit"]]))
           for g, r in farthest(F.get("unit", F.lit(0)), 1).items()}
    chosen = {g: list(items) for g, (items, _) in new.items()}
    while new:
        if all(len(chosen[g]) >= share for g in chosen):
            break
        state = materialize(spark, state.mapInArrow(_closer_in_groups(new), columns), "thinned")
        new = {}
        for g, far in farthest(F.col("gap"), pool + 1).items():
            outside = far[pool]["gap"] if len(far) > pool else -np.inf
            choice = _Choice([r["item"] for r in far[:pool]], np.array([r["unit"] for r in far[:pool]]),
                             np.array([r["gap"] for r in far[:pool]]))
            picks = []
            while len(chosen[g]) < share and choice.open.any():
                best = choice.farthest()
                if picks and choice.gaps[best] <= outside:
                    break
                choice.take(best)
                chosen[g].append(choice.ids[best])
                picks.append(best)
            if picks:
                new[g] = [choice.ids[i] for i in picks], choice.units[picks]
    return [item for items in chosen.values() for item in items]


def thin_bank(df: DataFrame, item: str, vector: str, keep: int, groups: int,
              oversample: int = 2, pool: int = 256) -> DataFrame:
    """A diverse core-set of ``keep`` vectors: greedy in groups, then greedy on their union.

    Items are spread over ``groups`` groups by a hash of their id. Every group keeps its own
    ``oversample * keep / groups`` picks, and the final choice is made among those. A group may be
    of any size, as its rows stay in Spark; the driver holds the picks and ``pool`` vectors a group.
    The result depends on the arguments and the ids only.
    """
    if min(keep, groups, oversample) < 1:
        raise ValueError("keep, groups and oversample must be at least 1")
    spark = df.sparkSession
    share = math.ceil(oversample * keep / groups)
    rows = df.select(hash_group(F.col(item), groups).alias("_g"), F.col(item).alias("item"),
                     F.col(vector).alias("vector")).where("item is not null")
    picks = spark.createDataFrame([(i,) for i in _spread_out_in_groups(rows, share, pool)],
                                  T.StructType([df.schema[item]]))
    # `share` picks of each group at most
    union = materialize(spark, df.select(item, vector).join(F.broadcast(picks), item, "left_semi"),
                        "core-set")
    final = diverse_top_k(union, item, vector, keep)
    return union.join(F.broadcast(final.select(item)), item, "left_semi")  # `keep` rows at most


def select_candidates(df: DataFrame, item: str, vector: str, drift_score: str, n_select: int,
                      created_at: Column, min_drift: float = 0.0,
                      reason: str = "drift_coreset") -> DataFrame:
    """Labelling queue rows: enough drift, diverse, with their urgency bucket.

    ``df`` also carries source_path. No candidates give an empty queue.
    """
    enough = df.where(F.col(drift_score) >= min_drift)
    picks = diverse_top_k(enough, item, vector, n_select)
    score = F.col(drift_score)
    none = F.lit(None)
    # the picks are n_select rows at most
    return enough.join(F.broadcast(picks), item).select(
        "pick", derived_id("lq", F.col(item), created_at).alias("item_id"),
        rules.path_key(F.col("source_path")).alias("image_sha256"), "source_path",
        rules.urgency_bucket(score).alias("priority_bucket"),
        F.lit(reason).alias("selection_reason"), score.alias("drift_score"),
        none.cast("double").alias("uncertainty_score"),
        none.cast("string").alias("assigned_reviewer"), none.cast("string").alias("verdict"),
        created_at.alias("created_at"), none.cast("timestamp").alias("reviewed_at"))
