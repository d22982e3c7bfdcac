"""Scorers: a plug-in point, nearest-neighbour distance and mean residual."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import kernels
from plumbline.operators import clusters
from plumbline.operators.images import _plane
from plumbline.session import materialize

_LANES = 8  # about as often a query is sent at most
_SET = 16_384  # queries that meet a lane in one task
_BLOCK = 4096  # bank rows that are compared at once
_AT_ONCE = 1 << 20  # pairs that are compared at once
_PAIRS = 1 << 15  # pairs whose distance is taken from differences at once
_ROUNDING = 2.0 ** -52


def score_images(images: DataFrame, scorer: Callable, keep: list[str]) -> DataFrame:
    """Apply a scorer to every image: adds score and anomaly_map, NULL for an image without pixels.

    ``scorer`` is a factory that Spark ships to the tasks. It is called once per task and returns
    a function image -> (score, map), so a model is loaded once and not per row.
    """
    schema = T.StructType([*[images.schema[c] for c in keep],
                           T.StructField("score", T.DoubleType()),
                           T.StructField("anomaly_map", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = scorer()
        for pdf in batches:
            done = [(None, None) if px is None else model(_plane(h, w, px))
                    for h, w, px in zip(pdf["height"], pdf["width"], pdf["pixels"])]
            out = pdf[keep].copy()
            out["score"] = pd.Series([None if s is None else float(s) for s, _ in done], pdf.index, "Float64")
            out["anomaly_map"] = [None if m is None else np.asarray(m, dtype=np.float64).ravel()
                                  for _, m in done]
            yield out

    needed = list(dict.fromkeys([*keep, "height", "width", "pixels"]))
    return images.select(*needed).mapInPandas(run, schema)


def residual_scorer(size: int = 15, quantile: float = 0.995, scale: float = 255.0) -> Callable:
    """Distance of the first channel from its blurred self; the score is a high quantile."""
    def build() -> Callable:
        def model(image: np.ndarray) -> tuple[float, np.ndarray]:
            plane = image[..., 0] if image.ndim == 3 else image
            plane = plane.astype(np.float64)
            out = np.abs(plane - kernels.gaussian(plane, size)) / scale
            return float(np.quantile(out, quantile)), out
        return model

    return build


def _improve(best: np.ndarray, asked: np.ndarray, held: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """``best``, the k smallest squared distances of each asked row in no order, with those to ``held``.

    Distances above ``limit`` need not be found. A product of matrices around the mean of ``held``
    tells which pairs can be among the k best, within what rounding may add. Only those are taken
    from differences, so far-off origins cost no digits.
    """
    k = best.shape[1]
    middle = held.mean(axis=0)
    a, b = asked - middle, held - middle
    aa, bb = np.einsum("ij,ij->i", a, a), np.einsum("ij,ij->i", b, b)
    with np.errstate(over="ignore", invalid="ignore"):
        gap = a @ b.T
        gap *= -2
        gap += aa[:, None]
        gap += bb
        slack = _ROUNDING * (held.shape[1] + 8) * (np.sqrt(aa) + np.sqrt(bb.max())) ** 2
        top = np.minimum(limit, best.max(axis=1))
        new = np.flatnonzero(np.isinf(top)) if len(held) > k else ()
        if len(new):
            top[new] = np.partition(gap[new], k - 1, axis=1)[:, k - 1] + slack[new]
        far = gap > (top + slack)[:, None]  # a gap beyond the range of numbers is looked at
    of, to = np.nonzero(~far)
    for at in range(0, len(of), _PAIRS):
        who, step = of[at:at + _PAIRS], asked[of[at:at + _PAIRS]] - held[to[at:at + _PAIRS]]
        squares = np.einsum("ij,ij->i", step, step)
        order = np.lexsort((squares, who))
        rows, first, n = np.unique(who, return_index=True, return_counts=True)
        rank = np.arange(len(who)) - np.repeat(first, n)
        line = np.repeat(np.arange(len(rows)), n)
        found = np.full((len(rows), k), np.inf)
        found[line[rank < k], rank[rank < k]] = squares[order][rank < k]
        best[rows] = np.partition(np.concatenate([best[rows], found], axis=1), k - 1, axis=1)[:, :k]
    return best


@dataclass
class Cells:
    """Cells of a bank: centres, radii (no row is farther from its centre) and rows in each."""

    centres: np.ndarray
    radii: np.ndarray
    rows: np.ndarray

    def lanes(self, lane_rows: int) -> list[tuple[int, int]]:
        """Per cell its first lane and how many it has; small neighbours share one."""
        plan, lane, filled = [], -1, lane_rows
        for n in self.rows.tolist():
            if filled + n > lane_rows:
                lane, filled = lane + 1, 0
            parts = max(1, -(-n // lane_rows))
            plan.append((lane, parts))
            filled += n
            if parts > 1:
                lane, filled = lane + parts - 1, lane_rows
        return plan


def bank_cells(bank: DataFrame, dim: int, cell_rows: int = 2048, most: int = 1024,
               sample: int = 16_384) -> tuple[DataFrame, Cells]:
    """Rows of the bank (``_i``, ``_v``) with their cell, and the cells.

    Centres are fitted on about ``sample`` rows chosen by a hash; every row is in a cell.
    """
    count = bank.count()
    share = F.pmod(F.xxhash64(F.lit("cells"), "_i"), F.lit(1 << 32)) / float(1 << 32)
    drawn = bank.where(share < sample / max(count, 1)).orderBy("_i").select("_v").collect()
    few = np.array([r["_v"] for r in drawn] or [[0.0] * dim])
    even = np.unique(few[np.linspace(0, len(few) - 1, min(
        len(few), most, -(-count // cell_rows) or 1)).astype(int)], axis=0)
    centres = clusters.lloyd(few, np.ones(len(few)), even, 8)

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, gap = clusters.to_centres(clusters.matrix(batch["_v"]), centres)
            yield pa.record_batch({"_i": batch["_i"], "_v": batch["_v"], "cell": pa.array(
                which, pa.int32()), "away": pa.array(gap)})

    kind = dict(bank.dtypes)["_i"]
    placed = materialize(bank.sparkSession, bank.mapInArrow(
        place, f"_i {kind}, _v array<double>, cell int, away double"), "bank-cells")
    cells = Cells(centres, np.full(len(centres), -np.inf), np.zeros(len(centres), np.int64))
    for r in placed.groupBy("cell").agg(F.max("away").alias("far"), F.count(F.lit(1)).alias("n")).collect():
        cells.radii[r["cell"]], cells.rows[r["cell"]] = r["far"], r["n"]
    return placed.select("_i", "_v", "cell"), cells


def lanes_met(cells: Cells, lane_rows: int, home: bool):
    """Every query once per lane it meets: first that of its nearest cell, then all others in reach.

    ``bound`` is the k-th best distance known. By the triangle inequality no row of a cell is nearer
    than the centre's distance less the radius.
    """
    plan = cells.lanes(lane_rows)
    used = np.flatnonzero(cells.rows)

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = clusters.matrix(batch["_v"])
            near = used[clusters.to_centres(rows, cells.centres[used])[0]]
            at_home = np.array([plan[c][0] for c in near.tolist()], np.int32)
            if home:
                yield batch.append_column("lane", pa.array(at_home))
                continue
            bound, met = batch["bound"].to_numpy(), {}
            for c in used.tolist():
                step = rows - cells.centres[c]
                gap = np.sqrt(np.einsum("ij,ij->i", step, step))
                reach = gap - cells.radii[c] <= bound + 1e-9 * (gap + cells.radii[c])
                for lane in range(plan[c][0], plan[c][0] + plan[c][1]):
                    met[lane] = met.get(lane, False) | reach
            for lane, asks in met.items():
                own = batch.filter(pa.array(asks & (at_home != lane)))
                if len(own):
                    yield own.append_column("lane", pa.array(np.full(len(own), lane, np.int32)))

    return meet


def _meet_lanes(k: int, cells: Cells, block_rows: int):
    """Streams groups by ``place``: queries first, then rows of the bank by cell, a batch at a time.

    A query passes over the cells that are out of its reach by then.
    """
    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, asked, ids, rows, best, bound = None, [], None, None, None, None

        def result() -> pa.RecordBatch:
            lists = [np.sort(b[np.isfinite(b)]) for b in best]
            return pa.RecordBatch.from_arrays([ids, pa.array(
                [np.sqrt(x) for x in lists], pa.list_(pa.float64()))], ["_i", "near"])

        for batch in batches:
            keys = np.column_stack([batch[c].to_numpy() for c in ("place", "_kind", "cell")])
            edges = np.flatnonzero(np.any(keys[1:] != keys[:-1], axis=1)) + 1
            for begin, end in zip([0, *edges], [*edges, len(keys)]):
                place, kind, cell = keys[begin]
                if place != group:
                    if best is not None:
                        yield result()
                    group, asked, best = place, [], None
                own = batch.slice(begin, end - begin)
                if kind == 0:
                    asked.append(own)
                    continue
                if not asked:
                    continue
                if best is None:
                    ids = pa.chunked_array([a["_i"] for a in asked]).combine_chunks()
                    rows = np.concatenate([clusters.matrix(a["_v"]) for a in asked])
                    bound = np.concatenate([a["bound"].to_numpy() for a in asked])
                    best = np.full((len(rows), k), np.inf)
                held = clusters.matrix(own["_v"])
                step = rows - cells.centres[cell]
                gap = np.sqrt(np.einsum("ij,ij->i", step, step))
                for low in range(0, len(held), min(block_rows, _BLOCK)):
                    part = held[low:low + min(block_rows, _BLOCK)]
                    known = np.minimum(bound, np.sqrt(best.max(axis=1)))
                    near = np.flatnonzero(gap - cells.radii[cell] <= known + 1e-9 * (gap + cells.radii[cell]))
                    for at in range(0, len(near), max(1, _AT_ONCE // len(part))):
                        few = near[at:at + max(1, _AT_ONCE // len(part))]
                        best[few] = _improve(best[few], rows[few], part, (
                            bound[few] * (1 + 1e-9)) ** 2)
        if best is not None:
            yield result()

    return meet


def knn_score(queries: DataFrame, bank: DataFrame, item: str, vector: str, k: int = 9,
              block_rows: int = 32_768, cell_rows: int = 2048) -> DataFrame:
    """Mean distance to the k nearest bank vectors: rows (item, score).

    ``bank`` has the same two columns. Its rows are filed in cells of about ``cell_rows``, and cells
    in lanes of about ``block_rows``. A query first meets the lane of its nearest cell, whose k-th
    best distance bounds the rest: of the other lanes it meets those with a cell in reach. The k
    best distances, in doubles, are exact; data without clusters has all cells in reach. There are
    about ``_LANES`` lanes at most, so a query is not sent more often; a lane larger than a block meets
    its queries block by block. Of equal bank vectors k take part, as more change no score. A bank
    that is large beside the queries should be thinned first. Vectors that are NULL, not finite or of
    another dimension than the bank's, and rows without id, take no part.
    """
    spark = queries.sparkSession
    first = bank.where(F.size(vector) > 0).select(F.size(vector).alias("n")).limit(1).collect()
    if not first:
        raise ValueError("the bank is empty")
    dim = first[0]["n"]
    unlike = clusters.usable(bank, item, vector, dim).groupBy("_v").agg(F.count(F.lit(1)).alias("_n"))
    few = materialize(spark, unlike.select("_v", F.explode(F.sequence(F.lit(1), F.least(
        "_n", F.lit(k)).cast("int"))).alias("_copy")).select(F.xxhash64("_v", "_copy").alias("_i"), "_v"), "bank-rows")
    placed, cells = bank_cells(few, dim, cell_rows)
    lane_rows = max(block_rows, math.ceil(int(cells.rows.sum()) / _LANES))
    plan = spark.createDataFrame([(c, *lane) for c, lane in enumerate(cells.lanes(lane_rows))],
                                 "cell int, first int, parts int")
    held = placed.join(F.broadcast(plan), "cell").withColumn("lane", (F.col("first") + F.pmod(
        F.xxhash64("_i"), "parts")).cast("int")).select("lane", "cell", "_v")
    asked = materialize(spark, clusters.usable(queries, item, vector, dim).withColumn(
        "bound", F.lit(float("inf"))), "bank-queries")
    kind = dict(asked.dtypes)["_i"]
    found = None
    lanes = max(lane + parts for lane, parts in cells.lanes(lane_rows))
    for home in (True, False)[:lanes]:  # a single lane is every query's home
        met = materialize(spark, asked.mapInArrow(
            lanes_met(cells, lane_rows, home), f"_i {kind}, _v array<double>, bound double, lane int"),
            "lane-queries")
        sets = [(r["lane"], math.ceil(r["count"] / _SET)) for r in met.groupBy(
            "lane").count().orderBy("lane").collect()]
        if not sets:
            continue
        places = np.cumsum([0] + [n for _, n in sets])
        known = spark.createDataFrame([(lane, n, int(at)) for (lane, n), at in zip(sets, places)],
                                      "lane int, sets int, base int")
        groups = met.join(F.broadcast(known), "lane").select(
            (F.col("base") + F.pmod(F.xxhash64("_i"), "sets")).cast("int").alias("place"),
            F.lit(0).alias("_kind"), F.lit(-1).alias("cell"), "_i", "bound", "_v").unionByName(
            held.join(F.broadcast(known), "lane").select(
                F.explode(F.sequence("base", F.col("base") + F.col("sets") - 1)).alias("place"),
                F.lit(1).alias("_kind"), "cell", F.lit(None).cast(kind).alias("_i"),
                F.lit(None).cast("double").alias("bound"), "_v"))
        own = materialize(spark, groups.repartitionById(int(places[-1]), "place").sortWithinPartitions(
            "place", "_kind", "cell").mapInArrow(
            _meet_lanes(k, cells, block_rows), f"_i {kind}, near array<double>"), "lane-near")
        found = own if found is None else found.unionByName(own)
        bounds = own.select("_i", F.when(F.size("near") >= k, F.get("near", F.lit(k - 1))).otherwise(
            float("inf")).alias("bound")).groupBy("_i").agg(F.max("bound").alias("bound"))
        asked = asked.drop("bound").join(bounds, "_i")
    if found is None:
        return spark.createDataFrame([], T.StructType([queries.schema[item], T.StructField(
            "score", T.DoubleType())]))
    # a short list per lane a query met
    merged = found.groupBy("_i").agg(
        F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, k).alias("_d"))
    return merged.select(F.col("_i").alias(item), (F.aggregate("_d", F.lit(0.0), lambda a, v: a + v)
                                                   / F.size("_d")).alias("score"))
