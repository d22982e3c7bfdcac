"""Reconstruction error against a fitted, stored reference: mean, directions and error quantiles.

A reference is one row per key and version. Its covariance is added up in tasks around their own
means and merged pairwise, so that vectors far from the origin lose no digits. Later windows are
compared with the stored row; the rows it was fitted on are not read again.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.ordered import exact_quantiles, join_same, join_spread, quantiles_wide
from plumbline.session import materialize

_BROADCAST = 500_000  # numbers of all models together that a task may hold
_HELD = 1 << 19  # numbers a task holds before it passes its sums on
_KEY = 64  # numbers that take the room of what Python keeps beside a key's own

Moments = tuple[float, np.ndarray, np.ndarray]


def moments(x: np.ndarray) -> Moments:
    """Count, mean and sum of outer products around the mean."""
    mean = x.mean(axis=0)
    rest = x - mean
    return float(len(x)), mean, rest.T @ rest


def merge_moments(a: Moments, b: Moments) -> Moments:
    """The moments of both samples together, exactly up to rounding."""
    n = a[0] + b[0]
    gap = b[1] - a[1]
    return n, a[1] + gap * (b[0] / n), a[2] + b[2] + np.outer(gap, gap) * (a[0] * b[0] / n)


def _vectors(df: DataFrame, keys: list[str], vector: str, dim: int) -> DataFrame:
    v = F.col(vector).cast("array<double>")
    good = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return df.where((F.size(vector) == dim) & good).select(*keys, v.alias("_v"))


def _key_kinds(df: DataFrame, keys: list[str]) -> list[str]:
    return [f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def _names(batch: pa.RecordBatch, keys: list[str]) -> list[tuple]:
    return list(zip(*[batch[k].to_pylist() for k in keys])) if keys else [()] * len(batch)


def _rows_of(names: list[tuple]) -> dict[tuple, list[int]]:
    of: dict[tuple, list[int]] = {}
    for i, name in enumerate(names):
        of.setdefault(name, []).append(i)
    return of


def key_moments(df: DataFrame, keys: Sequence[str], vector: str, dim: int) -> DataFrame:
    """``n``, ``mean`` and ``spread`` (flat covariance) per key.

    Vectors that are NULL, of another dimension or not finite do not count.
    """
    keys = list(keys)
    rows = _vectors(df, keys, vector, dim)
    kinds = ", ".join([*_key_kinds(rows, keys), "_part int", "_no int", "n double",
                       "mean array<double>", "spread array<double>"])

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, Moments] = {}
        types, part, no = {}, TaskContext.get().partitionId(), 0

        def flush() -> pa.RecordBatch:
            nonlocal no
            no += 1
            found = list(held.items())
            held.clear()
            floats = pa.list_(pa.float64())
            return pa.RecordBatch.from_arrays(
                [*[pa.array([k[i] for k, _ in found], types[key]) for i, key in enumerate(keys)],
                 pa.array([part] * len(found), pa.int32()), pa.array([no] * len(found), pa.int32()),
                 pa.array([m[0] for _, m in found]), pa.array([m[1] for _, m in found], floats),
                 pa.array([m[2].ravel() for _, m in found], floats)],
                [*keys, "_part", "_no", "n", "mean", "spread"])

        for batch in batches:
            types.update({k: batch.schema.field(k).type for k in keys})
            x = _matrix(batch["_v"], dim)
            for name, own in _rows_of(_names(batch, keys)).items():
                new = moments(x[own])
                held[name] = merge_moments(held[name], new) if name in held else new
            if len(held) * (dim * (dim + 1) + _KEY) > _HELD:
                yield flush()
        if held:
            yield flush()

    def merged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted partial moments stream by; one key is held at a time."""
        now, total, types = None, None, {}
        floats = pa.list_(pa.float64())

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [*[pa.array([now[i]], types[k]) for i, k in enumerate(keys)], pa.array([total[0]]),
                 pa.array([total[1]], floats), pa.array([(total[2] / total[0]).ravel()], floats)],
                [*keys, "n", "mean", "spread"])

        for batch in batches:
            types.update({k: batch.schema.field(k).type for k in keys})
            means, spreads = _matrix(batch["mean"], dim), _matrix(batch["spread"], dim * dim)
            for i, (name, n) in enumerate(zip(_names(batch, keys), batch["n"].to_pylist())):
                own = (n, means[i], spreads[i].reshape(dim, dim))
                if name == now:
                    total = merge_moments(total, own)
                    continue
                if now is not None:
                    yield row()
                now, total = name, own
        if now is not None:
            yield row()

    parts = rows.mapInArrow(partial, kinds)
    dealt = parts.repartition(*keys) if keys else parts.repartition(1)
    return dealt.sortWithinPartitions(*keys, "_part", "_no").mapInArrow(merged, ", ".join(
        [*_key_kinds(rows, keys), "n double", "mean array<double>", "spread array<double>"]))


def fit_reference(df: DataFrame, keys: Sequence[str], vector: str, *, dim: int, rank: int,
                  version: str) -> DataFrame:
    """One row per key: ``version, n, mean, directions, captured, p95, p99``.

    ``directions`` are the ``rank`` strongest ones, one after another; ``captured`` is their share of
    the variance (NULL without any), and p95 and p99 are exact quantiles of the reference's own errors.
    """
    if not 0 <= rank <= dim:
        raise ValueError("the rank must lie between zero and the dimension")
    keys = list(keys)
    spread = key_moments(df, keys, vector, dim)

    def directions(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, shares = [], []
            for one in _matrix(batch["spread"], dim * dim):
                values, turned = np.linalg.eigh(one.reshape(dim, dim))
                values = np.maximum(values[::-1], 0)
                flat.append(turned[:, ::-1][:, :rank].T.ravel())
                shares.append(float(values[:rank].sum() / values.sum()) if values.sum() > 0 else None)
            kept = [c for c in batch.schema.names if c != "spread"]
            yield pa.RecordBatch.from_arrays(
                [*[batch[c] for c in kept], pa.array(flat, pa.list_(pa.float64())),
                 pa.array(shares, pa.float64())], [*kept, "directions", "captured"])

    models = materialize(df.sparkSession, spread.mapInArrow(directions, ", ".join(
        [*_key_kinds(spread, keys), "n double", "mean array<double>", "directions array<double>",
         "captured double"])), "reference-directions")
    own = materialize(df.sparkSession, reconstruction_errors(df, models, keys, vector, dim=dim),
                      "reference-errors")
    limits = quantiles_wide(own, keys, "error", {"p95": 0.95, "p99": 0.99}).drop("n")
    return join_same(models, limits, keys, "left").select(
        *keys, F.lit(version).alias("version"), F.col("n").cast("long").alias("n"), "mean", "directions",
        "captured", "p95", "p99")


def reconstruction_errors(df: DataFrame, models: DataFrame, keys: Sequence[str], vector: str, *,
                          dim: int, broadcast_values: int = _BROADCAST) -> DataFrame:
    """Keys and ``error`` of every vector whose key has a model: its distance from the plane through
    the model's mean along its directions.

    Models of ``broadcast_values`` numbers together, with ``_KEY`` for each model beside its own, which
    is checked first, are sent to all tasks; more are joined, a hot key being dealt to many tasks.
    """
    keys = list(keys)
    rows = _vectors(df, keys, vector, dim)
    need = models.agg(F.sum(F.size("mean") + F.size("directions") + F.lit(_KEY))).first()[0] or 0
    if need > broadcast_values:
        dealt = rows.withColumn("_by", F.xxhash64("_v"))
        joined = join_spread(dealt, models.select(*keys, "mean", "directions"), keys, "_by")
        rest = F.zip_with("_v", "mean", lambda a, b: a - b)
        # numbers 0 to rank - 1; a rank of zero has none
        steps = F.filter(F.sequence(F.lit(0), F.floor(F.size("directions") / dim).cast("int")),
                         lambda k: k * dim < F.size("directions"))

        def taken(left: Column, k: Column) -> Column:
            d = F.slice("directions", k * dim + 1, F.lit(dim))
            dot = F.aggregate(F.zip_with(left, d, lambda a, b: a * b), F.lit(0.0), lambda t, x: t + x)
            return F.zip_with(left, F.transform(d, lambda x: x * dot), lambda a, b: a - b)

        left = F.aggregate(steps, rest, taken)
        return joined.select(*keys, F.sqrt(F.aggregate(left, F.lit(0.0), lambda t, x: t + x * x)).alias(
            "error"))
    held = {tuple(r[k] for k in keys): (np.array(r["mean"]), np.array(r["directions"]).reshape(-1, dim))
            for r in models.select(*keys, "mean", "directions").collect()}
    shared = df.sparkSession.sparkContext.broadcast(held)

    def errors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, found = _matrix(batch["_v"], dim), np.full(len(batch), np.nan)
            for name, own in _rows_of(_names(batch, keys)).items():
                if name in shared.value:
                    mean, turn = shared.value[name]
                    rest = x[own] - mean
                    rest = rest - (rest @ turn.T) @ turn
                    found[own] = np.sqrt(np.einsum("ij,ij->i", rest, rest))
            known = pa.array(~np.isnan(found))
            yield pa.RecordBatch.from_arrays([*[batch[k] for k in keys], pa.array(found)],
                                             [*keys, "error"]).filter(known)

    return rows.mapInArrow(errors, ", ".join([*_key_kinds(rows, keys), "error double"]))


def window_errors(df: DataFrame, models: DataFrame, keys: Sequence[str], vector: str, *, dim: int
                  ) -> DataFrame:
    """Per key of the window: ``uae_p95_error`` and whether it is ``uae_above_p99`` of the reference."""
    keys = list(keys)
    errors = materialize(df.sparkSession, reconstruction_errors(df, models, keys, vector, dim=dim),
                         "window-errors")
    own = exact_quantiles(errors, keys, "error", [0.95])
    return join_same(own.select(*keys, F.col("quantile").alias("uae_p95_error"), "n"),
                     models.select(*keys, F.col("p99").alias("_p99")), keys, "left").select(
        *keys, "n", "uae_p95_error", (F.col("uae_p95_error") > F.col("_p99")).alias("uae_above_p99"))


def save_reference(models: DataFrame, path: str) -> None:
    """Add a version to the stored references; a version is written once."""
    models.write.partitionBy("version").mode("append").parquet(path)


def load_reference(spark, path: str, version: str) -> DataFrame:
    """The models of one version; only its folder is read."""
    return spark.read.parquet(path).where(F.col("version") == version)
