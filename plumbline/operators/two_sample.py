"""A two-sample test of vectors: kernel distance of the means and its significance, in one pass.

The distance is that of :func:`lifecycle.kernel_discrepancy`. How large it gets by chance is told by
random splits: in each of ``replicates`` splits a row falls to one of two sides by a bit of the hash
of its id, so every task adds its rows to all splits at once, sums are merged per key and split, and
no row is read twice or moved. Distances are divided by what unequal sides add to them, so that
random splits into halves speak for samples of any sizes. The p-value is the rank of the observed
distance among those of the splits.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.lifecycle import random_features

_HELD = 1 << 19  # numbers a task holds before it passes its sums on


def sign_source(row_id: Column, seed: int) -> Column:
    """The text whose SHA-256 deals a row to the sides of the splits, bit by bit."""
    return F.concat_ws("|", F.lit(str(seed)), row_id.cast("string"))


def median_scale(df: DataFrame, row_id: str, vector: str, dim: int, sample: int = 256,
                 seed: int = 5) -> float:
    """Median distance between the vectors of the ``sample`` rows with the smallest hashes; 1.0 if
    there is none above zero."""
    rows = df.where((F.size(vector) == dim) & F.col(row_id).isNotNull()).select(
        F.col(vector).cast("array<double>").alias("_v"),
        F.sha2(sign_source(F.col(row_id), seed), 256).alias("_h")).orderBy("_h").limit(sample)
    x = np.array([r["_v"] for r in rows.collect()]).reshape(-1, dim)
    a, b = np.triu_indices(len(x), 1)
    middle = float(np.median(np.sqrt(((x[a] - x[b]) ** 2).sum(axis=1)))) if len(a) else 0.0
    return middle if middle > 0 else 1.0


def sign_bits(row_id: Column, seed: int, count: int) -> Column:
    """At least ``count`` bits, as bytes, of a row's hash, further ones from hashes of longer texts."""
    text = sign_source(row_id, seed)
    blocks = [F.unhex(F.sha2(F.concat_ws("|", text, F.lit(str(k))) if k else text, 256))
              for k in range(-(-count // 256))]
    return F.substring(F.concat(*blocks), 1, -(-count // 8))


def split_sums(df: DataFrame, keys: Sequence[str], row_id: str, vector: str, is_reference: Column, *,
               dim: int, features: int, scale: float, replicates: int, seed: int) -> DataFrame:
    """Per key and split ``r`` the summed features of one side and, last, its number of rows.

    Splits 0 to ``replicates - 1`` are random; the next is the reference and the last all rows. Where
    keys are many, rows should come in the order of their keys, so that few sums of a key are merged.
    """
    turn, phase = random_features(dim, features, 1.0, seed)
    turn, gain = turn / scale, np.sqrt(2.0 / features)
    keys = list(keys)
    rows = df.where((F.size(vector) == dim) & is_reference.isNotNull() & F.col(row_id).isNotNull()).select(
        *keys, is_reference.alias("_ref"), sign_bits(F.col(row_id), seed, replicates).alias("_bits"),
        F.col(vector).cast("array<double>").alias("_v"))
    kept = [f for f in rows.schema if f.name in keys]
    kinds = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [
        "r int", "s array<double>"])

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        types = {}

        def flush() -> pa.RecordBatch:
            names = list(held)
            each = np.repeat(np.arange(len(names)), replicates + 2)
            cols = [pa.array([n[i] for n in names], types[k]).take(pa.array(each)) for i, k in enumerate(keys)]
            r = pa.array(np.tile(np.arange(replicates + 2, dtype=np.int32), len(names)))
            flat = np.concatenate([held[n] for n in names])
            held.clear()
            lists = pa.ListArray.from_arrays(np.arange(len(flat) + 1, dtype=np.int32) * (features + 1), flat.ravel())
            return pa.RecordBatch.from_arrays([*cols, r, lists], [*keys, "r", "s"])

        for batch in batches:
            types.update({k: batch.schema.field(k).type for k in keys})
            x = batch["_v"].flatten().to_numpy(zero_copy_only=False).reshape(len(batch), dim)
            z = np.column_stack([gain * np.cos(x @ turn.T + phase), np.ones(len(x))])
            signs = np.frombuffer(b"".join(batch["_bits"].to_pylist()), np.uint8).reshape(len(x), -1)
            sides = np.column_stack([
                np.unpackbits(signs, axis=1, count=replicates),
                np.asarray(batch["_ref"].to_numpy(zero_copy_only=False), np.uint8),
                np.ones(len(x), np.uint8)]).astype(np.float64)
            of: dict[tuple, list[int]] = {}
            names = list(zip(*[batch[k].to_pylist() for k in keys])) if keys else [()] * len(x)
            for i, name in enumerate(names):
                of.setdefault(name, []).append(i)
            for name, own in of.items():
                total = sides[own].T @ z[own]
                held[name] = held[name] + total if name in held else total
            if len(held) * (replicates + 2) * (features + 1) > _HELD:
                yield flush()
        if held:
            yield flush()

    each = F.array(*[F.sum(F.get("s", F.lit(i))) for i in range(features + 1)])
    return rows.mapInArrow(sums, kinds).groupBy(*keys, "r").agg(each.alias("s"))


def two_sample_test(df: DataFrame, keys: Sequence[str], row_id: str, vector: str,
                    is_reference: Column, *, dim: int, features: int = 64, replicates: int = 199,
                    scale: float | None = None, alpha: float = 0.05, seed: int = 5) -> DataFrame:
    """``mmd``, ``p_value`` and ``significant`` of current against reference vectors, per key.

    ``scale`` is the kernel's width; without one it is the median distance of a hash-chosen sample.
    Vectors that are NULL or of another dimension and rows without id do not count. A key without
    rows on one side has NULL results.
    """
    if replicates < 1 or features < 1:
        raise ValueError("need replicates and features")
    keys = list(keys)
    scale = scale or median_scale(df, row_id, vector, dim, seed=seed)
    sums = split_sums(df, keys, row_id, vector, is_reference, dim=dim, features=features, scale=scale,
                      replicates=replicates, seed=seed)
    n = F.get("s", F.lit(features))
    # ``replicates`` + 2 rows of a key at most
    each = sums.groupBy(*keys).agg(
        F.collect_list(F.struct("r", "s")).alias("_each"),
        F.max_by("s", "r").alias("_all")).select(*keys, "_all", F.inline("_each"))
    m = F.get("_all", F.lit(features)) - n
    gaps = F.zip_with(F.slice("s", 1, features), F.slice("_all", 1, features), lambda a, t: F.pow(
        a / n - (t - a) / m, F.lit(2.0)))
    both = each.where(F.col("r") <= replicates).select(
        *keys, "r", n.alias("_n"), m.alias("_m"), F.when((n > 0) & (m > 0), F.aggregate(
            gaps, F.lit(0.0), lambda t, g: t + g)).alias("_d")).withColumn(
        "_s", F.when(F.col("_d").isNotNull(), F.col("_d") / (1 / F.col("_n") + 1 / F.col("_m"))))
    seen = F.col("r") == replicates

    def observed(name: str) -> Column:
        return F.max(F.when(seen, F.col(name)))

    out = both.groupBy(*keys).agg(
        observed("_n").cast("long").alias("n_reference"), observed("_m").cast("long").alias("n_current"),
        observed("_d").alias("mmd"), observed("_s").alias("_o"),
        F.collect_list(F.when(~seen, F.col("_s"))).alias("_null"))  # ``replicates`` numbers at most
    reach = F.size(F.filter("_null", lambda s: s >= F.col("_o") * (1 - 1e-9)))
    return out.withColumn("p_value", F.when(F.col("_o").isNotNull(), (reach + 1) / (F.size("_null") + 1))
                          ).withColumn("significant", F.col("p_value") <= alpha).drop("_null", "_o")
