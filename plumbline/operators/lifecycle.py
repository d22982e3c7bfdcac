"""Operators around a model's life: slow decline, the gate to retraining, quota selection."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.ordered import exact_quantiles, join_same

#: Default settings of slow decline and of the retraining gate.
WEEKLY_DROP, DROP_WEEKS, WITHIN_WEEKS = 0.5, 3, 4
MIN_TARGET, MIN_LABELLED, COOLDOWN_DAYS = 200, 100, 7
#: Shares of a labelling budget.
QUOTAS = {"disagreement": 0.20, "drift": 0.20, "uncertainty": 0.15, "diversity": 0.15,
          "random": 0.05, "critical_expert": 0.25}


def weekly_means(df: DataFrame, keys: Sequence[str], ts: str, value: str) -> DataFrame:
    """Mean per key and calendar week; a hot key is one row per week after the map side."""
    return df.groupBy(*keys, F.date_trunc("week", ts).alias("week")).agg(
        F.avg(value).alias("weekly_mean"))


def gradual_decline(weeks: DataFrame, keys: Sequence[str], drop: float = WEEKLY_DROP,
                    consecutive: int = DROP_WEEKS, within: int = WITHIN_WEEKS) -> DataFrame:
    """Adds weekly_drop, drops_in_row and declining to weekly means.

    A week declines if it ends a run of at least ``consecutive`` drops in adjacent weeks, of which
    ``within`` weeks count. A missing week ends a run, and so does a week without a mean.
    """
    along = Window.partitionBy(*keys).orderBy("week")
    adjacent = F.lag("week").over(along) == F.col("week") - F.expr("INTERVAL 7 DAYS")
    lost = F.when(adjacent, F.lag("weekly_mean").over(along) - F.col("weekly_mean"))
    marked = weeks.withColumn("weekly_drop", lost).withColumn(
        "_down", F.coalesce(F.col("weekly_drop") >= drop, F.lit(False)))
    # the count of weeks without a drop is constant along a run of drops
    island = marked.withColumn("_island", F.sum((~F.col("_down")).cast("int")).over(along))
    run = F.sum(F.col("_down").cast("int")).over(Window.partitionBy(*keys, "_island").orderBy("week"))
    return island.withColumn("drops_in_row", F.least(run, F.lit(within)).cast("int")).withColumn(
        "declining", F.col("drops_in_row") >= consecutive).drop("_down", "_island")


def retraining_gate(models: DataFrame, requests: DataFrame, key: str, now: Column,
                    min_target: int = MIN_TARGET, min_labelled: int = MIN_LABELLED,
                    cooldown_days: int = COOLDOWN_DAYS) -> DataFrame:
    """Whether a model may be retrained, and the reasons why not.

    ``models`` has n_target and n_labelled per key; ``requests`` has requested_at. A request that
    is not yet ``cooldown_days`` old blocks; requests after ``now`` do not count.
    """
    recent = requests.where((F.col("requested_at") <= now) & (
        F.col("requested_at") > now - F.make_dt_interval(F.lit(cooldown_days)))).groupBy(key).agg(
            F.max("requested_at").alias("last_request"))
    reasons = F.array_compact(F.array(
        F.when(F.coalesce("n_target", F.lit(0)) < min_target, "too_few_target_images"),
        F.when(F.coalesce("n_labelled", F.lit(0)) < min_labelled, "too_few_labelled_images"),
        F.when(F.col("last_request").isNotNull(), "cooling_down")))
    return join_same(models, recent, [key], "left").withColumn("reasons", reasons).withColumn(
        "may_retrain", F.size("reasons") == 0)


def quota_selection(candidates: DataFrame, item: str, cluster: str, budget: int,
                    quotas: dict[str, float] | None = None, floor: float = 0.5,
                    distance: str | None = None) -> DataFrame:
    """Items to label: one per cluster, at most ``share * budget`` per stratum.

    ``candidates`` has disagreement and critical (booleans), drift_score and uncertainty_score. A
    cluster sends its most urgent item: critical first, then disagreement, drift, uncertainty and
    the smallest id. With ``distance``, the distance to the cluster's centre, it sends the medoid of
    its critical items, else of those in disagreement, else of all; items without one come last. Strata are tried in that order; what is left goes, by a hash of the id, to
    diversity or random. Within a stratum the greatest score wins, ties to the smallest id.
    """
    quotas = QUOTAS if quotas is None else quotas
    if budget < 0 or any(not 0 <= q <= 1 for q in quotas.values()) or sum(quotas.values()) > 1 + 1e-9:
        raise ValueError("need a budget and shares that add up to one at most")
    flags = [F.coalesce(F.col(c), F.lit(False)) for c in ("critical", "disagreement")]
    scores = [F.coalesce(F.col(c), F.lit(0.0)) for c in ("drift_score", "uncertainty_score")]
    within = scores if distance is None else [
        F.coalesce(-F.col(distance).cast("double"), F.lit(float("-inf")))]
    urgency = F.struct(*[f.cast("int").alias(f"_f{i}") for i, f in enumerate(flags)],
                       *[s.alias(f"_s{i}") for i, s in enumerate(within)], (-F.col(item)).alias("_i"))
    one = candidates.groupBy(cluster).agg(F.max_by(F.struct(
        F.col(item), *[c.alias(n) for c, n in zip(flags + scores, (
            "critical", "disagreement", "drift_score", "uncertainty_score"))]), urgency).alias("_b"))
    rows = one.select(cluster, "_b.*")
    draw = F.conv(F.substring(F.sha2(F.col(item).cast("string"), 256), 1, 8), 16, 10).cast("long")
    stratum = (F.when(F.col("critical"), "critical_expert").when(F.col("disagreement"), "disagreement")
               .when(F.col("drift_score") >= floor, "drift")
               .when(F.col("uncertainty_score") >= floor, "uncertainty")
               .when(draw % 4 == 0, "random").otherwise("diversity"))
    score = F.when(F.col("stratum") == "uncertainty", F.col("uncertainty_score")).when(
        F.col("stratum") == "random", draw / float(1 << 32)).otherwise(F.col("drift_score"))
    limits = F.create_map(*[F.lit(x) for n, q in quotas.items() for x in (n, int(q * budget + 1e-9))])
    place = Window.partitionBy("stratum").orderBy(F.desc("score"), item)
    most = max((int(q * budget + 1e-9) for q in quotas.values()), default=0)
    # the constant bound lets every map task keep the first rows of a stratum only
    return rows.withColumn("stratum", stratum).withColumn("score", score).withColumn(
        "place", F.row_number().over(place)).where(F.col("place") <= most).where(
            F.col("place") <= F.coalesce(limits[F.col("stratum")], F.lit(0))).select(
                "stratum", "place", item, cluster, "score")


def random_features(dim: int, features: int, scale: float, seed: int
                    ) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and phases whose cosines approximate a Gaussian kernel of that scale."""
    rng = np.random.default_rng(seed)
    return rng.normal(0.0, 1.0 / scale, (features, dim)), rng.uniform(0.0, 2 * np.pi, features)


def kernel_discrepancy(df: DataFrame, keys: Sequence[str], vector: str, is_reference: Column, *,
                       dim: int, features: int = 256, scale: float = 1.0, seed: int = 5
                       ) -> DataFrame:
    """Squared maximum mean discrepancy of current against reference vectors, per key.

    The Gaussian kernel is replaced by fixed random features, so the test is a distance of two
    means: one pass with map-side sums and no pairs of rows. Vectors that are NULL or of another
    dimension do not count; a key without rows on one side has a NULL discrepancy.
    """
    turn, phase = random_features(dim, features, scale, seed)
    gain = np.sqrt(2.0 / features)
    rows = df.where(F.size(vector) == dim).select(
        *keys, is_reference.alias("_ref"), F.col(vector).cast("array<double>").alias("_v"))
    kinds = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema
                       if f.name != "_v"] + ["_z array<double>"])

    def mapped(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch["_v"].flatten().to_numpy(zero_copy_only=False).reshape(len(batch), dim)
            z = pa.array(list(gain * np.cos(flat @ turn.T + phase)), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays(
                [batch[c] for c in batch.schema.names if c != "_v"] + [z],
                [c for c in batch.schema.names if c != "_v"] + ["_z"])

    def means(side: Column) -> list[Column]:
        return [F.avg(F.when(side, F.get("_z", F.lit(i)))) for i in range(features)]

    summed = rows.mapInArrow(mapped, kinds).groupBy(*keys).agg(
        F.count_if("_ref").alias("n_reference"), F.count_if(~F.col("_ref")).alias("n_current"),
        F.array(*means(F.col("_ref"))).alias("_a"), F.array(*means(~F.col("_ref"))).alias("_b"))
    gaps = F.zip_with("_a", "_b", lambda a, b: (a - b) * (a - b))
    return summed.select(*keys, "n_reference", "n_current", F.when(
        (F.col("n_reference") > 0) & (F.col("n_current") > 0),
        F.aggregate(gaps, F.lit(0.0), lambda t, g: t + g)).alias("mmd"))


def principal_components(df: DataFrame, vector: str, dim: int, rank: int
                         ) -> tuple[np.ndarray, np.ndarray]:
    """Mean and the ``rank`` strongest directions of all vectors of a dimension.

    Every task sends one matrix of dim x dim sums; the driver adds them and holds nothing else.
    """
    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total, square = 0, np.zeros(dim), np.zeros((dim, dim))
        for batch in batches:
            x = batch["_v"].flatten().to_numpy(zero_copy_only=False).reshape(len(batch), dim)
            count, total, square = count + len(x), total + x.sum(axis=0), square + x.T @ x
        if count:
            row = np.concatenate([[count], total, square.ravel()])
            yield pa.record_batch({"at": pa.array(np.arange(len(row))), "s": pa.array(row)})

    rows = df.where(F.size(vector) == dim).select(F.col(vector).cast("array<double>").alias("_v"))
    found = rows.mapInArrow(sums, "at long, s double").groupBy("at").agg(
        F.sum("s").alias("s")).collect()
    if not found:
        raise ValueError("no vector of that dimension")
    row = np.array([r["s"] for r in sorted(found, key=lambda r: r["at"])])
    mean = row[1:dim + 1] / row[0]
    spread = row[dim + 1:].reshape(dim, dim) / row[0] - np.outer(mean, mean)
    return mean, np.linalg.eigh(spread)[1][:, ::-1][:, :rank].T


def reconstruction_quantile(df: DataFrame, keys: Sequence[str], vector: str, mean: np.ndarray,
                            components: np.ndarray, prob: float = 0.95) -> DataFrame:
    """Exact linear quantile, per key, of the distance between vectors and their projections.

    Vectors that are NULL or of another dimension do not count.
    """
    dim = len(mean)
    rows = df.where(F.size(vector) == dim).select(
        *keys, F.col(vector).cast("array<double>").alias("_v"))
    kinds = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema
                       if f.name != "_v"] + ["_error double"])

    def errors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch["_v"].flatten().to_numpy(zero_copy_only=False).reshape(len(batch), dim) - mean
            left = x - (x @ components.T) @ components
            kept = [c for c in batch.schema.names if c != "_v"]
            yield pa.RecordBatch.from_arrays([batch[c] for c in kept] + [pa.array(np.sqrt(
                np.einsum("ij,ij->i", left, left)))], [*kept, "_error"])

    out = exact_quantiles(rows.mapInArrow(errors, kinds), keys, "_error", [prob])
    return out.select(*keys, F.col("quantile").alias("reconstruction_error"), "n")
