"""Thresholds from validation scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.rules import is_finite
from plumbline.operators.metrics import best_row, cumulative_counts
from plumbline.operators.ordered import count_at_most, exact_quantiles, join_same, join_spread


def only_split(df: DataFrame, split: str, wanted: str) -> DataFrame:
    """Rows of one split; raise when rows of any other split came along."""
    if df.where(~F.col(split).eqNullSafe(F.lit(wanted))).limit(1).count():
        raise ValueError(f"only rows of the {wanted} split may be used here")
    return df


def require_finite(df: DataFrame, score: str) -> DataFrame:
    """Raise on an empty table or on scores that are NULL, NaN or infinite."""
    state = df.agg(F.count(F.lit(1)).alias("n"),
                   F.count_if(~is_finite(F.col(score))).alias("bad")).head()
    if state.n == 0 or state.bad:
        raise ValueError("calibration needs at least one score and only finite ones")
    return df


def normal_quantile_threshold(df: DataFrame, keys: Sequence[str], label: str, score: str,
                              prob: float = 0.995, slices: int | None = None) -> DataFrame:
    """Provisional threshold where no anomalies are known: a linear quantile of normal scores."""
    q = exact_quantiles(df.where(F.col(label) == 0), keys, score, [prob], slices=slices)
    return q.select(*keys, F.col("quantile").alias("threshold"),
                    F.lit(f"normal_quantile_{prob:g}").alias("method"),
                    F.lit("PROVISIONAL_NORMAL_ONLY").alias("status"))


def f1_threshold_at_fpr(df: DataFrame, keys: Sequence[str], label: str, score: str,
                        target_fpr: float = 0.05, slices: int | None = None) -> DataFrame:
    """Best F1 among the scores whose normal false-positive rate stays within the target.

    Every distinct score is a candidate and one pass of running totals gives the rate and F1 of
    all of them. Ties go to the smallest candidate. Where no score qualifies the threshold is the
    next double above the greatest normal score. A key without normal scores has no rate: its
    threshold is NULL and its status NO_NORMALS.
    """
    keys = list(keys)
    curve = cumulative_counts(df, keys, label, score, slices)
    totals = curve.groupBy(*keys).agg(
        F.sum("pos").alias("_P"), F.sum("neg").alias("_N"),
        F.max(F.when(F.col("neg") > 0, F.col("score"))).alias("_top"))
    scored = join_same(curve, totals, keys).select(
        *keys, "score",
        F.try_divide(F.col("neg_cum"), F.col("_N")).alias("fpr"),
        (2 * F.col("pos_cum") / (F.col("pos_cum") + F.col("neg_cum") + F.col("_P"))).alias("f1"))
    best = best_row(scored.where(F.col("fpr") <= target_fpr), keys,
                    F.struct(F.col("f1"), -F.col("score")))
    none, known = F.col("score").isNull(), F.col("_top").isNotNull()
    return join_same(totals, best, keys, "left").select(
        *keys, F.when(none, next_double(F.col("_top"))).otherwise(F.col("score")).alias("threshold"),
        F.when(none & known, 0.0).otherwise(F.col("fpr")).alias("fpr"),
        F.when(none & known, 0.0).otherwise(F.col("f1")).alias("f1"),
        F.lit("recall_at_fpr_then_f1").alias("method"),
        F.when(none & ~known, "NO_NORMALS").otherwise("LOCKED").alias("status"))


def next_double(value: Column) -> Column:
    """The next double above.

    A little more than half a unit in the last place always rounds up to one unit.
    """
    half = F.abs(value) * (2.0 ** -53 * (1 + 2.0 ** -20))
    return F.when(F.abs(value) < 1e-290, value + 5e-324).otherwise(value + half)


def calibrate(df: DataFrame, keys: Sequence[str], label: str, score: str,
              target_fpr: float = 0.05, slices: int | None = None) -> DataFrame:
    """F1 calibration where a key has anomalies, the normal quantile where it has none."""
    keys = list(keys)
    provisional = normal_quantile_threshold(df, keys, label, score, slices=slices)
    with_anomaly = df.groupBy(*keys).agg(F.max(label).alias("_any")).where("_any = 1").select(*keys)
    locked = f1_threshold_at_fpr(df, keys, label, score, target_fpr, slices)
    cols = [*keys, "threshold", "method", "status"]
    marked = with_anomaly.withColumn("_has", F.lit(1))
    return join_same(locked, marked, keys).select(*cols).unionByName(
        join_same(provisional, marked, keys, "left").where("_has IS NULL").select(*cols))


def pixel_normal_threshold(pixels: DataFrame, keys: Sequence[str], score: str,
                           prob: float = 0.999, slices: int | None = None) -> DataFrame:
    """Linear quantile over the pixels of normal maps."""
    q = exact_quantiles(pixels, keys, score, [prob], slices=slices)
    return q.select(*keys, F.col("quantile").alias("pixel_threshold"),
                    F.lit(f"normal_pixel_quantile_{prob:g}").alias("method"))


def linspace(low: float, high: float, n: int) -> list[float]:
    step = (high - low) / (n - 1)
    return [low + step * i for i in range(n - 1)] + [high]


def pixel_f1_threshold(pixels: DataFrame, keys: Sequence[str], label: str, score: str,
                       n_candidates: int = 256, slices: int | None = None) -> DataFrame:
    """First best F1 among quantiles 0.8 to 0.9999 of the pooled pixels.

    Each pixel is counted once under the highest candidate it reaches; summing those counts from
    the top gives all confusion tables together.
    """
    keys = list(keys)
    probs = linspace(0.8, 0.9999, n_candidates)
    # n_candidates entries per key, in the order of their probabilities
    lists = exact_quantiles(pixels, keys, score, probs, slices=slices).groupBy(*keys).agg(
        F.sort_array(F.collect_list("quantile")).alias("_a"))
    # scores are many, so a hot key goes to many tasks
    reached = join_spread(pixels, lists, keys, score).withColumn(
        "_i", count_at_most(F.col("_a"), n_candidates, F.col(score)))
    counts = reached.groupBy(*keys, "_i").agg(
        F.count_if(F.col(label) == 1).alias("_p"), F.count_if(F.col(label) != 1).alias("_n"))
    # bounded by n_candidates + 1 rows per key from here on
    per_key = counts.groupBy(*keys).agg(
        F.sum("_p").alias("_P"),
        F.map_from_entries(F.collect_list(F.struct("_i", F.struct("_p", "_n")))).alias("_m"))
    from_top = Window.partitionBy(*keys).orderBy(F.col("_i").desc()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    table = (
        join_same(lists, per_key, keys)
        .select(*keys, "_P", "_m", F.posexplode("_a").alias("_i", "quantile"))
        .select(*keys, "_P", "_i", "quantile", F.expr("try_element_at(_m, _i + 1)").alias("_c"))
        .select(*keys, "_P", "_i", "quantile",
                F.sum(F.coalesce("_c._p", F.lit(0))).over(from_top).alias("tp"),
                F.sum(F.coalesce("_c._n", F.lit(0))).over(from_top).alias("fp"))
        .withColumn("f1", F.coalesce(
            F.try_divide(2.0 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("_P")), F.lit(0.0)))
    )
    best = best_row(table.select(*keys, "_i", "quantile", "f1"), keys,
                    F.struct("f1", -F.col("_i")))
    return best.select(*keys, F.col("quantile").alias("pixel_threshold"), "f1",
                       F.lit("pixel_f1").alias("method"))


def threshold_record(thresholds: DataFrame, model: Column, manifest_sha: Column,
                     created_at: Column, target_fpr: float) -> DataFrame:
    """Rows for the thresholds table; an image calibration sets both values alike.

    The id is derived from the content, so a rerun writes the same id.
    """
    return thresholds.select(
        F.concat(F.lit("thr_"), F.substring(F.sha2(F.concat_ws(
            "|", model, F.col("method"), F.col("threshold").cast("string"), manifest_sha,
            created_at.cast("string")), 256), 1, 32)).alias("threshold_id"),
        model.alias("model_id"), manifest_sha.alias("dataset_manifest_sha256"),
        F.col("threshold").alias("image_threshold"), F.col("threshold").alias("pixel_threshold"),
        "method", F.lit(float(target_fpr)).alias("target_normal_fpr"),
        F.lit("validation").alias("calibration_split"), created_at.alias("created_at"), "status")
