"""Anomaly metrics per key: confusion, ranking, overlap, latency and histogram operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.ordered import (
    exact_quantiles, join_same, join_spread, quantiles_wide, running_totals, slice_cuts, with_slice,
)


def _ratio(top: Column, bottom: Column) -> Column:
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def confusion(df: DataFrame, keys: Sequence[str], label: str, score: str,
              threshold: Column) -> DataFrame:
    """Counts of the 2x2 table at ``score >= threshold``."""
    hit, pos = F.col(score) >= threshold, F.col(label) == 1
    return df.groupBy(*keys).agg(
        F.count_if(~pos & ~hit).alias("tn"), F.count_if(~pos & hit).alias("fp"),
        F.count_if(pos & ~hit).alias("fn"), F.count_if(pos & hit).alias("tp"))


def confusion_table(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The counts as two rows, actual by predicted."""
    return counts.select(*keys, F.explode(F.array(
        F.struct(F.lit("actual_normal").alias("actual"), F.col("tn").alias("predicted_normal"),
                 F.col("fp").alias("predicted_anomaly")),
        F.struct(F.lit("actual_anomaly").alias("actual"), F.col("fn").alias("predicted_normal"),
                 F.col("tp").alias("predicted_anomaly")))).alias("r")).select(*keys, "r.*")


def prf(counts: DataFrame) -> DataFrame:
    """Precision, recall and F1 with 0/0 = 0; specificity is NULL without negatives."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return (
        counts.withColumn("precision", _ratio(tp, tp + fp))
        .withColumn("recall", _ratio(tp, tp + fn))
        .withColumn("f1", _ratio(2 * tp, 2 * tp + fp + fn))
        .withColumn("specificity", F.try_divide(tn.cast("double"), (tn + fp).cast("double")))
    )


def score_counts(df: DataFrame, keys: Sequence[str], label: str, score: str) -> DataFrame:
    """Positives and negatives per distinct score; a hot score becomes one row map-side.

    Rows without a score or a label rank nowhere and are left out.
    """
    return df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(*keys, F.col(score).cast("double").alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))


def cumulative_counts(df: DataFrame, keys: Sequence[str], label: str, score: str,
                      slices: int | None = None) -> DataFrame:
    """Distinct scores with the positives and negatives at or above each of them."""
    counted = score_counts(df, keys, label, score)
    cuts, slices = slice_cuts(df.select(F.col(score).cast("double").alias("score")), "score", slices)
    sliced = with_slice(counted, "score", cuts, slices)
    return running_totals(sliced, keys, "score", ["pos", "neg"], "_slice", descending=True)


def ranking_metrics(df: DataFrame, keys: Sequence[str], label: str, score: str,
                    slices: int | None = None) -> DataFrame:
    """Area under the ROC curve (ties count half) and average precision; NULL with one class."""
    curve = cumulative_counts(df, keys, label, score, slices)
    above = F.col("pos_cum") - F.col("pos")
    sums = curve.groupBy(*keys).agg(
        F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"),
        # products of counts leave the 64-bit range long before the counts do
        F.sum(F.col("neg").cast("double") * (above.cast("double") + F.col("pos") / 2)).alias("_a"),
        F.sum(F.col("pos") * (F.col("pos_cum") / (F.col("pos_cum") + F.col("neg_cum")))
              ).alias("_p"))
    both = (F.col("positives") > 0) & (F.col("negatives") > 0)
    return sums.select(
        *keys, "positives", "negatives",
        F.when(both, F.col("_a") / (F.col("positives").cast("double") * F.col("negatives"))
               ).alias("auroc"),
        F.when(both, F.col("_p") / F.col("positives")).alias("average_precision"))


def evaluation_report(df: DataFrame, keys: Sequence[str], label: str, score: str,
                      threshold: str, slices: int | None = None) -> DataFrame:
    """One wide row per key: ranking metrics and the table at the locked ``threshold`` column."""
    keys = list(keys)
    table = prf(confusion(df, [*keys, threshold], label, score, F.col(threshold)))
    return join_same(table, ranking_metrics(df, keys, label, score, slices), keys)


def with_pixel_report(report: DataFrame, overlap: DataFrame, ranking: DataFrame,
                      keys: Sequence[str]) -> DataFrame:
    """Add pixel overlap and ranking where maps and masks exist, NULL elsewhere."""
    pixels = ranking.select(*keys, F.col("auroc").alias("pixel_auroc"),
                            F.col("average_precision").alias("pixel_average_precision"))
    return join_same(join_same(report, overlap, keys, "left"), pixels, keys, "left")


def pixel_overlap(df: DataFrame, keys: Sequence[str], scores: str, mask: str,
                  threshold: Column) -> DataFrame:
    """IoU and Dice over all pixels of map arrays; 1.0 where nothing is marked.

    Counted inside each row first, so no pixel row is ever shuffled.
    """
    def count(test) -> Column:
        return F.size(F.filter(F.arrays_zip(F.col(scores).alias("v"), F.col(mask).alias("m")),
                               test)).cast("long")

    rows = df.select(
        *keys,
        count(lambda p: (p["v"] >= threshold) & (p["m"] == 1)).alias("_both"),
        count(lambda p: p["v"] >= threshold).alias("_pred"),
        count(lambda p: p["m"] == 1).alias("_true"))
    sums = rows.groupBy(*keys).agg(F.sum("_both").alias("i"), F.sum("_pred").alias("p"),
                                   F.sum("_true").alias("t"))
    union, total = F.col("p") + F.col("t") - F.col("i"), F.col("p") + F.col("t")
    return sums.select(
        *keys,
        F.when(union > 0, F.col("i") / union).otherwise(1.0).alias("pixel_iou"),
        F.when(total > 0, 2 * F.col("i") / total).otherwise(1.0).alias("pixel_dice"))


def explode_pixels(df: DataFrame, keep: Sequence[str], scores: str, mask: str) -> DataFrame:
    """One row per pixel: pixel_score, pixel_label."""
    return df.select(*keep, F.explode(F.arrays_zip(
        F.col(scores).alias("v"), F.col(mask).alias("m"))).alias("_p")).select(
        *keep, F.col("_p.v").cast("double").alias("pixel_score"),
        F.col("_p.m").alias("pixel_label"))


def recall_at_fpr(df: DataFrame, keys: Sequence[str], label: str, score: str,
                  target_fpr: float, slices: int | None = None) -> DataFrame:
    """Anomaly recall at the upper-neighbour quantile of the normal scores.

    A key without both classes keeps its row with NULL results.
    """
    keys = list(keys)
    normal = exact_quantiles(df.where(F.col(label) == 0), keys, score, [1.0 - target_fpr],
                             "higher", slices)
    thresholds = normal.select(*keys, F.col("quantile").alias("threshold"))
    # distinct scores stand for their rows, so no key's rows travel
    counted = score_counts(df, keys, label, score)
    out = join_same(counted, thresholds, keys, "left").groupBy(*keys).agg(
        F.max("threshold").alias("threshold"),
        F.try_divide(F.sum(F.when(F.col("score") >= F.col("threshold"), F.col("pos"))
                           .otherwise(0)), F.sum("pos")).alias("recall"))
    ok = F.col("threshold").isNotNull() & F.col("recall").isNotNull()
    return out.select(*keys, F.when(ok, F.col("threshold")).alias("threshold"),
                      F.when(ok, F.col("recall")).alias("recall"))


def latency_profile(df: DataFrame, keys: Sequence[str], latency_ms: str,
                    slices: int | None = None) -> DataFrame:
    """Linear p50, p95, p99, mean and items per second."""
    keys = list(keys)
    q = quantiles_wide(df, keys, latency_ms, {"p50": 0.50, "p95": 0.95, "p99": 0.99}, slices=slices)
    mean = df.groupBy(*keys).agg(F.avg(latency_ms).alias("mean_ms"))
    return join_same(q, mean, keys).withColumn("throughput_per_second",
                                         F.try_divide(F.lit(1000.0), F.col("mean_ms")))


def score_histogram(df: DataFrame, keys: Sequence[str], score: str, bins: int = 30) -> DataFrame:
    """Equal-width counts, each key over its own range; the last bin is closed, empty bins stay."""
    keys = list(keys)
    span = df.groupBy(*keys).agg(F.min(score).alias("_min"), F.max(score).alias("_max"))
    # one single value gets a range of width one around it
    flat = F.col("_min") == F.col("_max")
    span = span.select(*keys, F.when(flat, F.col("_min") - 0.5).otherwise(F.col("_min")).alias("lo"),
                       F.when(flat, F.col("_max") + 0.5).otherwise(F.col("_max")).alias("hi"))
    place = F.floor((F.col(score) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)
    # equal scores are one row before anything is joined
    valued = df.where(F.col(score).isNotNull()).groupBy(*keys, score).agg(
        F.count(F.lit(1)).alias("_c"))
    counts = join_spread(valued, span, keys, score).groupBy(
        *keys, F.least(place, F.lit(bins - 1)).cast("int").alias("bin")).agg(
        F.sum("_c").alias("_n"))
    grid = span.select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    step = (F.col("hi") - F.col("lo")) / bins
    return join_same(grid, counts, [*keys, "bin"], "left").select(
        *keys, "bin", (F.col("lo") + F.col("bin") * step).alias("bin_start"),
        (F.col("lo") + (F.col("bin") + 1) * step).alias("bin_end"),
        F.coalesce("_n", F.lit(0)).alias("n"))


def distinct_scores(df: DataFrame, keys: Sequence[str], score: str) -> DataFrame:
    """Number of distinct scores per key, by a real distinct instead of one big set."""
    return df.select(*keys, score).distinct().groupBy(*keys).agg(
        F.count(F.lit(1)).alias("distinct_scores"))


def population_stability(df: DataFrame, keys: Sequence[str], value: str, is_reference: Column,
                         bins: int = 10, epsilon: float = 1e-6,
                         slices: int | None = None) -> DataFrame:
    """Population stability index of the current rows against the reference rows, per key.

    Bin edges are linear quantiles of the reference; the outer bins are open. A key without rows
    on one side keeps its row with a NULL index.
    """
    if bins < 2:
        raise ValueError("at least two bins are needed")
    keys = list(keys)
    # equal values are one row before anything is joined
    marked = df.select(*keys, F.col(value).alias("_x"), is_reference.alias("_ref")).where(
        F.col("_ref").isNotNull())
    valued = marked.groupBy(*keys, "_x").agg(F.count_if("_ref").alias("_r"), F.count_if(
        ~F.col("_ref")).alias("_c"))
    probs = [i / bins for i in range(1, bins)]
    edges = exact_quantiles(marked.where("_ref"), keys, "_x", probs, slices=slices).groupBy(*keys).agg(
        # bins - 1 entries per key
        F.sort_array(F.collect_list("quantile")).alias("_edges"))
    counts = join_spread(valued, edges, keys, "_x", "left").groupBy(
        *keys, F.coalesce(F.size(F.filter("_edges", lambda e: e <= F.col("_x"))),
                          F.lit(0)).alias("_bin")).agg(
        F.sum("_r").alias("_r"), F.sum("_c").alias("_c"))
    totals = counts.groupBy(*keys).agg(
        F.sum("_r").alias("n_reference"), F.sum("_c").alias("n_current"))
    grid = totals.select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("_bin"))
    r = F.coalesce("_r", F.lit(0)) / F.col("n_reference") + epsilon
    c = F.coalesce("_c", F.lit(0)) / F.col("n_current") + epsilon
    full = (F.col("n_reference") > 0) & (F.col("n_current") > 0)
    return join_same(grid, counts, [*keys, "_bin"], "left").groupBy(
        *keys, "n_reference", "n_current").agg(
        F.sum(F.when(full, (c - r) * F.ln(c / r))).alias("psi"))


def require_psi_input(df: DataFrame, keys: Sequence[str], is_reference: Column) -> None:
    """Raise where a key has no reference or no current rows."""
    bad = df.groupBy(*keys).agg(
        F.count_if(is_reference).alias("r"), F.count_if(~is_reference).alias("c")).where(
        "r = 0 or c = 0").limit(1).count()
    if bad:
        raise ValueError("both samples need at least one row per key")


def status_counts(df: DataFrame, status: str, complete: Sequence[str] = ()) -> DataFrame:
    """Rows per status; statuses in ``complete`` appear with zero when absent."""
    counts = df.groupBy(status).agg(F.count(F.lit(1)).alias("n"))
    if not complete:
        return counts
    zero = df.sparkSession.createDataFrame([(s,) for s in complete], [status])
    return counts.join(zero, status, "full_outer").select(
        status, F.coalesce("n", F.lit(0)).alias("n"))


def best_row(df: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """The row with the greatest ``order`` per key, by partial aggregation."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(
        *keys, "_r.*")


