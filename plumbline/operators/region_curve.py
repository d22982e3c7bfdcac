"""Overlap of maps with the regions of their masks over all thresholds, and errors of defect areas.

A pixel of a region weighs one over the region's area, so that the weights at or above a threshold,
divided by the number of regions, are the mean share of a region that the map reaches there. Steps of
the curve are the distinct scores of a key; their running totals are taken by slices of the scores.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import kernels
from plumbline.operators.images import _plane
from plumbline.operators.ordered import join_same, running_totals, slice_cuts, with_slice
from plumbline.session import materialize


def region_steps(images: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key and score: weight inside regions, pixels outside, regions first counted there.

    ``pixels`` is the map and ``mask`` has 1 inside; regions touch at corners too. Equal scores of an
    image are one row before anything is shuffled. A score that is NULL or not a number is below all
    others.
    """
    keys = list(keys)
    schema = T.StructType([*[images.schema[c] for c in keys], *[
        T.StructField(c, T.DoubleType()) for c in ("score", "weight")], *[
        T.StructField(c, T.LongType()) for c in ("outside", "regions")]])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            parts, rows = [], []
            for at, (h, w, px, mask) in enumerate(zip(pdf["height"], pdf["width"], pdf["pixels"],
                                                      pdf["mask"])):
                score = np.asarray(px, np.float64)
                score = np.where(np.isnan(score), -np.inf, score)
                labels = kernels.components(_plane(h, w, mask) == 1).ravel()
                inside = labels >= 0
                weight = np.zeros(len(score))
                _, which, area = np.unique(labels[inside], return_inverse=True, return_counts=True)
                weight[inside] = 1 / area[which]
                steps, of = np.unique(score, return_inverse=True)
                regions = np.zeros(len(steps), np.int64)
                regions[:1] = len(area)
                parts.append(pd.DataFrame({
                    "score": steps, "weight": np.bincount(of, weight, len(steps)),
                    "outside": np.bincount(of, ~inside, len(steps)).astype(np.int64),
                    "regions": regions}))
                rows.append(np.full(len(steps), at))
            if parts:
                own = pdf[keys].iloc[np.concatenate(rows)].reset_index(drop=True)
                yield pd.concat([own, pd.concat(parts, ignore_index=True)], axis=1)[schema.names]

    needed = list(dict.fromkeys([*keys, "height", "width", "pixels", "mask"]))
    return images.select(*needed).mapInPandas(run, schema).groupBy(*keys, "score").agg(*[
        F.sum(c).alias(c) for c in ("weight", "outside", "regions")])


def region_curve(images: DataFrame, keys: Sequence[str], slices: int | None = None) -> DataFrame:
    """Per key and distinct score: ``fpr`` and mean ``overlap`` at that threshold, and both one step
    above it. NULL where a key has no region or no pixel outside."""
    keys = list(keys)
    steps = materialize(images.sparkSession, region_steps(images, keys), "region-steps")
    cuts, slices = slice_cuts(steps, "score", slices)
    curve = running_totals(with_slice(steps, "score", cuts, slices), keys, "score",
                           ["weight", "outside"], "_slice", descending=True)
    totals = steps.groupBy(*keys).agg(F.sum("regions").alias("region_count"),
                                      F.sum("outside").alias("_outside"))
    joined = join_same(curve, totals, keys)

    def share(of: Column, total: str) -> Column:
        return F.try_divide(of.cast("double"), F.col(total).cast("double"))

    both = (F.col("region_count") > 0) & (F.col("_outside") > 0)
    return joined.select(*keys, "score", "region_count", *[F.when(both, c).alias(n) for n, c in {
        "fpr": share(F.col("outside_cum"), "_outside"),
        "overlap": share(F.col("weight_cum"), "region_count"),
        "fpr_above": share(F.col("outside_cum") - F.col("outside"), "_outside"),
        "overlap_above": share(F.col("weight_cum") - F.col("weight"), "region_count")}.items()])


def region_curve_area(images: DataFrame, keys: Sequence[str], limit: float = 0.3,
                      slices: int | None = None) -> DataFrame:
    """Area under the overlap over the false-positive rate up to ``limit``, divided by it.

    Between thresholds the curve is a straight line, also where the limit cuts it. Every step holds
    both its ends, so the sum needs no order. NULL where a key has no region or nothing outside.
    """
    if not 0 < limit <= 1:
        raise ValueError("the limit must lie in (0, 1]")
    keys = list(keys)
    x0, x1, y0, y1 = (F.col(c) for c in ("fpr_above", "fpr", "overlap_above", "overlap"))
    end = F.least(x1, F.lit(float(limit)))
    height = y0 + (y1 - y0) * F.coalesce(F.try_divide(end - x0, x1 - x0), F.lit(0.0))
    area = F.when(x0 < limit, (end - x0) * (y0 + height) / 2).when(x0.isNotNull(), 0.0)
    return region_curve(images, keys, slices).groupBy(*keys).agg(
        F.max("region_count").alias("region_count"), (F.sum(area) / limit).alias("region_curve_area"))


def defect_area_error(images: DataFrame, keys: Sequence[str], threshold: Column) -> DataFrame:
    """How far the marked share of an image is from the share of its mask, over the images of a key.

    ``relative_error`` is that of the summed areas and NULL where no mask marks anything. Pixels are
    counted inside each row, so no pixel row is shuffled.
    """
    keys = list(keys)
    size = F.size("pixels").cast("long")
    counts = images.where(F.size("pixels") > 0).select(
        *keys, size.alias("_n"),
        F.size(F.filter("pixels", lambda v: v >= threshold)).cast("long").alias("_marked"),
        F.size(F.filter("mask", lambda m: m == 1)).cast("long").alias("_true"))
    gap = (F.col("_marked") - F.col("_true")) / F.col("_n")
    return counts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("images"), F.avg(gap).alias("mean_area_error"),
        F.avg(F.abs(gap)).alias("mean_absolute_area_error"), F.max(F.abs(gap)).alias("max_absolute_area_error"),
        F.try_divide((F.sum("_marked") - F.sum("_true")).cast("double"), F.sum("_true").cast(
            "double")).alias("relative_error"))


def pixel_report(images: DataFrame, keys: Sequence[str], threshold: Column, limit: float = 0.3
                 ) -> DataFrame:
    """One wide row per key: overlap, ranking, region curve and defect areas."""
    from plumbline.operators.metrics import explode_pixels, pixel_overlap, ranking_metrics

    keys = list(keys)
    ranking = ranking_metrics(explode_pixels(images, keys, "pixels", "mask"), keys, "pixel_label",
                              "pixel_score").select(
        *keys, F.col("auroc").alias("pixel_auroc"),
        F.col("average_precision").alias("pixel_average_precision"))
    out = pixel_overlap(images, keys, "pixels", "mask", threshold)
    for part in (ranking, region_curve_area(images, keys, limit),
                 defect_area_error(images, keys, threshold)):
        out = join_same(out, part, keys, "left")
    return out
