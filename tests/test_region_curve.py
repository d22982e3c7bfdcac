"""Region curves against plain NumPy over all thresholds."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import kernels
from plumbline.operators.region_curve import (defect_area_error, pixel_report, region_curve,
                                              region_curve_area)

SCHEMA = "k string, height int, width int, pixels array<double>, mask array<int>"


def plain_area(images, limit):
    """Trapezoids over every distinct threshold, each evaluated from scratch."""
    regions, outside = [], []
    for scores, mask in images:
        labels = kernels.components(mask == 1)
        regions += [scores[labels == one] for one in np.unique(labels[labels >= 0])]
        outside.append(scores[labels < 0])
    outside = np.concatenate(outside)
    if not regions or not len(outside):
        return None
    points = [(0.0, 0.0)]
    for t in sorted({float(v) for s, _ in images for v in s.ravel()}, reverse=True):
        points.append((float((outside >= t).mean()), float(np.mean([(r >= t).mean() for r in regions]))))
    total = 0.0
    for (x0, y0), (x1, y1) in zip(points, points[1:]):
        if x0 < limit and x1 > x0:
            end = min(x1, limit)
            total += (end - x0) * (y0 + y0 + (y1 - y0) * (end - x0) / (x1 - x0)) / 2
    return total / limit


def sample(rng, n):
    out = []
    for _ in range(n):
        h, w = rng.integers(1, 9, 2)
        mask = (rng.random((h, w)) < 0.3).astype(int)
        out.append((np.round(rng.random((h, w)) + 0.4 * mask, 1), mask))
    return out


@pytest.mark.parametrize("limit", [0.05, 0.3, 1.0])
def test_area_equals_plain_numpy(spark, limit):
    rng = np.random.default_rng(int(limit * 100))
    groups = {"a": sample(rng, 25), "b": sample(rng, 3), None: sample(rng, 4),
              "none": [(np.ones((2, 2)), np.zeros((2, 2), int))], "all": [(np.eye(2), np.ones((2, 2), int))]}
    rows = [(k, *s.shape, s.ravel().tolist(), m.ravel().tolist()) for k, own in groups.items() for s, m in own]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = {r.k: r.region_curve_area for r in region_curve_area(df, ["k"], limit, slices=16).collect()}
    assert got.keys() == groups.keys() and got["none"] is None and got["all"] is None
    for k, own in groups.items():
        want = plain_area(own, limit)
        assert want is None or math.isclose(got[k], want, rel_tol=1e-9), k


def test_curve_ends_and_missing_scores(spark):
    df = spark.createDataFrame([("a", 1, 4, [0.9, float("nan"), 0.5, 0.1], [1, 1, 0, 0]),
                                ("a", 1, 2, [0.2, 0.3], [1, 0])], SCHEMA)
    got = {r.score: (r.fpr, r.overlap) for r in region_curve(df, ["k"]).collect()}
    assert got[0.9] == (0.0, 0.25) and got[0.5] == (1 / 3, 0.25) and got[0.2] == (2 / 3, 0.75)
    assert got[float("-inf")] == (1.0, 1.0)
    assert region_curve_area(df.limit(0), ["k"]).count() == 0
    with pytest.raises(ValueError):
        region_curve_area(df, ["k"], 0.0)


def test_defect_areas_and_report(spark):
    df = spark.createDataFrame([("a", 2, 2, [0.9, 0.8, 0.1, 0.2], [1, 0, 0, 0]),
                                ("a", 2, 2, [0.1, 0.1, 0.1, 0.2], [1, 1, 0, 0]),
                                ("b", 1, 2, [0.9, 0.1], [0, 0]), ("b", 1, 2, [], [])], SCHEMA)
    got = {r.k: r for r in defect_area_error(df, ["k"], F.lit(0.5)).collect()}
    assert (got["a"].images, got["a"].mean_area_error, got["a"].mean_absolute_area_error) == (2, -0.125, 0.375)
    assert got["a"].relative_error == -1 / 3 and got["b"].relative_error is None and got["b"].images == 1
    report = {r.k: r for r in pixel_report(df.where("size(pixels) > 0"), ["k"], F.lit(0.5)).collect()}
    assert report["b"].region_curve_area is None and report["a"].region_count == 2
    assert report["a"].pixel_iou == 0.25
