import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.operators import series
from plumbline.operators.ordered import exact_quantiles, running_totals, slice_cuts, with_slice
from plumbline.policy import DriftPolicy


def scan(values, mu, sigma, p):
    e, c, out = mu, 0.0, []
    for i, x in enumerate(values, 1):
        e = p.ewma_lambda * x + (1 - p.ewma_lambda) * e
        c = max(0.0, c + (mu - x) / sigma - p.cusum_k_sigma)
        lim = mu - p.ewma_limit_sigma * sigma * math.sqrt(
            p.ewma_lambda / (2 - p.ewma_lambda) * (1 - (1 - p.ewma_lambda) ** (2 * i)))
        a, b = e < lim, c > p.cusum_h_sigma
        out.append((i, e, lim, c, "BOTH_ALERT" if a and b else "EWMA_ALERT" if a
                    else "CUSUM_ALERT" if b else "STABLE"))
    return out


def frame(spark, name_values):
    rows = [(k, i, float(v)) for k, vs in name_values.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["k", "t", "x"]))


@pytest.mark.parametrize("lam", [0.25, 0.02, 0.9, 1.0])
@pytest.mark.parametrize("chunk_rows", [1, 7, 400, 5000])
def test_drift_monitor_equals_sequential_scan(spark, lam, chunk_rows):
    rng = np.random.default_rng(5)
    data = {
        "noise": rng.normal(0.85, 0.01, 1500),
        "decline": 0.85 - 0.00001 * np.arange(1500) + rng.normal(0, 0.005, 1500),
        "drop": np.r_[np.full(10, 0.85), np.full(5, 0.60)],
        "one": [0.8],
    }
    policy = DriftPolicy(ewma_lambda=lam)
    df = frame(spark, data).withColumn("baseline_mean", F.lit(0.85)).withColumn(
        "baseline_std", F.lit(0.01))
    out = series.drift_monitor(df, ["k"], ["t"], "x", F.floor(F.col("t") / chunk_rows), policy)
    got = out.orderBy("k", "t").toPandas()
    for k, values in data.items():
        want = pd.DataFrame(scan(values, 0.85, 0.01, policy),
                            columns=["position", "ewma", "lim", "cusum", "status"])
        mine = got[got.k == k].reset_index(drop=True)
        assert (mine.position == want.position).all()
        np.testing.assert_allclose(mine.ewma, want.ewma, atol=1e-12)
        np.testing.assert_allclose(mine.ewma_lower_limit, want.lim, atol=1e-12)
        np.testing.assert_allclose(mine.cusum_down, want.cusum, atol=1e-8)
        assert (mine.trend_status == want.status).all()


def test_window_rollup_takes_first_worst_row_and_last_value(spark):
    df = frame(spark, {"a": [0.85] * 10 + [0.60] * 5, "b": [0.85] * 4}).withColumn(
        "baseline_mean", F.lit(0.85)).withColumn("baseline_std", F.lit(0.01))
    pts = series.drift_monitor(df, ["k"], ["t"], "x", F.floor(F.col("t") / 4))
    win = {r.k: r for r in series.window_rollup(pts, ["k"], "x", "t").collect()}
    assert win["b"].trend_status == "STABLE" and win["b"].drift_pattern == "STABLE"
    ref = scan([0.85] * 10 + [0.60] * 5, 0.85, 0.01, DriftPolicy())
    first = next(r for r in ref if r[4] == "BOTH_ALERT")
    assert win["a"].trend_status == "BOTH_ALERT" and win["a"].drift_pattern == "GRADUAL"
    assert abs(win["a"].ewma_value - first[1]) < 1e-12
    assert win["a"].metric_value == 0.60 and win["a"].n_points == 15


def test_baseline_must_have_spread(spark):
    df = frame(spark, {"a": [1, 1, 1], "b": [1, 2, 3]})
    base = series.baseline_stats(df, ["k"], "x")
    with pytest.raises(ValueError):
        series.require_baselines(df, base, ["k"])
    series.require_baselines(df.where("k = 'b'"), base, ["k"])


def test_policy_bounds():
    for bad in ({"ewma_lambda": 0.0}, {"ewma_lambda": 1.1}, {"psi_medium": 0.3},
                {"min_signals": 0}):
        with pytest.raises(ValueError):
            DriftPolicy(**bad)


@pytest.mark.parametrize("chunk_rows", [1, 3, 100])
def test_lagged_drop_boundaries(spark, chunk_rows):
    df = frame(spark, {"a": [100, 98, 93, 83, 90, 88.5], "b": [1]})
    out = series.lagged_drop(df, ["k"], ["t"], "x", F.floor(F.col("t") / chunk_rows))
    got = [r.drop_class for r in out.where("k = 'a'").orderBy("t").collect()]
    assert got == ["STABLE", "P2_REVIEW", "P1_INCIDENT", "P0_BLOCKED", "STABLE", "STABLE"]
    assert out.where("k = 'b'").head().prior_value is None


@pytest.mark.parametrize("slices", [3, 256])
def test_exact_quantiles_match_numpy(spark, slices):
    rng = np.random.default_rng(1)
    data = {
        "normal": rng.normal(size=1201), "ties": rng.integers(0, 3, 500).astype(float),
        "hot": np.r_[np.zeros(900), rng.exponential(1000, 400)], "single": [4.5],
        "far": rng.normal(1e6, 1, 300),
    }
    probs = [0.0, 0.05, 0.25, 0.5, 0.95, 0.995, 0.999, 1.0]
    df = frame(spark, data).repartition(5)
    for method in ("linear", "higher"):
        got = exact_quantiles(df, ["k"], "x", probs, method, slices).toPandas()
        assert len(got) == len(data) * len(probs)
        for k, values in data.items():
            mine = got[got.k == k].sort_values("prob")
            np.testing.assert_allclose(
                mine["quantile"], np.quantile(np.asarray(values, float), probs, method=method),
                rtol=1e-12, atol=1e-12)
            assert (mine.n == len(values)).all()


def test_running_totals_both_directions(spark):
    rng = np.random.default_rng(2)
    df = frame(spark, {"a": rng.permutation(1000), "b": rng.permutation(37)})
    cuts, slices = slice_cuts(df, "x", 16)
    sliced = with_slice(df, "x", cuts, slices)
    for desc in (False, True):
        out = running_totals(sliced, ["k"], "x", ["t"], "_slice", desc).toPandas()
        for k in ("a", "b"):
            mine = out[out.k == k].sort_values("x", ascending=not desc)
            assert (mine.t_cum.to_numpy() == mine.t.cumsum().to_numpy()).all()


def test_answers_do_not_depend_on_shuffle_partitions(spark):
    rng = np.random.default_rng(3)
    df = frame(spark, {"a": rng.normal(0.85, 0.02, 300)}).withColumn(
        "baseline_mean", F.lit(0.85)).withColumn("baseline_std", F.lit(0.02))
    results = []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for n in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        out = series.drift_monitor(df, ["k"], ["t"], "x", F.floor(F.col("t") / 50))
        results.append(out.orderBy("t").select("ewma", "cusum_down").toPandas().to_numpy())
    spark.conf.set("spark.sql.shuffle.partitions", before)
    np.testing.assert_allclose(results[0], results[1], atol=1e-9)
