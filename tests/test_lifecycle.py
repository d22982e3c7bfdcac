import datetime as dt

import pytest
from pyspark.sql import functions as F

from plumbline.operators import lifecycle

MONDAY = dt.datetime(2024, 1, 1)


def weeks(spark, series):
    rows = [(k, MONDAY + dt.timedelta(weeks=i), v) for k, values in series.items()
            for i, v in enumerate(values) if v != "gap"]
    return spark.createDataFrame(rows, "k string, week timestamp, weekly_mean double")


def test_gradual_decline(spark):
    df = weeks(spark, {"a": [5.0, 4.5, 4.0, 3.5, 3.4], "b": [5.0, 4.0, "gap", 3.0, 2.0, 1.0],
                       None: [9.0, 8.0, 7.0, 6.0, 5.0, 4.0], "n": [5.0, 4.0, None, 2.0, 1.0]})
    got = {}
    for r in lifecycle.gradual_decline(df, ["k"]).orderBy("week").collect():
        got.setdefault(r.k, []).append((r.drops_in_row, r.declining))
    assert got["a"] == [(0, False), (1, False), (2, False), (3, True), (0, False)]
    assert got["b"] == [(0, False), (1, False), (0, False), (1, False), (2, False)]
    assert [n for n, _ in got[None]] == [0, 1, 2, 3, 4, 4] and [n for n, _ in got["n"]] == [0, 1, 0, 0, 1]


def test_weekly_means_start_on_monday(spark):
    df = spark.createDataFrame([("a", MONDAY + dt.timedelta(days=d), float(d)) for d in range(9)],
                               "k string, ts timestamp, v double")
    got = lifecycle.weekly_means(df, ["k"], "ts", "v").orderBy("week").collect()
    assert [r.weekly_mean for r in got] == [3.0, 7.5]


def test_retraining_gate(spark):
    models = spark.createDataFrame([("a", 200, 100), ("b", 199, 99), ("c", 500, 500), ("d", None, 100)],
                                   "m string, n_target long, n_labelled long")
    now = MONDAY + dt.timedelta(days=30)
    asked = spark.createDataFrame([("a", now - dt.timedelta(days=7)), ("c", now - dt.timedelta(days=6)),
                                   ("a", now + dt.timedelta(days=1))], "m string, requested_at timestamp")
    got = {r.m: (r.may_retrain, r.reasons) for r in lifecycle.retraining_gate(
        models, asked, "m", F.lit(now)).collect()}
    assert got == {"a": (True, []), "c": (False, ["cooling_down"]), "d": (False, ["too_few_target_images"]),
                   "b": (False, ["too_few_target_images", "too_few_labelled_images"])}


def test_quota_selection(spark):
    rows = [(i, f"c{i // 2}", i % 10 == 0, i % 10 == 4, (i * 7 % 20) / 20, (i * 3 % 20) / 20)
            for i in range(400)]
    df = spark.createDataFrame(rows, "i long, c string, critical boolean, disagreement boolean, "
                                     "drift_score double, uncertainty_score double")
    got = lifecycle.quota_selection(df, "i", "c", 40).collect()
    counts = {}
    for r in got:
        counts[r.stratum] = counts.get(r.stratum, 0) + 1
    assert len({r.c for r in got}) == len(got) and counts["critical_expert"] == 10
    assert all(n <= int(lifecycle.QUOTAS[s] * 40 + 1e-9) for s, n in counts.items())
    assert all(r.i % 10 == 0 for r in got if r.stratum == "critical_expert")
    assert lifecycle.quota_selection(df, "i", "c", 0).count() == 0
    with pytest.raises(ValueError):
        lifecycle.quota_selection(df, "i", "c", 10, {"drift": 1.5})


def test_kernel_discrepancy(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    rows = [("same", i % 2 == 0, v.tolist()) for i, v in enumerate(rng.normal(size=(400, 4)))]
    rows += [("moved", i % 2 == 0, (v + 2 * (i % 2)).tolist()) for i, v in enumerate(rng.normal(size=(400, 4)))]
    rows += [("one", True, [0.0] * 4), ("one", False, None), ("one", False, [1.0])]
    df = spark.createDataFrame(rows, "k string, ref boolean, v array<double>")
    got = {r.k: r for r in lifecycle.kernel_discrepancy(df, ["k"], "v", F.col("ref"), dim=4, scale=2.0).collect()}
    x = {k: np.array([v for kk, _, v in rows if kk == k]) for k in ("same", "moved")}
    for k, m in x.items():
        a, b = m[::2], m[1::2]
        kernel = lambda p, q: np.exp(-((p[:, None] - q[None]) ** 2).sum(2) / 8.0).mean()
        want = kernel(a, a) + kernel(b, b) - 2 * kernel(a, b)
        assert got[k].mmd == pytest.approx(want, abs=0.05 + 0.2 * want)
    assert got["moved"].mmd > 10 * got["same"].mmd
    assert got["one"].mmd is None and got["one"].n_reference == 1 and got["one"].n_current == 0


def test_reconstruction(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    basis = np.linalg.qr(rng.normal(size=(6, 6)))[0]
    x = rng.normal(size=(500, 6)) * [9, 7, 5, 0.3, 0.2, 0.1] @ basis.T + 3
    df = spark.createDataFrame([(i % 2, v.tolist()) for i, v in enumerate(x)] + [(0, None), (1, [1.0])],
                               "k int, v array<double>").repartition(4)
    mean, parts = lifecycle.principal_components(df, "v", 6, 3)
    np.testing.assert_allclose(mean, x.mean(axis=0))
    np.testing.assert_allclose(parts @ parts.T, np.eye(3), atol=1e-9)
    left = (x - mean) - (x - mean) @ parts.T @ parts
    err = np.sqrt((left ** 2).sum(axis=1))
    assert err.max() < 2
    for r in lifecycle.reconstruction_quantile(df, ["k"], "v", mean, parts).collect():
        assert r.reconstruction_error == pytest.approx(np.quantile(err[r.k::2], 0.95)) and r.n == 250
