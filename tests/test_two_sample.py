"""The two-sample test against plain NumPy, its error rate and its power."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators.lifecycle import random_features
from plumbline.operators.two_sample import median_scale, split_sums, two_sample_test

SCHEMA = "id long, k string, x array<double>, ref boolean"


def plain_test(rows, dim, features, replicates, scale, seed):
    turn, phase = random_features(dim, features, 1.0, seed)
    x = np.array([r[2] for r in rows])
    z = np.sqrt(2 / features) * np.cos(x @ turn.T / scale + phase)
    bits = np.array([[int(c) for c in "".join(f"{b:08b}" for k in range(-(-replicates // 256))
                      for b in hashlib.sha256(f"{seed}|{r[0]}{f'|{k}' if k else ''}".encode()).digest())][:replicates]
                     for r in rows], bool)

    def distance(side):
        n, m = side.sum(), (~side).sum()
        if not n or not m:
            return None, None
        d = float(((z[side].mean(axis=0) - z[~side].mean(axis=0)) ** 2).sum())
        return d, d / (1 / n + 1 / m)

    mmd, seen = distance(np.array([r[3] for r in rows]))
    null = [s for s in (distance(bits[:, b])[1] for b in range(replicates)) if s is not None]
    return mmd, seen and (1 + sum(s >= seen * (1 - 1e-9) for s in null)) / (1 + len(null))


@pytest.mark.parametrize("replicates,held", [(19, 1 << 22), (300, 200)])
def test_equals_plain_numpy(spark, monkeypatch, replicates, held):
    from plumbline.operators import two_sample

    monkeypatch.setattr(two_sample, "_HELD", held)
    rng = np.random.default_rng(replicates)
    rows = [(i, k, rng.normal(0.5 * (k == "b" and i % 2), 1, 3).tolist(), i % 2 == 0)
            for i, k in enumerate(["a"] * 40 + ["b"] * 90 + [None] * 9)]
    rows += [(900, "one", [1.0, 2.0, 3.0], True), (901, "two", [1.0, 2.0, 3.0], False), (902, "two", [0.0, 2.0, 3.0], True)]
    extra = [(903, "a", None, True), (904, "a", [1.0], True), (None, "a", [1.0] * 3, True), (905, "a", [1.0] * 3, None)]
    df = spark.createDataFrame(rows + extra, SCHEMA).repartition(5)
    got = {r.k: r for r in two_sample_test(df, ["k"], "id", "x", F.col("ref"), dim=3, features=5,
                                           replicates=replicates, scale=1.5, seed=3).collect()}
    for k in ("a", "b", None, "one", "two"):
        own = [r for r in rows if r[1] == k]
        mmd, p = plain_test(own, 3, 5, replicates, 1.5, 3)
        assert got[k].n_reference == sum(r[3] for r in own)
        if mmd is None:
            assert got[k].mmd is None and got[k].p_value is None and got[k].significant is None
        else:
            assert abs(got[k].mmd - mmd) < 1e-12 and abs(got[k].p_value - p) < 1e-12
    assert two_sample_test(df.limit(0), ["k"], "id", "x", F.col("ref"), dim=3).count() == 0


def test_error_rate_and_power(spark):
    """Uneven sides: few of 200 equal keys are significant, and all that were moved."""
    rng = np.random.default_rng(1)
    rows = [(i, f"{'moved' if g >= 200 else 'same'}{g}", rng.normal(1.2 * (g >= 200 and j < 15), 1, 2).tolist(), j < 15)
            for i, (g, j) in enumerate((g, j) for g in range(230) for j in range(60))]
    df = spark.createDataFrame(rows, SCHEMA)
    got = two_sample_test(df, ["k"], "id", "x", F.col("ref"), dim=2, features=32, replicates=99).collect()
    wrong = np.mean([r.significant for r in got if r.k.startswith("same")])
    assert wrong < 0.12 and np.mean([r.p_value for r in got if r.k.startswith("same")]) > 0.4
    assert np.mean([r.significant for r in got if r.k.startswith("moved")]) > 0.85


def test_scale_and_plan(spark):
    df = spark.createDataFrame([(i, "a", [float(i), 0.0], True) for i in range(5)], SCHEMA)
    assert median_scale(df, "id", "x", 2) == 2.0
    assert median_scale(df.limit(0), "id", "x", 2) == median_scale(df.where("id = 1"), "id", "x", 2) == 1.0
    sums = split_sums(df, ["k"], "id", "x", F.col("ref"), dim=2, features=4, scale=1.0, replicates=9, seed=1)
    plan = sums._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("Exchange") == 1 and "Join" not in plan
