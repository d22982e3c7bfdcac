import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.operators import calibration, metrics


def scored(spark, data):
    rows = [(k, int(l), float(s)) for k, (ls, ss) in data.items() for l, s in zip(ls, ss)]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["k", "label", "score"])).repartition(4)


def brute_auc(label, score):
    pos, neg = score[label == 1], score[label == 0]
    return np.mean([(p > neg).mean() + 0.5 * (p == neg).mean() for p in pos])


def brute_ap(label, score):
    out, last = 0.0, 0.0
    for c in sorted(set(score), reverse=True):
        hit = score >= c
        tp = (hit & (label == 1)).sum()
        recall = tp / (label == 1).sum()
        out += (recall - last) * tp / hit.sum()
        last = recall
    return out


def f1(label, hit):
    tp = (hit & (label == 1)).sum()
    return 2 * tp / (hit.sum() + (label == 1).sum()) if hit.any() or (label == 1).any() else 0.0


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(11)
    out = {}
    for k, n in {"big": 900, "mid": 120, "tiny": 6}.items():
        label = np.r_[np.ones(n // 3, int), np.zeros(n - n // 3, int)]
        score = np.round(rng.normal(label * 0.8, 1.0), 1 if k == "big" else 4)
        out[k] = (label, score)
    hot = np.r_[np.ones(50, int), np.zeros(250, int)]
    out["hot"] = (hot, np.where(np.arange(300) % 3 == 0, 0.0, rng.normal(hot, 1)))
    out["covered"] = (np.r_[np.ones(4, int), np.zeros(10, int)], np.r_[np.zeros(4), np.ones(10)])
    return out


def test_ranking_and_calibration_against_brute_force(spark, data):
    df = scored(spark, data)
    rank = {r.k: r for r in metrics.ranking_metrics(df, ["k"], "label", "score", 4).collect()}
    best = {r.k: r for r in calibration.f1_threshold_at_fpr(
        df, ["k"], "label", "score", 0.05, 4).collect()}
    rec = {r.k: r for r in metrics.recall_at_fpr(df, ["k"], "label", "score", 0.05).collect()}
    for k, (label, score) in data.items():
        assert rank[k].auroc == pytest.approx(brute_auc(label, score), abs=1e-12)
        assert rank[k].average_precision == pytest.approx(brute_ap(label, score), abs=1e-12)
        ok = [c for c in np.unique(score) if (score[label == 0] >= c).mean() <= 0.05]
        if ok:
            values = [f1(label, score >= c) for c in ok]
            want = ok[int(np.argmax(values))]
        else:
            want = np.nextafter(score[label == 0].max(), np.inf)
        assert best[k].threshold == want
        thr = np.quantile(score[label == 0], 0.95, method="higher")
        assert rec[k].threshold == thr
        assert rec[k].recall == pytest.approx((score[label == 1] >= thr).mean())


def test_one_class_gives_null(spark):
    df = scored(spark, {"n": (np.zeros(4, int), np.arange(4.0))})
    row = metrics.ranking_metrics(df, ["k"], "label", "score").head()
    assert row.auroc is None and row.average_precision is None
    assert metrics.recall_at_fpr(df, ["k"], "label", "score", 0.05).head().recall is None


def test_confusion_and_zero_divisions(spark):
    df = scored(spark, {"a": ([0, 0, 1, 1], [0.1, 0.6, 0.4, 0.9]), "n": ([1, 1], [0.0, 0.1]),
                        "z": ([0], [0.0])})
    got = {r.k: r for r in metrics.prf(metrics.confusion(
        df, ["k"], "label", "score", F.lit(0.5))).collect()}
    assert (got["a"].tn, got["a"].fp, got["a"].fn, got["a"].tp) == (1, 1, 1, 1)
    assert got["a"].f1 == 0.5
    assert got["n"].specificity is None and got["n"].precision == 0.0
    assert got["z"].f1 == 0.0 and got["z"].specificity == 1.0


def test_calibrate_switches_on_anomalies(spark):
    rng = np.random.default_rng(0)
    normal = rng.normal(size=300)
    df = scored(spark, {"plain": (np.zeros(300, int), normal),
                        "both": (np.r_[np.zeros(300, int), 1], np.r_[normal, 9.0])})
    got = {r.k: r for r in calibration.calibrate(df, ["k"], "label", "score").collect()}
    assert got["plain"].status == "PROVISIONAL_NORMAL_ONLY"
    assert got["plain"].method == "normal_quantile_0.995"
    assert got["plain"].threshold == pytest.approx(np.quantile(normal, 0.995))
    assert got["both"].status == "LOCKED" and got["both"].threshold == 9.0


def test_calibration_guards(spark):
    df = spark.createDataFrame([("validation", 0, 1.0), ("test", 0, 2.0)], "split string, label int, score double")
    with pytest.raises(ValueError):
        calibration.only_split(df, "split", "validation")
    with pytest.raises(ValueError):
        calibration.require_finite(df.where("false"), "score")
    with pytest.raises(ValueError):
        calibration.require_finite(df.withColumn("score", F.lit(float("nan"))), "score")
    assert calibration.require_finite(
        calibration.only_split(df.where("split = 'test'"), "split", "test"), "score").count() == 1


def test_pixel_operators_against_brute_force(spark):
    rng = np.random.default_rng(4)
    maps = rng.normal(size=(40, 64)).astype("float32")
    masks = (maps + rng.normal(scale=0.7, size=maps.shape) > 1.2).astype(int)
    df = spark.createDataFrame(pd.DataFrame({
        "k": ["a"] * 25 + ["b"] * 15, "map": list(maps.tolist()), "mask": list(masks.tolist())}))
    pix = metrics.explode_pixels(df, ["k"], "map", "mask")
    over = {r.k: r for r in metrics.pixel_overlap(df, ["k"], "map", "mask", F.lit(1.0)).collect()}
    best = {r.k: r for r in calibration.pixel_f1_threshold(
        pix, ["k"], "pixel_label", "pixel_score").collect()}
    for k, part in {"a": slice(0, 25), "b": slice(25, 40)}.items():
        v, m = maps[part].astype(float).ravel(), masks[part].ravel()
        hit = v >= 1.0
        assert over[k].pixel_iou == pytest.approx((hit & (m == 1)).sum() / (hit | (m == 1)).sum())
        assert over[k].pixel_dice == pytest.approx(f1(m, hit))
        cand = np.quantile(v, np.linspace(0.8, 0.9999, 256))
        scores = [f1(m, v >= c) for c in cand]
        # interpolation may differ in the last digit, which moves a candidate across a pixel
        assert best[k].f1 == pytest.approx(max(scores), abs=0.02)
        assert best[k].pixel_threshold == pytest.approx(cand[int(np.argmax(scores))], abs=0.05)
    empty = metrics.pixel_overlap(df, ["k"], "map", "mask", F.lit(99.0))
    none = df.withColumn("mask", F.transform("mask", lambda x: F.lit(0)))
    assert metrics.pixel_overlap(none, ["k"], "map", "mask", F.lit(99.0)).head().pixel_iou == 1.0
    assert empty.head().pixel_iou == 0.0


def brute_psi(ref, cur, bins=10, eps=1e-6):
    edges = np.quantile(ref, np.linspace(0, 1, bins + 1))
    edges[0], edges[-1] = -np.inf, np.inf
    r = np.histogram(ref, edges)[0] / len(ref) + eps
    c = np.histogram(cur, edges)[0] / len(cur) + eps
    return ((c - r) * np.log(c / r)).sum()


def test_psi(spark):
    rng = np.random.default_rng(8)
    sets = {
        "same": (rng.normal(size=1000), rng.normal(size=700)),
        "moved": (rng.normal(size=400), rng.normal(1.5, 1, 300)),
        "single": (rng.normal(size=50), np.array([0.3])),
        "uniform": (rng.uniform(size=300), rng.uniform(0.5, 1.5, 200)),
    }
    rows = [(k, bool(i == 0), float(x)) for k, pair in sets.items()
            for i, xs in enumerate(pair) for x in xs]
    df = spark.createDataFrame(rows, "k string, ref boolean, x double")
    got = {r.k: r.psi for r in metrics.population_stability(
        df, ["k"], "x", F.col("ref")).collect()}
    for k, (r, c) in sets.items():
        assert got[k] == pytest.approx(brute_psi(r, c), abs=1e-9)
    half = df.where("k = 'same' and ref")
    assert metrics.population_stability(half, ["k"], "x", F.col("ref")).head().psi is None
    with pytest.raises(ValueError):
        metrics.require_psi_input(half, ["k"], F.col("ref"))
    with pytest.raises(ValueError):
        metrics.population_stability(df, ["k"], "x", F.col("ref"), bins=1)


def test_histogram_and_latency(spark):
    rng = np.random.default_rng(9)
    xs = rng.gamma(2, 30, 500)
    df = scored(spark, {"a": (np.zeros(500, int), xs), "flat": (np.zeros(3, int), [2.0] * 3)})
    hist = metrics.score_histogram(df, ["k"], "score").toPandas()
    mine = hist[hist.k == "a"].sort_values("bin")
    assert (mine.n.to_numpy() == np.histogram(xs, 30)[0]).all()
    flat = hist[hist.k == "flat"].sort_values("bin")
    assert (flat.n.to_numpy() == np.histogram([2.0] * 3, 30)[0]).all()
    lat = metrics.latency_profile(df, ["k"], "score").where("k = 'a'").head()
    assert lat.p95 == pytest.approx(np.percentile(xs, 95))
    assert lat.throughput_per_second == pytest.approx(1000 / xs.mean())
    counts = metrics.status_counts(df, "k", ["a", "b"])
    assert {r.k: r.n for r in counts.collect()} == {"a": 500, "flat": 3, "b": 0}
