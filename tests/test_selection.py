import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.operators import clusters, scoring, selection
from plumbline.plans.bindings import stamp


def vectors(spark, x):
    return spark.createDataFrame(pd.DataFrame({"i": range(len(x)), "v": [r.tolist() for r in x]}),
                                 "i long, v array<float>").repartition(5)


def greedy(x, k):
    """Plain greedy k-centre over directions."""
    unit = [v / np.linalg.norm(v) for v in x.astype(float)]
    picks = [max(range(len(x)), key=lambda i: (unit[i][0], -i))]
    while len(picks) < k:
        rest = [i for i in range(len(x)) if i not in picks]
        picks.append(max(rest, key=lambda i: (
            round(min(np.sum((unit[i] - unit[p]) ** 2) for p in picks), 12), -i)))
    return picks


@pytest.mark.parametrize("pool", [1, 3, 256])
def test_diverse_top_k_equals_greedy(spark, pool):
    rng = np.random.default_rng(4)
    x = np.r_[rng.normal(size=(120, 8)), np.repeat(rng.normal(size=(1, 8)), 60, axis=0)].astype("float32")
    got = selection.diverse_top_k(vectors(spark, x), "i", "v", 15, pool)
    assert [r.i for r in got.orderBy("pick").collect()] == greedy(x, 15)
    assert selection.spread_out(list(range(len(x))), x, 15) == greedy(x, 15)


def test_two_clusters_give_one_pick_each(spark):
    x = np.r_[np.tile([1.0, 0, 0, 0], (10, 1)), np.tile([0, 1.0, 0, 0], (10, 1))]
    picks = [r.i for r in selection.diverse_top_k(vectors(spark, x), "i", "v", 2).orderBy("pick").collect()]
    assert picks[0] < 10 <= picks[1]


def test_equal_and_zero_vectors_never_repeat(spark):
    picks = selection.diverse_top_k(vectors(spark, np.zeros((6, 4))), "i", "v", 4)
    assert [r.i for r in picks.orderBy("pick").collect()] == [0, 1, 2, 3]
    all_of_them = selection.diverse_top_k(vectors(spark, np.ones((3, 4))), "i", "v", 9)
    assert [r.i for r in all_of_them.orderBy("pick").collect()] == [0, 1, 2]
    with pytest.raises(ValueError):
        selection.diverse_top_k(vectors(spark, np.ones((3, 4))), "i", "v", 0)


def test_candidates_respect_the_drift_floor(spark):
    x = np.random.default_rng(1).normal(size=(30, 4))
    df = vectors(spark, x).withColumns({"d": F.col("i") / 29.0, "source_path": F.concat(F.lit("p"), F.col("i"))})
    out = selection.select_candidates(df, "i", "v", "d", 5, stamp(), 0.5).collect()
    assert len(out) == 5 and min(r.drift_score for r in out) >= 0.5
    assert len({r.item_id for r in out}) == 5 and {r.priority_bucket for r in out} <= {"P0", "P1", "P2"}
    assert selection.select_candidates(df, "i", "v", "d", 5, stamp(), 2.0).count() == 0


def test_thin_bank_is_greedy_on_the_union_of_groups(spark):
    x = np.random.default_rng(2).normal(size=(400, 6)).astype("float32")
    df = vectors(spark, x)
    thin = selection.thin_bank(df, "i", "v", keep=20, groups=4)
    group = {r.i: r.g for r in df.select("i", selection.hash_group(F.col("i"), 4).alias("g")).collect()}
    union = []
    for g in range(4):
        own = [i for i in range(400) if group[i] == g]
        union += [own[j] for j in greedy(x[own], 10)]
    union.sort()
    assert sorted(r.i for r in thin.collect()) == sorted(union[j] for j in greedy(x[union], 20))
    again = selection.thin_bank(df.repartition(3), "i", "v", keep=20, groups=4)
    assert thin.select("i").exceptAll(again.select("i")).count() == 0


@pytest.mark.parametrize("pool", [1, 3, 256])
def test_thin_bank_holds_no_group_in_a_task(spark, monkeypatch, pool):
    x = np.random.default_rng(5).normal(size=(90, 6)).astype("float32")
    x[40:70] = x[40]
    df = vectors(spark, x)

    def refuse(*args, **kwargs):
        raise AssertionError("a group becomes one frame")

    for name in ("applyInPandas", "applyInArrow"):
        monkeypatch.setattr(type(df.groupBy("i")), name, refuse)
    group = {r.i: r.g for r in df.select("i", selection.hash_group(F.col("i"), 2).alias("g")).collect()}
    union = []
    for g in range(2):
        own = [i for i in range(90) if group[i] == g]
        union += [own[j] for j in greedy(x[own], 8)]
    union.sort()
    thin = selection.thin_bank(df, "i", "v", keep=8, groups=2, pool=pool)
    assert thin.dtypes == df.dtypes
    assert sorted(r.i for r in thin.collect()) == sorted(union[j] for j in greedy(x[union], 8))
    assert selection.thin_bank(df, "i", "v", keep=90, groups=2, pool=pool).count() == 90


def test_knn_equals_brute_force_for_any_block(spark):
    rng = np.random.default_rng(3)
    for shift in (0.0, 1e6):
        q, b = rng.normal(size=(150, 5)) + shift, rng.normal(size=(400, 5)) + shift
        b[:200] = b[0]  # half the bank is one copy
        d = np.sqrt(((q[:, None] - b[None]) ** 2).sum(axis=2))
        want = np.sort(d, axis=1)[:, :9].mean(axis=1)
        frames = [spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)],
                                        "i long, v array<double>") for m in (q, b)]
        for rows in (32_768, 70, 8):  # the last leaves some pairs of slice and block empty
            got = scoring.knn_score(*frames, "i", "v", 9, rows).orderBy("i").toPandas()
            np.testing.assert_allclose(got.score, want, rtol=1e-9)
    few = scoring.knn_score(frames[0], frames[1].limit(2), "i", "v", 9).toPandas()
    assert len(few) == 150
    with pytest.raises(ValueError):
        scoring.knn_score(frames[0], frames[1].where("i < 0"), "i", "v")


def test_clustered_queries_meet_few_lanes(spark):
    """Cells out of reach are never met; a third of the bank is one vector; scores are exact."""
    rng = np.random.default_rng(6)
    middles = rng.normal(0, 10, (20, 5))
    bank = np.concatenate([np.repeat(middles, 100, axis=0) + rng.normal(0, 0.1, (2000, 5)), np.tile(
        middles[:1], (1000, 1))])
    asked = np.repeat(middles, 10, axis=0) + rng.normal(0, 0.1, (200, 5))
    frames = [spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i long, v array<double>")
              for x in (asked, bank)]
    placed, cells = scoring.bank_cells(clusters.usable(frames[1], "i", "v", 5), 5, cell_rows=60)
    lanes = max(lane + parts for lane, parts in cells.lanes(150))
    assert lanes >= 15 and max(parts for _, parts in cells.lanes(150)) > 5  # the hot cell is split
    rows = clusters.usable(frames[0], "i", "v", 5).withColumn("bound", F.lit(2.0))
    met = rows.mapInArrow(scoring.lanes_met(cells, 150, False), "_i long, _v array<double>, bound double, lane int")
    assert met.groupBy("_i").count().agg(F.avg("count")).first()[0] < lanes / 2
    assert placed.count() == 3000
    got = scoring.knn_score(*frames, "i", "v", 9, 150, 60).orderBy("i").toPandas()
    gaps = np.sort(np.sqrt(((asked[:, None] - bank[None]) ** 2).sum(axis=2)), axis=1)[:, :9].mean(axis=1)
    np.testing.assert_allclose(got["score"], gaps, rtol=1e-12)


def test_knn_leaves_out_unusable_rows(spark):
    rows = [(1, [0.0, 0.0]), (2, [3.0, 4.0]), (3, None), (4, [1.0]), (5, [float("nan"), 1.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "i long, v array<double>")
    got = {r.i: r.score for r in scoring.knn_score(df, df, "i", "v", 2).collect()}
    assert got == {1: 2.5, 2: 2.5}
    assert scoring.knn_score(df.limit(0), df, "i", "v").count() == 0


def test_small_blocks_do_not_send_a_query_more_often(spark, monkeypatch):
    """A query is sent once per lane, of which there are few; copies in the bank are not sent at all."""
    rng = np.random.default_rng(8)
    asked, bank = rng.normal(size=(90, 6)) + 1e5, rng.normal(size=(600, 6)) + 1e5
    bank[300:500], bank[500:] = bank[0], np.nextafter(bank[1], np.inf)
    sent, keep = {}, scoring.materialize

    def counted(session, frame, label):
        out = keep(session, frame, label)
        sent[label] = sent.get(label, 0) + out.count()
        return out

    monkeypatch.setattr(scoring, "materialize", counted)
    frames = [spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "i long, v array<double>")
              for m in (asked, bank)]
    got = scoring.knn_score(*frames, "i", "v", 9, 5, 40).orderBy("i").toPandas()
    gaps = np.sort(np.sqrt(((asked[:, None] - bank[None]) ** 2).sum(axis=2)), axis=1)[:, :9].mean(axis=1)
    np.testing.assert_allclose(got.score, gaps, rtol=1e-12)
    assert sent["lane-queries"] <= 90 * 2 * scoring._LANES
    assert sent["bank-rows"] == 300 + 8 + 9
