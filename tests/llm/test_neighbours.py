"""One-bit codes: the error bound, and the search against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm.neighbours import (_lanes_in_reach, build_index, decode, encode, nearest,
                                       plan_lanes, rotation, usable_vectors)


@pytest.mark.parametrize("steps", [1, 3])
def test_estimates_are_within_the_bound(steps):
    rng = np.random.default_rng(1)
    x, q = rng.normal(size=(3000, 64)) * 3, rng.normal(size=(20, 64))
    turns = [rotation(64, 5 + i) for i in range(steps)]
    np.testing.assert_allclose(turns[0] @ turns[0].T, np.eye(64), atol=1e-12)
    codes, scales, bound = encode(x, turns, 3.0)
    assert codes.shape == (3000, 8 * steps) and scales.shape == (3000, steps)
    miss = np.abs(decode(codes, scales, turns) @ q.T - x @ q.T) / np.linalg.norm(q, axis=1)
    assert (miss <= bound[:, None]).mean() > 0.995 and miss.std() > bound.mean() / 20
    assert abs((decode(codes, scales, turns) @ q.T - x @ q.T).mean()) < miss.std() / 5
    still = encode(np.zeros((2, 64)), turns, 3.0)
    assert not still[1].any() and not still[2].any()


def test_lanes_hold_all_cells():
    plan = plan_lanes(np.array([5, 0, 7, 100, 3, 8, 1]), 10)
    assert [c for c, _, _ in plan] == list(range(7))
    assert plan[3] == (3, 2, 10) and plan[0][1] == plan[1][1] == 0 and plan[2][1] == 1
    assert plan[4][1] == 12 and plan[5][1] == 13 and plan[6][1] == 13


def test_clustered_queries_meet_few_lanes(spark):
    """Cells out of reach are never met, and the result is that of brute force."""
    rng = np.random.default_rng(4)
    means = np.eye(32)[:16] * 10
    x = np.repeat(means, 250, axis=0) + rng.normal(size=(4000, 32)) * 0.3
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)],
                               "vec_id long, embedding array<double>")
    index = build_index(df, "vec_id", "embedding", cell_rows=100)
    lanes = {32: plan_lanes(index.counts[32], 250)}
    parts = max(a + n for _, a, n in lanes[32])
    queries = usable_vectors(df.filter("vec_id % 20 = 0"), "vec_id", "embedding").select(
        F.lit(32).alias("dim"), "_id", "_v", F.lit(60.0).alias("bound"))
    asked = queries.mapInArrow(_lanes_in_reach(index, lanes, False),
                               "dim int, lane int, _id long, _v array<double>, bound double").count()
    assert parts >= 16 and asked < 200 * parts / 4
    got = {}
    for r in nearest(df, F.col("vec_id") % 20 == 0, cell_rows=100, lane_rows=250).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    for i in range(0, 4000, 20):
        s = x @ x[i]
        s[i] = -np.inf
        assert len(got[i] & set(np.argsort(-s)[:20].tolist())) >= 19


@pytest.mark.parametrize("dim,sets,lanes", [(64, 4096, 8192), (7, 5, 60), (1, 4096, 8192)])
def test_search_equals_brute_force(spark, dim, sets, lanes):
    rng = np.random.default_rng(dim)
    x = rng.normal(size=(600, dim)).round(2)
    x[100:350] = x[100]  # ties
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    rows += [(1000, None, 0), (1020, [0.0] * dim, 0), (1040, [float("nan")] * dim, 0),
             (1060, [1.0] * (dim - 1) + [None], 0), (1080, [float("inf")] * dim, 0), (1100, [], 0),
             (None, [1.0] * dim, 0), (2000, [1.0] * (dim + 3), 0), (3, [99.0] * dim, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    got = nearest(df.repartition(3), F.col("vec_id") % 20 == 0, k=20, epsilon=8.0, query_set=sets,
                  lane_rows=lanes).collect()
    x[3] = min(x[3].tolist(), [99.0] * dim)  # of rows with one id the smallest vector counts
    usable = [i for i in range(600) if (x[i] != 0).any()]
    want = {}
    for i in usable[::1]:
        if i % 20 == 0:
            pairs = [(-float(np.add.accumulate(x[i] * x[j])[-1]), j) for j in usable if j != i]
            want[i] = sorted(pairs)[:20]
    found = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    assert found == want
    assert [r.rank for r in got if r.query_id == 0] and max(r.rank for r in got) == 20


def test_recall_at_production_settings(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(4000, 64)).astype("float32")
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)],
                               "vec_id long, embedding array<float>")
    got = nearest(df, F.col("vec_id") % 20 == 0).select("query_id", "vec_id").collect()
    scores = x.astype(float) @ x[::20].astype(float).T
    hits = 0
    for k, i in enumerate(range(0, 4000, 20)):
        s = scores[:, k].copy()
        s[i] = -np.inf
        hits += len({int(j) for j in np.argsort(-s)[:20]} & {r.vec_id for r in got if r.query_id == i})
    assert hits / (200 * 20) >= 0.99


def test_few_and_no_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (5, [1.0, 0.0]), (7, [3.0, 1.0])],
                               "vec_id long, embedding array<double>")
    got = nearest(df, F.col("vec_id") % 20 == 0).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(7, 5.0), (5, 1.0)]
    assert nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
