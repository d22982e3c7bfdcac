"""Clusters, medoids and quotas over found clusters."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import clusters, lifecycle

SCHEMA = "i long, v array<double>"


def blobs(rng, centres, each, far=0.0):
    dim = centres.shape[1]
    x = np.repeat(centres, each, axis=0) + rng.normal(0, 0.1, (len(centres) * each, dim)) + far
    return [(i, row.tolist()) for i, row in enumerate(x)]


@pytest.mark.parametrize("far", [0.0, 1e6])
def test_finds_separate_groups(spark, far):
    rng = np.random.default_rng(3)
    middles = rng.normal(0, 5, (20, 6))
    rows = blobs(rng, middles, 60, far)
    bad = [(None, [0.0] * 6), (9000, None), (9001, [1.0]), (9002, [float("nan")] * 6)]
    df = spark.createDataFrame(rows + bad, SCHEMA).repartition(6)
    centres = clusters.find_centres(df, "i", "v", dim=6, k=20, seed=4)
    again = clusters.find_centres(df.repartition(3), "i", "v", dim=6, k=20, seed=4)
    np.testing.assert_allclose(centres, again, atol=1e-6)  # whatever the partitioning
    got = clusters.assign_clusters(df, "i", "v", centres).collect()
    assert len(got) == len(rows) and len(centres) == 20
    own = {}
    for r in got:
        own.setdefault(r.cluster, set()).add(r.i // 60)
    split = sum(len(groups) > 1 for groups in own.values())
    assert split <= 2  # k-means may join two groups, but no more than a few
    x = np.array([v for _, v in rows])
    gaps = np.sqrt(((x[:, None] - centres[None]) ** 2).sum(axis=2))
    for r in got:
        assert abs(gaps[r.i, r.cluster] - gaps[r.i].min()) < 1e-6 and abs(r.distance - gaps[r.i].min()) < 1e-6


def test_few_distinct_rows_and_empty(spark):
    df = spark.createDataFrame([(i, [float(i % 3), 0.0]) for i in range(90)], SCHEMA)
    centres = clusters.find_centres(df, "i", "v", dim=2, k=10)
    assert sorted(centres[:, 0].round(9)) == [0.0, 1.0, 2.0]
    assert clusters.find_centres(df.limit(0), "i", "v", dim=2, k=10).shape == (0, 2)
    with pytest.raises(ValueError):
        clusters.assign_clusters(df, "i", "v", np.empty((0, 2)))


def test_medoids_and_quotas(spark):
    rng = np.random.default_rng(5)
    rows = blobs(rng, rng.normal(0, 5, (30, 4)), 40)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({
        "critical": F.col("i") % 40 == 3, "disagreement": F.col("i") % 11 == 0,
        "drift_score": F.lit(0.9), "uncertainty_score": F.lit(0.1)})
    found = clusters.clustered_candidates(df, "i", "v", dim=4, k=40, keep=[
        "critical", "disagreement", "drift_score", "uncertainty_score"])
    table = found.collect()
    near = {}
    for r in table:
        near[r.cluster] = min(near.get(r.cluster, (9e9, 0)), (r.distance, r.i))
    medoids = {r.cluster: r for r in clusters.medoids(found, "i").collect()}
    assert {c: m.i for c, m in medoids.items()} == {c: i for c, (_, i) in near.items()}
    assert sum(m.members for m in medoids.values()) == len(rows)
    picks = lifecycle.quota_selection(found, "i", "cluster", 40, distance="distance").collect()
    assert len({r.cluster for r in picks}) == len(picks) <= 40
    counts = {}
    for r in picks:
        counts[r.stratum] = counts.get(r.stratum, 0) + 1
    assert all(n <= int(lifecycle.QUOTAS[s] * 40 + 1e-9) for s, n in counts.items())
    for r in picks:  # the nearest to the centre among the most urgent of its cluster
        own = [x for x in table if x.cluster == r.cluster]
        for flag in ("critical", "disagreement"):
            own = [x for x in own if x[flag]] or own
        assert r.i == min(own, key=lambda x: (x.distance, x.i)).i
