"""The stability index against a stored reference, beside the one that reads all rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import metrics, stability
from plumbline.sources.versions import VersionedTable

SCHEMA = "k string, v double, ref boolean"


def sample(rng, n, ref, shift=0.0):
    return [(k, round(float(rng.normal(shift, 1)), 2), ref) for k in ("a", "b", None) for _ in range(n)]


def test_equals_the_index_over_all_rows(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = sample(rng, 300, True) + sample(rng, 200, False, 0.4) + [("only", 1.0, True), ("new", 1.0, False)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = {r.k: r for r in metrics.population_stability(df, ["k"], "v", F.col("ref")).collect()}
    table = VersionedTable(spark, str(tmp_path / "reference"), ["k"], buckets=4)
    table.upsert(stability.reference_summary(df.where("ref"), ["k"], "v"))
    window = df.where("not ref").select("k", "v")
    window.write.parquet(str(tmp_path / "window"))
    out = stability.stability_index(table.read(), spark.read.parquet(str(tmp_path / "window")), ["k"], "v")
    read = " ".join(out.inputFiles())
    assert "window" in read and "reference" in read and read.count("part-") <= 4 + 20
    got = {r.k: r for r in out.collect()}
    assert got.keys() == {"a", "b", None, "only"}  # a key without a reference has no edges to be held against
    for k in ("a", "b", None):
        assert (got[k].n_reference, got[k].n_current) == (300, 200)
        assert abs(got[k].psi - want[k].psi) < 1e-12 and got[k].psi > 0.05
    assert got["only"].psi is None and got["only"].n_current == 0


def test_extended_and_merged_references(spark):
    rng = np.random.default_rng(6)
    first, more, window = (spark.createDataFrame(sample(rng, n, True, s), SCHEMA) for n, s in (
        (200, 0.0), (150, 0.2), (100, 0.5)))
    base = stability.reference_summary(first, ["k"], "v", 8)
    grown = {r.k: r for r in stability.extend_summary(base, more, ["k"], "v").collect()}
    parts = base.unionByName(stability.extend_summary(base.withColumn(
        "counts", F.transform("counts", lambda n: n * 0)), more, ["k"], "v"))
    merged = {r.k: r for r in stability.merge_summaries(parts, ["k"]).collect()}
    data = {name: {k: np.array([r.v for r in df.collect() if r.k == k]) for k in ("a", None)}
            for name, df in (("first", first), ("more", more), ("window", window))}
    psi = {r.k: r.psi for r in stability.stability_index(
        spark.createDataFrame(list(grown.values()), base.schema), window, ["k"], "v").collect()}
    for k in ("a", None):
        edges = np.quantile(data["first"][k], np.arange(1, 8) / 8)
        count = lambda x: np.bincount(np.searchsorted(edges, x, "right"), minlength=8)
        both = count(data["first"][k]) + count(data["more"][k])
        assert grown[k].counts == merged[k].counts == both.tolist()
        r, c = both / both.sum() + 1e-6, count(data["window"][k]) / 100 + 1e-6
        assert abs(psi[k] - ((c - r) * np.log(c / r)).sum()) < 1e-12
    with pytest.raises(ValueError):
        stability.reference_summary(first, ["k"], "v", 1)
    assert stability.stability_index(base.limit(0), window, ["k"], "v").count() == 0
