"""Reference models against plain NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import reference_model as rm

SCHEMA = "k string, v array<double>"


def rows_of(rng, k, n, dim, far=0.0):
    base = rng.normal(0, 1, (n, dim)) @ np.diag(np.linspace(3, 0.2, dim))
    return [(k, (x + far).tolist()) for x in base]


def test_moments_far_from_the_origin(spark, monkeypatch):
    monkeypatch.setattr(rm, "_HELD", 60)
    rng = np.random.default_rng(2)
    rows = rows_of(rng, "a", 300, 4, 1e8) + rows_of(rng, None, 50, 4) + rows_of(rng, "one", 1, 4)
    df = spark.createDataFrame([*rows, ("a", None), ("a", [1.0]), ("a", [float("nan")] * 4)], SCHEMA).repartition(7)
    got = {r.k: r for r in rm.key_moments(df, ["k"], "v", 4).collect()}
    assert got.keys() == {"a", None, "one"}
    for k, r in got.items():
        x = np.array([v for key, v in rows if key == k])
        assert r.n == len(x)
        np.testing.assert_allclose(np.array(r.spread).reshape(4, 4), np.cov(x.T, bias=True) if len(x) > 1
                                   else np.zeros((4, 4)), rtol=1e-6, atol=1e-7)
    alone = rm.key_moments(df, [], "v", 4).collect()
    assert len(alone) == 1 and alone[0].n == len(rows)


def plain_errors(x, model, rank):
    mean = model.mean(axis=0)
    turn = np.linalg.eigh(np.cov(model.T, bias=True))[1][:, ::-1][:, :rank]
    rest = (x - mean) - (x - mean) @ turn @ turn.T
    return np.sqrt((rest ** 2).sum(axis=1))


@pytest.mark.parametrize("rank", [0, 2, 5])
def test_fit_and_later_windows(spark, tmp_path, rank):
    rng = np.random.default_rng(rank)
    base = rows_of(rng, "a", 400, 5) + rows_of(rng, "b", 200, 5, 7.0)
    later = rows_of(rng, "a", 100, 5) + [(k, [x + 4 for x in v]) for k, v in rows_of(rng, "b", 80, 5, 7.0)]
    later.append(("new", [1.0] * 5))
    old, new = (spark.createDataFrame(r, SCHEMA).repartition(3) for r in (base, later))
    path = str(tmp_path / "models")
    for version in ("v1", "v2"):
        rm.save_reference(rm.fit_reference(old if version == "v1" else old.where("k = 'a'"), ["k"], "v", dim=5,
                                           rank=rank, version=version), path)
    models = rm.load_reference(spark, path, "v1")
    assert rm.load_reference(spark, path, "v2").count() == 1
    table = {r.k: r for r in models.collect()}
    got = {r.k: r for r in rm.window_errors(new, models, ["k"], "v", dim=5).collect()}
    assert got.keys() == {"a", "b"}  # no model, no error
    for k in ("a", "b"):
        x = np.array([v for key, v in base if key == k])
        own = plain_errors(x, x, rank)
        np.testing.assert_allclose([table[k].p95, table[k].p99], np.quantile(own, [0.95, 0.99]), rtol=1e-9, atol=1e-9)
        then = np.quantile(plain_errors(np.array([v for key, v in later if key == k]), x, rank), 0.95)
        assert abs(got[k].uae_p95_error - then) < 1e-9
        if rank < 5:
            assert got[k].uae_above_p99 == bool(then > table[k].p99)
    assert got["b"].uae_above_p99 or rank == 5
    # the joined path, for models too large to send, gives the same errors
    sent, joined = (sorted((r.k, round(r.error, 7)) for r in rm.reconstruction_errors(
        new, models, ["k"], "v", dim=5, broadcast_values=n).collect()) for n in (1 << 20, 0))
    assert sent == joined and len(sent) == 180


def test_no_variance_and_empty(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0])] * 3, SCHEMA)
    model = rm.fit_reference(df, ["k"], "v", dim=2, rank=1, version="x").first()
    assert model.captured is None and model.p95 == 0.0 and model.n == 3
    assert rm.fit_reference(df.limit(0), ["k"], "v", dim=2, rank=1, version="x").count() == 0
    with pytest.raises(ValueError):
        rm.fit_reference(df, ["k"], "v", dim=2, rank=3, version="x")
    assert rm.window_errors(df, rm.fit_reference(df, ["k"], "v", dim=2, rank=1, version="x"), ["k"], "v",
                            dim=2).select(F.col("uae_above_p99")).first()[0] is False


def test_many_keys_are_passed_on_early(spark):
    """What Python holds per key counts, also where a key has few numbers of its own."""
    rows = [(str(i), [float(j), float(i % 7)]) for i in range(20_000) for j in range(2)]
    df = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    most = rm._HELD // (2 * 3 + rm._KEY)
    assert most < 10_000
    plan = rm.key_moments(df, ["k"], "v", 2)
    assert plan.count() == 20_000 and {r.n for r in plan.select("n").distinct().collect()} == {2.0}
    models = spark.createDataFrame([(str(i), [0.0, 0.0], [1.0, 0.0]) for i in range(10_000)],
                                   "k string, mean array<double>, directions array<double>")
    errors = rm.reconstruction_errors(df, models, ["k"], "v", dim=2)
    assert "Join" in errors._jdf.queryExecution().executedPlan().toString()  # too many to send
    assert errors.count() == 20_000
