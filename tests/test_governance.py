import pytest
from pyspark.sql import functions as F

from plumbline.functions import rules
from plumbline.operators import compare, governance
from plumbline.plans.bindings import stamp


def test_upsert_and_insert_ignore(spark):
    now = spark.createDataFrame([("a", 1, 1), ("b", 2, 1)], "k string, v int, seq int")
    new = spark.createDataFrame([("b", 3, 1), ("c", 4, 1), ("c", 5, 2)], "k string, v int, seq int")
    out = {r.k: r.v for r in governance.upsert(now, new, ["k"], "seq").collect()}
    assert out == {"a": 1, "b": 3, "c": 5}
    assert [(r.k, r.v) for r in governance.insert_ignore(now, new, ["k"], "seq").collect()] == [("c", 4)]


def test_incidents_need_enough_signals(spark):
    windows = spark.createDataFrame([(f"w{i}", "GRADUAL", "m", None) for i in range(7)],
                                    "window_id string, drift_pattern string, model_id string, threshold_id string")
    evidence = spark.createDataFrame([(f"w{i}", *[j < i for j in range(6)]) for i in range(7)],
                                     "window_id string, " + ", ".join(f"{s} boolean" for s in rules.SIGNALS))
    out = governance.open_incidents(windows, evidence, stamp())
    got = {r.affected_window_id: r.priority for r in out.collect()}
    assert got == {"w2": "P2_REVIEW", "w3": "P1_INCIDENT", "w4": "P1_INCIDENT",
                   "w5": "P0_BLOCKED", "w6": "P0_BLOCKED"}
    again = governance.open_incidents(windows, evidence, stamp())
    assert out.select("incident_id").exceptAll(again.select("incident_id")).count() == 0
    dec = {r.window_id: r for r in governance.triage_decisions(evidence, "window_id", stamp()).collect()}
    assert dec["w0"].confirming_signal_count == 0 and dec["w6"].confirming_signal_count == 6
    assert dec["w1"].evidence["ewma_alert"] and not dec["w1"].evidence["psi_high"]


def latest(spark):
    return spark.createDataFrame(
        [("r", "c", "CANDIDATE", "t", "m"), ("r", "a", "ACTIVE_BENCHMARK", "t", "m"),
         ("r", "x", "RETIRED", "t", "m"), ("r", "n", "VALIDATED", None, "m")],
        "registry_id string, model_id string, status string, threshold_id string, metrics_path string")


def test_promotion_paths(spark):
    req = spark.createDataFrame([("c", "VALIDATED"), ("c", "ACTIVE_BENCHMARK"), ("x", "CANDIDATE"),
                                 ("ghost", "RETIRED")], "model_id string, to_status string")
    got = {(r.model_id, r.to_status): r.result for r in governance.promote(latest(spark), req).collect()}
    assert got == {("c", "VALIDATED"): "ACCEPTED", ("c", "ACTIVE_BENCHMARK"): "NOT_ALLOWED",
                   ("x", "CANDIDATE"): "NOT_ALLOWED", ("ghost", "RETIRED"): "UNKNOWN_MODEL"}
    one = spark.createDataFrame([("r", "c")], "registry_id string, model_id string").withColumn("event_at", stamp())
    events = governance.promote_and_retire(latest(spark), one)
    assert {(r.model_id, r.status) for r in events.collect()} == {
        ("c", "ACTIVE_BENCHMARK"), ("a", "RETIRED")}
    none = one.withColumn("model_id", F.lit("n"))
    assert governance.promote_and_retire(latest(spark), none).count() == 0


def test_rollback_rejects_unknown_models(spark):
    req = spark.createDataFrame([("a", "x"), ("a", "ghost")], "from_model_id string, to_model_id string").select(
        "*", F.lit("LATENCY").alias("reason"), F.lit("me").alias("triggered_by"),
        F.lit(None).cast("string").alias("incident_id"), stamp().alias("event_at"))
    events, audit, rejected = governance.rollback(latest(spark), req)
    assert {(r.model_id, r.status) for r in events.collect()} == {
        ("x", "ACTIVE_BENCHMARK"), ("a", "RETIRED")}
    assert audit.count() == 1 and [r.to_model_id for r in rejected.collect()] == ["ghost"]


def test_unique_active(spark):
    governance.require_unique_active(latest(spark), ["registry_id"])
    twice = latest(spark).withColumn("status", F.lit("ACTIVE_BENCHMARK"))
    with pytest.raises(ValueError):
        governance.require_unique_active(twice, ["registry_id"])


def test_limit_then_filter_differs(spark):
    df = spark.range(100)
    first = governance.recent(df, 10, F.col("id").desc(), where=F.col("id") % 10 == 0)
    page = governance.recent(df, 10, F.col("id").desc(), then=F.col("id") % 10 == 0)
    assert first.count() == 10 and [r.id for r in page.collect()] == [90]


def test_canary_input_is_checked(spark):
    good = spark.createDataFrame([(1, 0.0)], "sample_count long, disagreement_rate double")
    compare.require_canary_input(good)
    for bad in ([(0, 0.0)], [(1, 1.1)]):
        with pytest.raises(ValueError):
            compare.require_canary_input(spark.createDataFrame(bad, good.schema))
