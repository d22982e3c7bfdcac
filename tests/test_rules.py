import pytest
from pyspark.sql import functions as F

from plumbline.functions import rules
from plumbline.policy import GatePolicy


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("r")).head().r


@pytest.mark.parametrize("psi,want", [(0.0999, "LOW"), (0.10, "MEDIUM"), (0.2499, "MEDIUM"),
                                      (0.25, "HIGH")])
def test_psi_severity(spark, psi, want):
    assert one(spark, rules.psi_severity(F.lit(psi))) == want


def test_tables_of_boundaries(spark):
    c = F.col("v")

    def table(column, values, kind="double"):
        rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
        return [r.r for r in rows.select("i", column.alias("r")).orderBy("i").collect()]

    assert table(rules.urgency_bucket(c), [0.90, 0.8999, 0.75, 0.7499, 0.5, 0.4999, 0.0]) == [
        "P0", "P1", "P1", "P2", "P2", "P3", "P3"]
    assert table(rules.incident_priority(c), [0, 1, 2, 3, 4, 5, 6], "int") == [
        "INFO", "INFO", "P2_REVIEW", "P1_INCIDENT", "P1_INCIDENT", "P0_BLOCKED", "P0_BLOCKED"]
    assert table(rules.sudden_drop_class(c, F.lit(0.0)), [10.0, 9.99, 5.0, 2.0, 1.99, -3.0]) == [
        "P0_BLOCKED", "P1_INCIDENT", "P1_INCIDENT", "P2_REVIEW", "STABLE", "STABLE"]
    assert table(rules.spreadsheet_safe(c), ["=a", "+a", "-a", "@a", "a=", ""], "string") == [
        "'=a", "'+a", "'-a", "'@a", "a=", ""]
    assert table(rules.normalized_name(c), ["a/B-c_D.x.PNG", "x/.hid-den", "plain", "d/e-f/"],
                 "string") == ["bcd.x", ".hidden", "plain", "ef"]
    assert table(rules.drift_pattern(F.lit("BOTH_ALERT"), c), [3, 4], "int") == ["SUDDEN", "GRADUAL"]
    assert table(rules.drift_pattern(c, F.lit(2)), ["STABLE", "EWMA_ALERT", "CUSUM_ALERT"],
                 "string") == ["STABLE", "TECHNICAL", "GRADUAL"]


def test_decision_and_priority(spark):
    rows = [("PASS", 0.5, 0.5, 0.0, "ANOMALY", "P1"), ("PASS", 0.49, 0.5, 0.5, "NORMAL", "P0"),
            ("PASS", 0.625, 0.5, 0.0, "ANOMALY", "P2"), ("PASS", 1.0, 0.5, 0.0, "ANOMALY", "P3"),
            ("PASS", 0.5, 0.5, 0.03, "ANOMALY", "P2"), ("PASS", 0.5, 0.5, 0.1, "ANOMALY", "P3"),
            ("REVIEW", 0.1, 0.5, 0.0, "REVIEW", "P1"), ("ABSTAIN", 9.0, 0.5, 1.0, "ABSTAIN", "ABSTAIN"),
            ("PASS", 0.0, 0.0, 0.0, "ANOMALY", "P3")]
    df = spark.createDataFrame(rows, "g string, s double, t double, a double, d string, p string")
    d = rules.decide(F.col("s"), F.col("t"), F.col("g"))
    out = df.withColumn("got", d).withColumn("prio", rules.review_priority(
        F.col("got"), F.col("s"), F.col("t"), F.col("a")))
    assert out.where("got <> d or prio <> p").count() == 0


def test_gate_reasons_accumulate_and_hard_limits_win(spark):
    def gate(w, h, std, blur, mean):
        return one(spark, rules.quality_gate(*[F.lit(float(x)) for x in (w, h, std, blur, mean)],
                                             GatePolicy()))

    assert gate(64, 64, 2, 20, 12) == ("PASS", [])
    assert gate(63, 640, 1.9, 0, 0) == (
        "ABSTAIN", ["image_too_small", "extreme_aspect_ratio", "near_uniform_image"])
    assert gate(64, 64, 2, 19.9, 11.9) == ("REVIEW", ["possible_blur", "possible_underexposure"])
    assert gate(64, 64, 2, 20, 243.1) == ("REVIEW", ["possible_overexposure"])


def test_lifecycle_edges(spark):
    states = list(rules.LIFECYCLE)
    rows = [(a, b, b in rules.LIFECYCLE[a]) for a in states for b in states]
    rows += [("NOWHERE", "RETIRED", False), (None, "RETIRED", False)]
    df = spark.createDataFrame(rows, "a string, b string, want boolean")
    assert df.where(rules.transition_allowed(F.col("a"), F.col("b")) != F.col("want")).count() == 0


def test_canary_limits_are_inclusive(spark):
    for rate, delta, want in [(0.05, -0.02, "PASSED"), (0.0501, 0.0, "FAILED"),
                              (0.0, -0.0201, "FAILED")]:
        assert one(spark, rules.canary_status(F.lit(rate), F.lit(delta))) == want


def test_signals_count_nulls_as_false(spark):
    assert one(spark, rules.signal_count(F.lit(True), F.lit(None).cast("boolean"), F.lit(True))) == 2


def test_text_flags(spark):
    rows = [("API_KEY = 'abcdefgh'", True, False), ("token='short'", False, False),
            ("a TODO here", False, True), ("TODOS", False, False)]
    df = spark.createDataFrame(rows, "t string, s boolean, m boolean")
    t = F.col("t")
    assert df.where((rules.secret_flag(t) != F.col("s")) | (rules.marker_flag(t) != F.col("m"))
                    ).count() == 0
