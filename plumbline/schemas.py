"""Table schemas, allowed values and closed reading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators.audit import contract_violations

# fixed values: the closed value sets of the data model
ALLOWED = {
    "decision": ["NORMAL", "ANOMALY", "REVIEW", "ABSTAIN"],
    "gate_status": ["PASS", "REVIEW", "ABSTAIN"],
    "review_priority": ["P0", "P1", "P2", "P3", "ABSTAIN"],
    "model_status": ["CANDIDATE", "VALIDATED", "ACTIVE_BENCHMARK", "ACTIVE_COMPANY_PILOT",
                     "RETIRED", "REJECTED"],
    "verdict": ["CONFIRMED_NORMAL", "CONFIRMED_ANOMALY", "FALSE_POSITIVE", "FALSE_NEGATIVE",
                "UNSURE"],
    "dataset_status": ["VERIFIED", "BLOCKED", "INVALID"],
    "drift_pattern": ["STABLE", "SUDDEN", "GRADUAL", "SEMANTIC", "TECHNICAL"],
    "trend_status": ["STABLE", "EWMA_ALERT", "CUSUM_ALERT", "BOTH_ALERT"],
    "incident_priority": ["INFO", "P2_REVIEW", "P1_INCIDENT", "P0_BLOCKED"],
    "canary_status": ["NOT_RUN", "RUNNING", "PASSED", "FAILED"],
    "rollback_reason": ["HASH_MISMATCH", "RECALL_DROP", "FP_SPIKE", "LATENCY", "DRIFT_WORSENING",
                        "SAFETY_ALARM"],
    "priority_bucket": ["P0", "P1", "P2", "P3"],
    "label": ["normal", "anomaly"],
    "split": ["train", "validation", "test"],
    "threshold_status": ["LOCKED", "PROVISIONAL_NORMAL_ONLY"],
}


_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(),
          "double": T.DoubleType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType()}


def _table(text: str) -> T.StructType:
    """Schema from "name type" items; a trailing ? marks a nullable column."""
    fields = []
    for item in text.split(","):
        name, kind = item.split()
        fields.append(T.StructField(name, _TYPES[kind.rstrip("?")],
                                    kind.endswith("?")))
    return T.StructType(fields)


def tables() -> dict[str, T.StructType]:
    """The logical tables by name."""
    return {
        "files": _table(
            "dataset_id string, relative_path string, sha256 string, width int, height int,"
            "label string, split string, defect_type string?, mask_path string?,"
            "source_image_id string"),
        "datasets": _table(
            "dataset_id string, source_name string, category string, license string,"
            "commercial_use boolean?, retrieved_at timestamp, source_url string,"
            "split_method string, split_seed long, group_key string,"
            "test_used_for_calibration boolean, verification_status string,"
            "manifest_sha256 string"),
        "scores": _table(
            "item_id string, model_id string, split string, label int, score double,"
            "latency_ms double?, ts timestamp"),
        "thresholds": _table(
            "threshold_id string, model_id string, dataset_manifest_sha256 string,"
            "image_threshold double, pixel_threshold double, method string,"
            "target_normal_fpr double?, calibration_split string, created_at timestamp,"
            "status string"),
        "analyses": _table(
            "analysis_id string, created_at timestamp, source_filename string,"
            "source_sha256 string, decision string, review_priority string, raw_score double,"
            "normalized_score double?, anomaly_area_ratio double, region_count int,"
            "model_id string?, threshold_id string?, quality_status string,"
            "total_latency_ms double, result_json_path string"),
        "feedback": _table(
            "feedback_id string, analysis_id string, created_at timestamp, reviewer string,"
            "verdict string, defect_type string?, comment string?, corrected_mask_path string?"),
        "models": _table(
            "model_id string, algorithm string, status string, artifact_path string,"
            "artifact_sha256 string, metrics_path string?, created_at timestamp,"
            "event_at timestamp"),
        "drift_windows": _table(
            "window_id string, model_id string, threshold_id string?, metric_name string,"
            "window_start timestamp, window_end timestamp, metric_value double?,"
            "ewma_value double?, cusum_value double?, psi_value double?, bbsd_mmd double?,"
            "uae_p95_error double?, trend_status string, drift_pattern string,"
            "source_manifest_sha256 string?, created_at timestamp"),
        "drift_incidents": _table(
            "incident_id string, priority string, drift_pattern string, root_cause string?,"
            "affected_window_id string, model_id string, threshold_id string?,"
            "action_taken string?, resolved_at timestamp?, created_at timestamp"),
        "labeling_queue": _table(
            "item_id string, image_sha256 string, source_path string, priority_bucket string,"
            "selection_reason string, drift_score double?, uncertainty_score double?,"
            "assigned_reviewer string?, verdict string?, created_at timestamp,"
            "reviewed_at timestamp?"),
        "canary_runs": _table(
            "canary_id string, champion_model_id string, challenger_model_id string,"
            "sample_count long, disagreement_rate double, critical_recall_delta double,"
            "latency_p95_ms double, status string, created_at timestamp"),
        "rollback_events": _table(
            "rollback_id string, from_model_id string, to_model_id string, reason string,"
            "triggered_by string, incident_id string?, created_at timestamp"),
        "regions": _table(
            "image_id string, region_id int, x0 int, y0 int, x1 int, y1 int, area_pixels int,"
            "area_ratio double, mean_score double, max_score double, centroid_x double,"
            "centroid_y double"),
    }


def _one_of(column: str, values: str) -> Column:
    return F.col(column).isin(*ALLOWED[values])


def _optional(column: str, test: Column) -> Column:
    return F.col(column).isNull() | test


def contract(table: str) -> dict[str, Column]:
    """Named row tests of a table: value sets, bounds and required columns."""
    unit = {
        "thresholds": ["target_normal_fpr"], "analyses": ["anomaly_area_ratio"],
        "canary_runs": ["disagreement_rate"], "regions": ["area_ratio"],
    }
    value_sets = {
        "files": {"label": "label", "split": "split"},
        "datasets": {"verification_status": "dataset_status"},
        "scores": {"split": "split"},
        "thresholds": {"status": "threshold_status"},
        "analyses": {"decision": "decision", "review_priority": "review_priority",
                     "quality_status": "gate_status"},
        "feedback": {"verdict": "verdict"}, "models": {"status": "model_status"},
        "drift_windows": {"trend_status": "trend_status", "drift_pattern": "drift_pattern"},
        "drift_incidents": {"priority": "incident_priority", "drift_pattern": "drift_pattern"},
        "labeling_queue": {"priority_bucket": "priority_bucket", "verdict": "verdict"},
        "canary_runs": {"status": "canary_status"},
        "rollback_events": {"reason": "rollback_reason"},
    }
    floor = {
        "files": {"width": 1, "height": 1}, "regions": {"region_id": 1, "area_pixels": 0},
        "analyses": {"region_count": 0, "total_latency_ms": 0},
        "canary_runs": {"sample_count": 0, "latency_p95_ms": 0},
    }
    schema = tables()[table]
    optional = {f.name for f in schema.fields if f.nullable}
    rules = {f"{f.name}_present": F.col(f.name).isNotNull()
             for f in schema.fields if not f.nullable}
    for column, values in value_sets.get(table, {}).items():
        test = _one_of(column, values)
        rules[f"{column}_allowed"] = _optional(column, test) if column in optional else test
    for column, low in floor.get(table, {}).items():
        rules[f"{column}_at_least_{low}"] = F.col(column) >= low
    for column in unit.get(table, []):
        test = F.col(column).between(0.0, 1.0)
        rules[f"{column}_in_unit"] = _optional(column, test) if column in optional else test
    if table == "datasets":
        rules["test_not_used_for_calibration"] = ~F.col("test_used_for_calibration")
    return rules


def violations(df: DataFrame, table: str) -> DataFrame:
    return contract_violations(df, contract(table))


def conform(df: DataFrame, table: str) -> DataFrame:
    """Cast to the table's schema; unknown or missing columns raise."""
    schema = tables()[table]
    if set(df.columns) != set(schema.names):
        raise ValueError(f"columns differ from {table}: {set(df.columns) ^ set(schema.names)}")
    return df.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])


def read_json_table(spark: SparkSession, table: str, path: str) -> DataFrame:
    """Read JSON rows of a table; malformed rows and unknown columns raise."""
    present = set(spark.read.json(path).columns)
    unknown = present - set(tables()[table].names)
    if unknown:
        raise ValueError(f"unknown columns in {table}: {sorted(unknown)}")
    nullable = T.StructType([T.StructField(f.name, f.dataType) for f in tables()[table].fields])
    return spark.read.schema(nullable).option("mode", "FAILFAST").json(path)
