"""Decision rules as Catalyst expressions; every function takes and returns columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.policy import DEFAULT_GATE, DEFAULT_POLICY, DriftPolicy, GatePolicy

# fixed values: lifecycle edges of a registered model, from -> allowed next states
LIFECYCLE = {
    "CANDIDATE": ["VALIDATED", "REJECTED", "RETIRED"],
    "VALIDATED": ["ACTIVE_BENCHMARK", "RETIRED", "REJECTED"],
    "ACTIVE_BENCHMARK": ["ACTIVE_COMPANY_PILOT", "RETIRED", "REJECTED"],
    "ACTIVE_COMPANY_PILOT": ["RETIRED", "REJECTED"],
    "RETIRED": [],
    "REJECTED": [],
}

# fixed values: the six kinds of evidence an incident can rest on
SIGNALS = [
    "ewma_alert", "cusum_alert", "psi_high",
    "bbsd_significant", "uae_above_p99", "labeled_metric_confirmed",
]

# fixed values: patterns of the release text scan
SECRET_PATTERN = r"""(?i)(api[_-]?key|secret|token)\s*=\s*['"][^'"]{8,}"""
MARKER_PATTERN = r"\b(TODO|FIXME|HACK)\b"


def decide(score: Column, threshold: Column, gate: Column) -> Column:
    """Decision for one item; the input gate overrides the score."""
    return (F.when(gate == "ABSTAIN", "ABSTAIN").when(gate == "REVIEW", "REVIEW")
            .when(score >= threshold, "ANOMALY").otherwise("NORMAL"))


def outcome(label: Column, score: Column, threshold: Column) -> Column:
    """Cell of the 2x2 table an item falls into."""
    hit = score >= threshold
    return (F.when((label == 1) & hit, "true_positive").when(label == 1, "false_negative")
            .when(hit, "false_positive").otherwise("true_negative"))


def score_ratio(score: Column, threshold: Column) -> Column:
    return F.when(threshold > 0, score / threshold).otherwise(F.lit(float("inf")))


def review_priority(decision: Column, score: Column, threshold: Column, area: Column) -> Column:
    """Review effort for an item; here P0 is the least urgent."""
    ratio = score_ratio(score, threshold)
    return (F.when(decision == "ABSTAIN", "ABSTAIN").when(decision == "NORMAL", "P0")
            .when((ratio >= 2.0) | (area >= 0.1), "P3")
            .when((ratio >= 1.25) | (area >= 0.03), "P2").otherwise("P1"))


def quality_gate(width: Column, height: Column, std: Column, blur: Column, mean: Column,
                 gate: GatePolicy = DEFAULT_GATE) -> Column:
    """Struct(status, reasons): hard limits abstain, soft limits ask for review."""
    aspect = width / height
    hard = F.array_compact(F.array(
        F.when((width < gate.min_width) | (height < gate.min_height), "image_too_small"),
        F.when(~aspect.between(gate.min_aspect, gate.max_aspect), "extreme_aspect_ratio"),
        F.when(std < gate.min_std, "near_uniform_image")))
    soft = F.array_compact(F.array(
        F.when(blur < gate.blur_review, "possible_blur"),
        F.when(mean < gate.dark_review, "possible_underexposure"),
        F.when(mean > gate.bright_review, "possible_overexposure")))
    status = (F.when(F.size(hard) > 0, "ABSTAIN").when(F.size(soft) > 0, "REVIEW")
              .otherwise("PASS"))
    return F.struct(status.alias("status"),
                    F.when(F.size(hard) > 0, hard).otherwise(soft).alias("reasons"))


def psi_severity(psi: Column, policy: DriftPolicy = DEFAULT_POLICY) -> Column:
    return (F.when(psi < policy.psi_medium, "LOW").when(psi < policy.psi_high, "MEDIUM")
            .otherwise("HIGH"))


def sudden_drop_class(prior: Column, current: Column,
                      policy: DriftPolicy = DEFAULT_POLICY) -> Column:
    drop = prior - current
    return (F.when(drop >= policy.drop_block, "P0_BLOCKED")
            .when(drop >= policy.drop_incident, "P1_INCIDENT")
            .when(drop >= policy.drop_review, "P2_REVIEW").otherwise("STABLE"))


def trend_status(ewma_alert: Column, cusum_alert: Column) -> Column:
    return (F.when(ewma_alert & cusum_alert, "BOTH_ALERT").when(ewma_alert, "EWMA_ALERT")
            .when(cusum_alert, "CUSUM_ALERT").otherwise("STABLE"))


def drift_pattern(status: Column, n_points: Column) -> Column:
    return (F.when(status == "STABLE", "STABLE")
            .when((status == "BOTH_ALERT") & (n_points <= 3), "SUDDEN")
            .when(status.isin("CUSUM_ALERT", "BOTH_ALERT"), "GRADUAL").otherwise("TECHNICAL"))


def signal_count(*signals: Column) -> Column:
    total = F.lit(0)
    for s in signals:
        total = total + F.coalesce(s, F.lit(False)).cast("int")
    return total


def incident_priority(count: Column) -> Column:
    return (F.when(count >= 5, "P0_BLOCKED").when(count >= 3, "P1_INCIDENT")
            .when(count >= 2, "P2_REVIEW").otherwise("INFO"))


def urgency_bucket(drift_score: Column) -> Column:
    """Labelling urgency; here P0 is the most urgent."""
    return (F.when(drift_score >= 0.90, "P0").when(drift_score >= 0.75, "P1")
            .when(drift_score >= 0.50, "P2").otherwise("P3"))


def spreadsheet_safe(text: Column) -> Column:
    """Quote values a spreadsheet would read as a formula."""
    return F.when(text.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), text)).otherwise(text)


def file_name(path: Column) -> Column:
    """Last part of a path; slashes at its end do not count."""
    return F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1)


def file_stem(path: Column) -> Column:
    """File name without its last suffix; a leading dot starts no suffix."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]+$", "")


def normalized_name(path: Column) -> Column:
    return F.translate(F.lower(file_stem(path)), "-_", "")


def path_key(path: Column) -> Column:
    return F.sha2(path, 256)


def canary_status(disagreement: Column, recall_delta: Column,
                  policy: DriftPolicy = DEFAULT_POLICY) -> Column:
    ok = ((disagreement <= policy.canary_max_disagreement)
          & (recall_delta >= policy.canary_min_recall_delta))
    return F.when(ok, "PASSED").otherwise("FAILED")


def transition_allowed(current: Column, target: Column) -> Column:
    """Whether the lifecycle has an edge; unknown states have none."""
    edges = [F.lit(f"{a}>{b}") for a, targets in LIFECYCLE.items() for b in targets]
    return F.coalesce(F.concat(current, F.lit(">"), target).isin(*edges), F.lit(False))


def contains_ci(text: Column, needle: str) -> Column:
    return F.lower(text).contains(needle.lower())


def secret_flag(text: Column) -> Column:
    return text.rlike(SECRET_PATTERN)


def marker_flag(text: Column) -> Column:
    return text.rlike(MARKER_PATTERN)


def is_finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))
