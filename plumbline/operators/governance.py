"""Audit tables: append-only rows, a latest view, and the services that write them.

Parquet has no UPDATE. A change is a further row with the same key and a later ``event_at``; the
current state is the latest row per key. Timestamps are arguments, so a rerun writes equal rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import rules
from plumbline.operators.metrics import best_row
from plumbline.operators.series import previous_value
from plumbline.policy import DEFAULT_POLICY, DriftPolicy


def derived_id(prefix: str, *parts: Column) -> Column:
    key = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(key, 256), 1, 12))


def latest_state(log: DataFrame, keys: Sequence[str], *order: str) -> DataFrame:
    """Last row per key. Partial aggregation keeps one row per key and map task."""
    return best_row(log, keys, F.struct(*order)).select(*log.columns)


def upsert(current: DataFrame, incoming: DataFrame, keys: Sequence[str], *order: str) -> DataFrame:
    """Insert or replace by key; among several incoming rows the last by ``order`` stays."""
    both = current.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    return best_row(both, keys, F.struct("_new", *order)).select(*current.columns)


def insert_ignore(current: DataFrame, incoming: DataFrame, keys: Sequence[str],
                  *order: str) -> DataFrame:
    """Rows to append: incoming keys not present yet, the first by ``order`` for each key."""
    rest = [c for c in incoming.columns if c not in keys]
    first = incoming.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")
    return first.join(current.select(*keys), list(keys), "left_anti").select(*incoming.columns)


def triage_decisions(evidence: DataFrame, window: str, created_at: Column) -> DataFrame:
    """Evidence map and number of confirming signals per window; nothing is stored."""
    pairs = [x for s in rules.SIGNALS for x in (F.lit(s), F.coalesce(F.col(s), F.lit(False)))]
    return evidence.select(
        derived_id("dec", F.col(window), created_at).alias("decision_id"), window,
        rules.signal_count(*[F.col(s) for s in rules.SIGNALS]).alias("confirming_signal_count"),
        F.create_map(*pairs).alias("evidence"), created_at.alias("created_at"))


def open_incidents(windows: DataFrame, evidence: DataFrame, created_at: Column,
                   root_cause: Column | None = None,
                   policy: DriftPolicy = DEFAULT_POLICY) -> DataFrame:
    """Incident rows for the windows with enough confirming signals."""
    count = rules.signal_count(*[F.col(s) for s in rules.SIGNALS])
    enough = evidence.select("window_id", count.alias("_n")).where(
        F.col("_n") >= policy.min_signals)
    cause = F.lit(None).cast("string") if root_cause is None else root_cause
    return windows.join(enough, "window_id").select(
        derived_id("inc", F.col("window_id"), created_at).alias("incident_id"),
        rules.incident_priority(F.col("_n")).alias("priority"), "drift_pattern",
        cause.alias("root_cause"), F.col("window_id").alias("affected_window_id"), "model_id",
        "threshold_id", F.lit(None).cast("string").alias("action_taken"),
        F.lit(None).cast("timestamp").alias("resolved_at"), created_at.alias("created_at"))


def resolve_incidents(incidents: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Closing rows to append. ``resolutions``: incident_id, action_taken, resolved_at."""
    return incidents.drop("action_taken", "resolved_at").join(
        resolutions, "incident_id").select(*incidents.columns)


def record_verdicts(queue: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Reviewed rows to append. ``verdicts``: item_id, verdict, assigned_reviewer, reviewed_at."""
    return queue.drop("verdict", "assigned_reviewer", "reviewed_at").join(
        verdicts, "item_id").select(*queue.columns)


def submit_feedback(feedback: DataFrame, analyses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Feedback rows to append, and the rejected ones that name no analysis."""
    known = analyses.select("analysis_id")
    return (feedback.join(known, "analysis_id", "left_semi"),
            feedback.join(known, "analysis_id", "left_anti"))


def register_models(models: DataFrame, incoming: DataFrame) -> DataFrame:
    """New models as CANDIDATE rows; known ids are left alone."""
    return insert_ignore(models, incoming.withColumn("status", F.lit("CANDIDATE")),
                         ["model_id"], "created_at")


def promote(latest: DataFrame, requests: DataFrame) -> DataFrame:
    """Answer transition requests (model_id, to_status, event_at) along the lifecycle.

    ``result`` is ACCEPTED, NOT_ALLOWED or UNKNOWN_MODEL; accepted rows are the new events.
    """
    joined = requests.join(
        latest.select("model_id", F.col("status").alias("from_status")), "model_id", "left")
    result = (F.when(F.col("from_status").isNull(), "UNKNOWN_MODEL")
              .when(rules.transition_allowed(F.col("from_status"), F.col("to_status")), "ACCEPTED")
              .otherwise("NOT_ALLOWED"))
    return joined.withColumn("result", result)


def demote(latest: DataFrame, requests: DataFrame) -> DataFrame:
    return promote(latest, requests.withColumn("to_status", F.lit("RETIRED")))


def promotable(latest: DataFrame) -> DataFrame:
    """Models that may become active: right status, with a threshold and metrics."""
    return latest.where(F.col("status").isin("CANDIDATE", "VALIDATED")
                        & F.col("threshold_id").isNotNull() & F.col("metrics_path").isNotNull())


def promote_and_retire(latest: DataFrame, requests: DataFrame, stage: str = "ACTIVE_BENCHMARK"
                       ) -> DataFrame:
    """Events that make each requested model active and retire the one before it.

    ``requests``: registry_id, model_id, event_at, with one model per registry. Requests for
    models that are not promotable give no events.
    """
    good = requests.join(promotable(latest).select("registry_id", "model_id"),
                         ["registry_id", "model_id"], "left_semi")
    up = good.select("registry_id", "model_id", F.lit(stage).alias("status"), "event_at")
    down = (latest.where(F.col("status") == stage).select("registry_id", "model_id")
            .join(good.select("registry_id", "event_at"), "registry_id")
            .select("registry_id", "model_id", F.lit("RETIRED").alias("status"), "event_at"))
    return up.unionByName(down)


def rollback(latest: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Status events, audit rows and rejected requests.

    ``requests``: from_model_id, to_model_id, reason, triggered_by, incident_id, event_at. The
    target becomes active from any state and the source is retired. Unknown ids are rejected.
    """
    ids = latest.select("model_id")
    known = (requests.join(ids.withColumnRenamed("model_id", "from_model_id"), "from_model_id",
                           "left_semi")
             .join(ids.withColumnRenamed("model_id", "to_model_id"), "to_model_id", "left_semi"))
    events = known.select(F.explode(F.array(
        F.struct(F.col("to_model_id").alias("model_id"), F.lit("ACTIVE_BENCHMARK").alias("status"),
                 F.col("event_at")),
        F.struct(F.col("from_model_id").alias("model_id"), F.lit("RETIRED").alias("status"),
                 F.col("event_at")))).alias("_e")).select("_e.*")
    audit = known.select(
        derived_id("rb", F.col("from_model_id"), F.col("to_model_id"), F.col("event_at")
                   ).alias("rollback_id"),
        "from_model_id", "to_model_id", "reason", "triggered_by", "incident_id",
        F.col("event_at").alias("created_at"))
    keys = ["from_model_id", "to_model_id", "event_at"]
    return events, audit, requests.join(known.select(*keys), keys, "left_anti")


def invalid_transitions(log: DataFrame, keys: Sequence[str], order: Sequence[str],
                        chunk: Column) -> DataFrame:
    """Rows of a status log that the lifecycle does not allow after the row before."""
    steps = previous_value(log, keys, order, "status", "previous_status", chunk)
    return steps.where(F.col("previous_status").isNotNull() & ~rules.transition_allowed(
        F.col("previous_status"), F.col("status")))


def integrity_check(registry: DataFrame, files: DataFrame) -> DataFrame:
    """Recorded against actual hashes. Inputs: artifact_path, artifact_sha256 / path, sha256."""
    actual = files.select(F.col("path").alias("artifact_path"), F.col("sha256").alias("actual"))
    out = registry.join(actual, "artifact_path", "left")
    return out.withColumn("integrity", F.when(F.col("actual").isNull(), "MISSING").when(
        F.col("actual") == F.col("artifact_sha256"), "OK").otherwise("MISMATCH"))


def registry_health(latest: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Models and the newest active id of each stage."""
    def active(stage: str) -> Column:
        when = F.when(F.col("status") == stage, F.struct("created_at", "model_id"))
        return F.max(when)["model_id"]

    return latest.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("models"),
        active("ACTIVE_BENCHMARK").alias("active_benchmark"),
        active("ACTIVE_COMPANY_PILOT").alias("active_company_pilot"))


def multiple_active(latest: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Registries with more than one active model in a stage."""
    return latest.where(F.col("status").isin("ACTIVE_BENCHMARK", "ACTIVE_COMPANY_PILOT")).groupBy(
        *keys, "status").agg(F.count(F.lit(1)).alias("n_active")).where("n_active > 1")


def require_unique_active(latest: DataFrame, keys: Sequence[str]) -> None:
    if multiple_active(latest, keys).limit(1).count():
        raise ValueError("a stage has more than one active model")


def active_threshold(latest: DataFrame, thresholds: DataFrame,
                     stage: str = "ACTIVE_BENCHMARK") -> DataFrame:
    """Active models with their threshold values; NULL values where the threshold is missing."""
    return latest.where(F.col("status") == stage).join(
        thresholds.drop("model_id", "status", "created_at"), "threshold_id", "left")


def recent(df: DataFrame, n: int, *order: Column, where: Column | None = None,
           then: Column | None = None) -> DataFrame:
    """Newest rows: ``where`` filters before the limit, ``then`` after it."""
    out = df if where is None else df.where(where)
    out = out.orderBy(*order).limit(n)
    return out if then is None else out.where(then)


def open_only(incidents: DataFrame) -> DataFrame:
    """Unresolved incidents, newest first."""
    return incidents.where(F.col("resolved_at").isNull()).orderBy(F.col("created_at").desc(),
                                                                  "incident_id")


def pending_queue(queue: DataFrame, n: int | None = None) -> DataFrame:
    """Items without a verdict, most urgent bucket first, oldest first within it."""
    out = queue.where(F.col("verdict").isNull()).orderBy("priority_bucket", "created_at", "item_id")
    return out if n is None else out.limit(n)


def drift_window_record(rollup: DataFrame, model: Column, metric: Column, created_at: Column,
                        psi: Column | None = None, mmd: Column | None = None,
                        error: Column | None = None) -> DataFrame:
    """Rows for the drift_windows table out of a window rollup; what is not measured is NULL."""
    none = F.lit(None)
    psi, mmd, error = (none if c is None else c for c in (psi, mmd, error))
    return rollup.select(
        derived_id("win", model, metric, F.col("window_start"), F.col("window_end")
                   ).alias("window_id"),
        model.alias("model_id"), none.cast("string").alias("threshold_id"),
        metric.alias("metric_name"), "window_start", "window_end", "metric_value", "ewma_value",
        "cusum_value", psi.cast("double").alias("psi_value"),
        mmd.cast("double").alias("bbsd_mmd"), error.cast("double").alias("uae_p95_error"),
        "trend_status", "drift_pattern", none.cast("string").alias("source_manifest_sha256"),
        created_at.alias("created_at"))


def run_record(counts: DataFrame, dataset: str, model: Column, threshold: Column,
               manifest_sha: Column, environment: dict[str, str], created_at: Column) -> DataFrame:
    """One row per training run: what it used and how many files each split had."""
    env = F.create_map(*[F.lit(x) for kv in environment.items() for x in kv])
    return counts.select(
        derived_id("run", F.col(dataset), model, threshold, manifest_sha).alias("run_id"),
        dataset, model.alias("model_id"), threshold.alias("threshold_id"),
        manifest_sha.alias("dataset_manifest_sha256"), "images_total", "train_normal",
        "validation_normal", "test_normal", "test_anomaly", env.alias("environment"),
        created_at.alias("created_at"))
