"""Champion against challenger, and baseline against perturbed scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import rules
from plumbline.operators.ordered import exact_quantiles
from plumbline.policy import DEFAULT_POLICY, DriftPolicy


def paired_predictions(champion: DataFrame, challenger: DataFrame, item: str) -> DataFrame:
    """Both decisions per item. Inputs: item, keys, label, decision (0/1), latency_ms."""
    left = champion.withColumnsRenamed({"decision": "champion_decision",
                                        "latency_ms": "champion_latency_ms"})
    right = challenger.select(item, F.col("decision").alias("challenger_decision"),
                              F.col("latency_ms").alias("challenger_latency_ms"))
    return left.join(right, item)


def canary_metrics(pairs: DataFrame, keys: list[str], label: str = "label") -> DataFrame:
    """Sample count, disagreement rate, recall difference and challenger p95 latency."""
    champion, challenger = F.col("champion_decision"), F.col("challenger_decision")
    anomaly = F.col(label) == 1
    counts = pairs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("sample_count"),
        F.avg((champion != challenger).cast("double")).alias("disagreement_rate"),
        (F.coalesce(F.avg(F.when(anomaly, challenger.cast("double"))), F.lit(0.0))
         - F.coalesce(F.avg(F.when(anomaly, champion.cast("double"))), F.lit(0.0))
         ).alias("critical_recall_delta"))
    p95 = exact_quantiles(pairs, keys, "challenger_latency_ms", [0.95]).select(
        *keys, F.col("quantile").alias("latency_p95_ms"))
    return counts.join(p95, keys)


def canary_record(metrics: DataFrame, champion: Column, challenger: Column, created_at: Column,
                  policy: DriftPolicy = DEFAULT_POLICY) -> DataFrame:
    """Canary rows with their verdict; the id is derived from the content."""
    key = F.concat_ws("|", champion, challenger, created_at.cast("string"))
    return metrics.select(
        F.concat(F.lit("can_"), F.substring(F.sha2(key, 256), 1, 12)).alias("canary_id"),
        champion.alias("champion_model_id"), challenger.alias("challenger_model_id"),
        "sample_count", "disagreement_rate", "critical_recall_delta", "latency_p95_ms",
        rules.canary_status(F.col("disagreement_rate"), F.col("critical_recall_delta"), policy
                            ).alias("status"),
        created_at.alias("created_at"))


def require_canary_input(metrics: DataFrame) -> None:
    bad = metrics.where((F.col("sample_count") < 1)
                        | ~F.col("disagreement_rate").between(0.0, 1.0)).limit(1).count()
    if bad:
        raise ValueError("a canary needs at least one sample and a rate in [0, 1]")


def paired_perturbation(baseline: DataFrame, perturbed: DataFrame, item: str) -> DataFrame:
    """Baseline and perturbed score per item and case. Inputs: item, score / item, kind, value, score."""
    return perturbed.join(baseline.select(item, F.col("score").alias("baseline_score")), item)


def robustness_delta(pairs: DataFrame, threshold: Column) -> DataFrame:
    """Score shift and decision flips per perturbation case."""
    delta = F.abs(F.col("score") - F.col("baseline_score"))
    flip = (F.col("score") >= threshold) != (F.col("baseline_score") >= threshold)
    return pairs.groupBy("kind", "value").agg(
        F.avg("score").alias("mean_score"), F.avg(delta).alias("mean_absolute_delta"),
        F.max(delta).alias("max_absolute_delta"), F.count_if(flip).alias("decision_flips"))
