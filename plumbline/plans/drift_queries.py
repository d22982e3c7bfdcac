"""Drift monitoring queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from plumbline.functions import rules
from plumbline.operators import (
    governance, lifecycle, metrics, reference_model, series, stability, two_sample,
)
from plumbline.plans import bindings as b
from plumbline.plans.registry import Tables, query, rounded
from plumbline.session import scratch_path
from plumbline.sources.versions import VersionedTable


@query(f"""WITH RECURSIVE {b.DAILY_SCAN}
SELECT event_type, window_start, window_end, round(metric_value, 6) AS metric_value,
  round(ewma_value, 6) AS ewma_value, round(cusum_value, 6) AS cusum_value, trend_status,
  drift_pattern, n_points FROM windows""")
def drift_windows(t: Tables):
    out = series.window_rollup(b.daily_points(t), ["event_type"], "metric", "day")
    return rounded(out, "metric_value", "ewma_value", "cusum_value")


@query(f"""WITH {b.DAILY}
SELECT event_type, round(mu, 6) AS baseline_mean, round(sd, 6) AS baseline_std, n AS baseline_n
FROM base""")
def baseline_stats(t: Tables):
    return rounded(b.daily_baseline(b.daily(t)), "baseline_mean", "baseline_std")


@query(f"""WITH RECURSIVE {b.DAILY_SCAN}
SELECT event_type, day, i AS position, round(metric, 6) AS metric, round(e, 6) AS ewma,
  round(lim, 6) AS ewma_lower_limit, round(c, 6) AS cusum_down, e < lim AS ewma_alert,
  c > 4 AS cusum_alert, trend_status FROM points""")
def drift_points(t: Tables):
    out = b.daily_points(t).select(
        "event_type", "day", "position", "metric", "ewma", "ewma_lower_limit", "cusum_down",
        "ewma_alert", "cusum_alert", "trend_status")
    return rounded(out, "metric", "ewma", "ewma_lower_limit", "cusum_down")


@query(f"""WITH base AS (
  SELECT event_type, avg(value) AS mu, stddev_samp(value) AS sd FROM events
  WHERE ts < TIMESTAMP '{b.BASELINE_END}' GROUP BY 1),
n AS (
  SELECT event_id, event_type, value, mu, sd,
    row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i
  FROM events JOIN base USING (event_type)),
s AS (SELECT *, sum((mu - value) / sd - 25e-2) OVER w AS s FROM n
  WINDOW w AS (PARTITION BY event_type ORDER BY i)),
c AS (SELECT event_id, s - least(0e0, min(s) OVER (PARTITION BY event_type ORDER BY i)) AS c FROM s),
e AS (SELECT a.event_id, sum(25e-2 * pow(75e-2, a.i - p.i) * p.value) + pow(75e-2, a.i) * a.mu AS e
  FROM n a JOIN n p ON p.event_type = a.event_type AND p.i <= a.i AND p.i > a.i - 160
  GROUP BY a.event_id, a.i, a.mu)
SELECT n.event_id, n.i AS position, round(e, 6) AS ewma, round(c, 6) AS cusum_down
FROM n JOIN c USING (event_id) JOIN e USING (event_id)""")
def drift_points_raw(t: Tables):
    """Every event value as an observation: long series, cut into day chunks."""
    ev = b.ntz_safe(t.events.select("event_id", "event_type", "ts", "value"), "ts")
    first = ev.where(F.col("ts") < F.to_timestamp(F.lit(b.BASELINE_END)))
    rows = series.with_baseline(ev, series.baseline_stats(first, ["event_type"], "value"),
                                ["event_type"])
    out = series.drift_monitor(rows, ["event_type"], ["ts", "event_id"], "value",
                               series.time_chunk("ts", b.DAY))
    return rounded(out.select("event_id", "position", "ewma", "cusum_down"), "ewma", "cusum_down")


@query(f"""WITH {b.DAILY},
l AS (SELECT *, lag(metric) OVER (PARTITION BY event_type ORDER BY day) AS prior FROM daily)
SELECT event_type, day, round(prior, 6) AS prior_value, round(prior - metric, 6) AS drop_amount,
  CASE WHEN prior - metric >= 10 THEN 'P0_BLOCKED' WHEN prior - metric >= 5 THEN 'P1_INCIDENT'
    WHEN prior - metric >= 2 THEN 'P2_REVIEW' ELSE 'STABLE' END AS drop_class FROM l""")
def lagged_drop(t: Tables):
    out = series.lagged_drop(b.daily(t), ["event_type"], ["day"], "metric",
                             series.time_chunk("day", 10 * b.DAY))
    return rounded(out.drop("metric"), "prior_value", "drop_amount")


_PSI = f"""r AS (SELECT event_type, value FROM events WHERE ts < TIMESTAMP '{b.BASELINE_END}'),
q AS (SELECT event_type, quantile_cont(value, [{", ".join(f"{i / 10}" for i in range(1, 10))}])
  AS edges FROM r GROUP BY 1),
binned AS (
  SELECT event_type, ts < TIMESTAMP '{b.BASELINE_END}' AS ref,
    len(list_filter(edges, lambda e: e <= value)) AS bin FROM events JOIN q USING (event_type)),
cnt AS (SELECT event_type, bin, count(*) FILTER (ref) AS r, count(*) FILTER (NOT ref) AS c
  FROM binned GROUP BY 1, 2),
tot AS (SELECT event_type, sum(r) AS rn, sum(c) AS cn FROM cnt GROUP BY 1),
grid AS (SELECT event_type, rn, cn, bin FROM tot, range(0, 10) AS g(bin)),
parts AS (SELECT event_type, rn, cn, coalesce(r, 0) / rn::DOUBLE + 1e-6 AS pr,
    coalesce(c, 0) / cn::DOUBLE + 1e-6 AS pc
  FROM grid LEFT JOIN cnt USING (event_type, bin)),
psi AS (SELECT event_type, CAST(rn AS BIGINT) AS n_reference, CAST(cn AS BIGINT) AS n_current,
  sum((pc - pr) * ln(pc / pr)) AS psi FROM parts GROUP BY 1, 2, 3)"""


def _psi_frame(t: Tables):
    ev = t.events.select("event_type", "value", (F.col("ts").cast("timestamp") < F.to_timestamp(
        F.lit(b.BASELINE_END))).alias("ref"))
    return metrics.population_stability(ev, ["event_type"], "value", F.col("ref"))


@query(f"""WITH {_PSI}
SELECT event_type, n_reference, n_current, round(psi, 6) AS psi, CASE WHEN psi < 1e-1 THEN 'LOW'
  WHEN psi < 25e-2 THEN 'MEDIUM' ELSE 'HIGH' END AS severity FROM psi""")
def psi(t: Tables):
    out = _psi_frame(t).withColumn("severity", rules.psi_severity(F.col("psi")))
    return rounded(out, "psi")


def _shift_test(t: Tables):
    return two_sample.two_sample_test(b.event_vectors(t), ["event_type"], "event_id", "x", F.col("ref"),
                                      dim=2, features=16, replicates=99)


def _reference(t: Tables):
    return reference_model.fit_reference(b.event_vectors(t).where("ref"), ["event_type"], "x", dim=2,
                                         rank=1, version="2024-01")


def _window_errors(t: Tables):
    return reference_model.window_errors(b.event_vectors(t).where("not ref"), _reference(t),
                                         ["event_type"], "x", dim=2)


@query(f"""WITH {_PSI}
SELECT event_type, n_reference, n_current, round(psi, 6) AS psi FROM psi""")
def psi_incremental(t: Tables):
    """The baseline is summarised and stored once; the window is compared with the stored rows."""
    ev = t.events.select("event_type", "value", (F.col("ts").cast("timestamp") < F.to_timestamp(F.lit(
        b.BASELINE_END))).alias("ref"))
    store = VersionedTable(t.spark, scratch_path(t.spark, "psi-reference"), ["event_type"], buckets=4)
    store.upsert(stability.reference_summary(ev.where("ref"), ["event_type"], "value"))
    return rounded(stability.stability_index(store.read(), ev.where("NOT ref"), ["event_type"], "value"),
                   "psi")


@query(f"""WITH ev AS (SELECT event_type, value, CASE WHEN ts < TIMESTAMP '2024-01-06' THEN 0
    WHEN ts < TIMESTAMP '{b.BASELINE_END}' THEN 1 ELSE 2 END AS part FROM events),
q AS (SELECT event_type, quantile_cont(value, [{", ".join(f"{i / 10}" for i in range(1, 10))}]) AS edges
  FROM ev WHERE part = 0 GROUP BY 1),
c AS (SELECT event_type, len(list_filter(edges, lambda e: e <= value)) AS bin,
    count(*) FILTER (part < 2) AS r, count(*) FILTER (part = 2) AS c
  FROM ev JOIN q USING (event_type) GROUP BY 1, 2),
s AS (SELECT event_type, sum(r) AS rn, sum(c) AS cn FROM c GROUP BY 1),
p AS (SELECT event_type, rn, cn, coalesce(r, 0) / rn::DOUBLE + 1e-6 AS pr, coalesce(c, 0) / cn::DOUBLE + 1e-6 AS pc
  FROM (SELECT * FROM s, range(0, 10) AS g(bin)) LEFT JOIN c USING (event_type, bin))
SELECT event_type, rn::BIGINT AS n_reference, cn::BIGINT AS n_current,
  round(sum((pc - pr) * ln(pc / pr)), 6) AS psi FROM p GROUP BY 1, 2, 3""")
def psi_extended(t: Tables):
    """A stored reference of five days, extended by the rows of five more."""
    ev = t.events.select("event_type", "value", F.col("ts").cast("timestamp").alias("ts"))
    early, end = (F.to_timestamp(F.lit(x)) for x in ("2024-01-06 00:00:00", b.BASELINE_END))
    keys = ["event_type"]
    store = VersionedTable(t.spark, scratch_path(t.spark, "psi-reference"), keys, buckets=4)
    store.upsert(stability.reference_summary(ev.where(F.col("ts") < early), keys, "value"))
    store.upsert(stability.extend_summary(store.read(), ev.where((F.col("ts") >= early) & (
        F.col("ts") < end)), keys, "value"))
    return rounded(stability.stability_index(store.read(), ev.where(F.col("ts") >= end), keys, "value"), "psi")


@query(f"""WITH RECURSIVE {b.DAILY_SCAN}, {_PSI}, {b.VECTORS},
{b.two_sample_sql("test", "ev", "event_type", "event_id", 2, 16, 99)},
{b.reference_sql("model", "event_type")}
SELECT 'win_' || substr(sha256('model_' || event_type || '|value_mean|' || window_start || '|'
    || window_end), 1, 12) AS window_id, 'model_' || event_type AS model_id,
  'value_mean' AS metric_name, window_start, window_end, round(metric_value, 6) AS metric_value,
  round(ewma_value, 6) AS ewma_value, round(cusum_value, 6) AS cusum_value, trend_status,
  drift_pattern, round(psi, 6) AS psi_value, round(mmd, 6) AS bbsd_mmd,
  round(uae_p95_error, 6) AS uae_p95_error, TIMESTAMP '{b.STAMP}' AS created_at
FROM windows LEFT JOIN psi USING (event_type) LEFT JOIN test ON test.key = event_type
LEFT JOIN model ON model.key = event_type""")
def run_window(t: Tables):
    """The window of each series with all its measures: chart, stability, shift and reconstruction."""
    rollup = series.window_rollup(b.daily_points(t), ["event_type"], "metric", "day")
    test, errors = _shift_test(t), _window_errors(t)
    for part in (_psi_frame(t).select("event_type", "psi"), test.select("event_type", "mmd"),
                 errors.select("event_type", "uae_p95_error")):
        rollup = rollup.join(part, "event_type", "left")
    out = governance.drift_window_record(
        rollup, F.concat(F.lit("model_"), "event_type"), F.lit("value_mean"), b.stamp(),
        F.col("psi"), F.col("mmd"), F.col("uae_p95_error"))
    return rounded(out, "metric_value", "ewma_value", "cusum_value", "psi_value", "bbsd_mmd",
                   "uae_p95_error").select(
        "psi_value", "bbsd_mmd", "uae_p95_error", "window_id", "model_id", "metric_name", "window_start", "window_end", "metric_value",
        "ewma_value", "cusum_value", "trend_status", "drift_pattern", "created_at")


@query("""SELECT event_type, round(quantile_cont(value, 5e-1), 6) AS p50,
  round(quantile_cont(value, 95e-2), 6) AS p95, round(quantile_cont(value, 99e-2), 6) AS p99,
  count(*) AS n, round(avg(value), 6) AS mean_ms,
  round(1000 / avg(value), 6) AS throughput_per_second FROM events GROUP BY 1""")
def latency_profile(t: Tables):
    out = metrics.latency_profile(t.events, ["event_type"], "value")
    return rounded(out, "p50", "p95", "p99", "mean_ms", "throughput_per_second")


@query(f"""WITH all_events AS (SELECT * FROM events),
known AS (SELECT * REPLACE (CASE WHEN event_type = 'error' THEN '~' ELSE event_type END
  AS event_type) FROM all_events),
{_PSI.replace("FROM events", "FROM known")}
SELECT nullif(event_type, '~') AS event_type, n_reference, n_current, round(psi, 6) AS psi FROM psi""")
def psi_null_key(t: Tables):
    """Errors have no event type; they are a key like any other."""
    ev = t.events.select(
        F.when(F.col("event_type") != "error", F.col("event_type")).alias("event_type"), "value",
        (F.col("ts").cast("timestamp") < F.to_timestamp(F.lit(b.BASELINE_END))).alias("ref"))
    return rounded(metrics.population_stability(ev, ["event_type"], "value", F.col("ref")), "psi")


@query(f"""WITH RECURSIVE {b.DAILY},
numbered AS (SELECT event_type, day, metric, mu, sd,
    row_number() OVER (PARTITION BY event_type ORDER BY day) AS i
  FROM daily JOIN base USING (event_type) WHERE event_type <> 'error' AND day(day) <> 20),
{b.scan_sql("event_type", "day", "metric", "numbered")}
SELECT event_type, day, trend_status FROM (SELECT event_type, d.day, CASE
    WHEN event_type = 'error' THEN 'NO_BASELINE' WHEN day(d.day) = 20 THEN 'NO_VALUE'
    ELSE p.trend_status END AS trend_status
  FROM daily d LEFT JOIN numbered n USING (event_type, day)
  LEFT JOIN points p USING (event_type, i))""")
def drift_gaps(t: Tables):
    """One series without a baseline, and a day without a value in every series."""
    days = b.daily(t)
    base = b.daily_baseline(days).where("event_type <> 'error'")
    gaps = days.withColumn("metric", F.when(F.dayofmonth("day") != 20, F.col("metric")))
    return series.drift_monitor(series.with_baseline(gaps, base, ["event_type"]), ["event_type"],
                                ["day"], "metric", series.time_chunk("day", 5 * b.DAY)).select(
        "event_type", "day", "trend_status")


@query("""WITH w AS (SELECT user_id % 50 AS grp, CAST(date_trunc('week', ts) AS TIMESTAMP) AS week,
    avg(value) AS m FROM events GROUP BY 1, 2),
l AS (SELECT *, CASE WHEN lag(week) OVER a = week - INTERVAL 7 DAY THEN lag(m) OVER a - m END AS lost
  FROM w WINDOW a AS (PARTITION BY grp ORDER BY week)),
i AS (SELECT *, sum(CASE WHEN coalesce(lost >= 5e-1, false) THEN 0 ELSE 1 END) OVER
  (PARTITION BY grp ORDER BY week) AS island FROM l),
r AS (SELECT *, least(4, sum(CASE WHEN coalesce(lost >= 5e-1, false) THEN 1 ELSE 0 END) OVER
  (PARTITION BY grp, island ORDER BY week))::INT AS run FROM i)
SELECT grp, week, round(m, 6) AS weekly_mean, round(lost, 6) AS weekly_drop, run AS drops_in_row,
  run >= 3 AS declining FROM r""")
def gradual_decline(t: Tables):
    """Weekly means of user groups; few weeks per group, whatever its rows."""
    ev = t.events.select((F.col("user_id") % 50).alias("grp"), F.col("ts").cast(
        "timestamp").alias("ts"), "value")
    weeks = lifecycle.weekly_means(ev, ["grp"], "ts", "value")
    return rounded(lifecycle.gradual_decline(weeks, ["grp"]), "weekly_mean", "weekly_drop")


@query(f"""WITH m AS (SELECT lang AS model, count(*) AS n_target, count(quality) AS n_labelled
  FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1),
q AS (SELECT CASE user_id % 9 WHEN 0 THEN 'en' WHEN 1 THEN 'de' ELSE 'none' END AS model,
  ts AS asked FROM events WHERE event_type = 'error'),
last AS (SELECT model, max(asked) AS asked FROM q WHERE asked <= TIMESTAMP '{b.STAMP}'
  AND asked > TIMESTAMP '{b.STAMP}' - INTERVAL 7 DAY GROUP BY 1),
g AS (SELECT m.*, list_filter([CASE WHEN n_target < 200 THEN 'too_few_target_images' END,
    CASE WHEN n_labelled < 100 THEN 'too_few_labelled_images' END,
    CASE WHEN asked IS NOT NULL THEN 'cooling_down' END], lambda x: x IS NOT NULL) AS reasons
  FROM m LEFT JOIN last USING (model))
SELECT model, n_target, n_labelled, array_to_string(reasons, ',') AS reasons,
  len(reasons) = 0 AS may_retrain FROM g""")
def retraining_gate(t: Tables):
    """One model per language; requests are error events."""
    models = t.documents.join(t.labels, "doc_id", "left").groupBy(F.col("lang").alias("model")).agg(
        F.count(F.lit(1)).alias("n_target"), F.count("quality").alias("n_labelled"))
    number = F.col("user_id") % 9
    requests = t.events.where("event_type = 'error'").select(
        F.when(number == 0, "en").when(number == 1, "de").otherwise("none").alias("model"),
        F.col("ts").cast("timestamp").alias("requested_at"))
    out = lifecycle.retraining_gate(models, requests, "model", b.stamp())
    return out.select("model", "n_target", "n_labelled", F.array_join("reasons", ",").alias(
        "reasons"), "may_retrain")


@query("""WITH c AS (SELECT doc_id, d.source AS cluster, n_chars,
    coalesce(toxic = 1, false) AS critical, coalesce(quality = 0, false) AS disagreement,
    (doc_id * 37 % 101) / 101e0 AS drift, (doc_id * 53 % 97) / 97e0 AS uncertain
  FROM documents d LEFT JOIN labels USING (doc_id)),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster, doc_id % 40 ORDER BY
    critical DESC, disagreement DESC, drift DESC, uncertain DESC, doc_id) AS r FROM c) WHERE r = 1),
s AS (SELECT *, ('0x' || substr(sha256(doc_id::VARCHAR), 1, 8))::BIGINT AS draw,
  CASE WHEN critical THEN 'critical_expert' WHEN disagreement THEN 'disagreement'
    WHEN drift >= 5e-1 THEN 'drift' WHEN uncertain >= 5e-1 THEN 'uncertainty'
    WHEN ('0x' || substr(sha256(doc_id::VARCHAR), 1, 8))::BIGINT % 4 = 0 THEN 'random'
    ELSE 'diversity' END AS stratum FROM one),
p AS (SELECT *, CASE stratum WHEN 'uncertainty' THEN uncertain WHEN 'random'
    THEN draw / 4294967296e0 ELSE drift END AS score FROM s),
n AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY score DESC, doc_id)::INT AS place
  FROM p)
SELECT stratum, place, doc_id, round(score, 6) AS score FROM n WHERE place <= CASE stratum
  WHEN 'disagreement' THEN 20 WHEN 'drift' THEN 20 WHEN 'uncertainty' THEN 15
  WHEN 'diversity' THEN 15 WHEN 'random' THEN 5 ELSE 25 END""")
def quota_selection(t: Tables):
    """A budget of 100; clusters are a source and a remainder of the id."""
    rows = t.documents.join(t.labels, "doc_id", "left").select(
        "doc_id", F.concat_ws("/", "source", (F.col("doc_id") % 40).cast("string")).alias("cluster"),
        F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("critical"),
        F.coalesce(F.col("quality") == 0, F.lit(False)).alias("disagreement"),
        (F.col("doc_id") * 37 % 101 / 101.0).alias("drift_score"),
        (F.col("doc_id") * 53 % 97 / 97.0).alias("uncertainty_score"))
    out = lifecycle.quota_selection(rows, "doc_id", "cluster", 100)
    return rounded(out.drop("cluster"), "score")


_TURN, _PHASE = lifecycle.random_features(64, 8, 0.5, 5)
_WAVES = ", ".join(f"({k}, [{', '.join(repr(float(w)) + '::DOUBLE' for w in _TURN[k])}], "
                   f"{float(_PHASE[k])!r}::DOUBLE)" for k in range(len(_PHASE)))


@query(f"""WITH waves(k, w, b) AS (VALUES {_WAVES}),
z AS (SELECT label, vec_id % 2 = 0 AS ref, k, sqrt(2e0 / 8) * cos(b + list_sum(list_transform(
  list_zip(w, embedding), lambda t: t[1] * t[2]::DOUBLE))) AS z FROM embeddings, waves),
m AS (SELECT label, k, avg(z) FILTER (ref) AS a, avg(z) FILTER (NOT ref) AS c FROM z GROUP BY 1, 2),
n AS (SELECT label, count(*) FILTER (vec_id % 2 = 0) AS n_reference,
  count(*) FILTER (vec_id % 2 <> 0) AS n_current FROM embeddings GROUP BY 1)
SELECT label, n_reference, n_current, round(sum((a - c) * (a - c)), 6) AS mmd
FROM n LEFT JOIN m USING (label) GROUP BY 1, 2, 3""")
def kernel_discrepancy(t: Tables):
    """Even against odd vectors of each label."""
    out = lifecycle.kernel_discrepancy(t.embeddings, ["label"], "embedding", F.col("vec_id") % 2 == 0,
                                       dim=64, features=8, scale=0.5)
    return rounded(out, "mmd")


@query("""SELECT label, round(quantile_cont(sqrt(list_sum(list_transform(embedding[17:],
    lambda x: x::DOUBLE * x::DOUBLE))), 95e-2), 6) AS reconstruction_error, count(*) AS n
  FROM embeddings GROUP BY 1""")
def reconstruction_error(t: Tables):
    """Projection on the first sixteen axes; fitted directions have no SQL form."""
    out = lifecycle.reconstruction_quantile(t.embeddings, ["label"], "embedding", np.zeros(64),
                                            np.eye(64)[:16])
    return rounded(out, "reconstruction_error")


@query(f"""WITH {b.VECTORS}, {b.two_sample_sql("test", "ev", "event_type", "event_id", 2, 16, 99)}
SELECT key AS event_type, n_reference, n_current, round(mmd, 6) AS mmd, round(p_value, 6) AS p_value,
  p_value <= 5e-2 AS significant FROM test""")
def two_sample_events(t: Tables):
    """Events of each type after the baseline against those in it."""
    return rounded(_shift_test(t), "mmd", "p_value")


@query(f"""WITH v AS (SELECT vec_id, label, vec_id % 2 = 0 AS ref, CASE WHEN label < 3 AND vec_id % 2 = 0
  THEN list_transform(embedding, lambda e: e + 4e-2::DOUBLE) ELSE embedding END AS x FROM embeddings),
{b.two_sample_sql("test", "v", "label", "vec_id", 64, 8, 60)}
SELECT key AS label, n_reference, n_current, round(mmd, 6) AS mmd, round(p_value, 6) AS p_value,
  p_value <= 5e-2 AS significant FROM test""")
def two_sample_vectors(t: Tables):
    """Even against odd vectors of each label; the even ones of three labels are moved."""
    moved = (F.col("label") < 3) & (F.col("vec_id") % 2 == 0)
    rows = t.embeddings.select("vec_id", "label", F.when(moved, F.transform(
        "embedding", lambda e: e.cast("double") + 0.04)).otherwise(
        F.col("embedding").cast("array<double>")).alias("x"))
    out = two_sample.two_sample_test(rows, ["label"], "vec_id", "x", F.col("vec_id") % 2 == 0, dim=64,
                                     features=8, replicates=60)
    return rounded(out, "mmd", "p_value")


@query(f"""WITH {b.VECTORS}, {b.reference_sql("model", "event_type")}
SELECT key AS event_type, n, round(captured, 6) AS captured, round(p95, 6) AS p95, round(p99, 6) AS p99,
  round(uae_p95_error, 6) AS uae_p95_error, uae_above_p99 FROM model""")
def reference_errors(t: Tables):
    """Directions fitted on the baseline; what does not depend on their signs."""
    model = _reference(t).select("event_type", "n", "captured", "p95", "p99")
    out = model.join(_window_errors(t).drop("n"), "event_type", "left")
    return rounded(out, "captured", "p95", "p99", "uae_p95_error")
