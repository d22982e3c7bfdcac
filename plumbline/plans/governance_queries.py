"""Incident, queue, registry and canary queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import rules
from plumbline.operators import compare, governance
from plumbline.plans import bindings as b
from plumbline.plans.registry import Tables, query, rounded
from plumbline.policy import DriftPolicy
from plumbline.session import scratch_path
from plumbline.sources.versions import VersionedTable


@query("""SELECT event_id, user_id, event_type, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r
  FROM events) WHERE r = 1""")
def latest_state(t: Tables):
    log = t.events.select("event_id", "user_id", "event_type", "value", "ts")
    return governance.latest_state(log, ["user_id"], "ts", "event_id").drop("ts")


@query("""SELECT event_id, user_id, event_type, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id
    ORDER BY event_type = 'purchase' DESC, ts DESC, event_id DESC) AS r
  FROM events) WHERE r = 1""")
def upsert(t: Tables):
    """Purchases replace all other events of the same user."""
    cols = ["event_id", "user_id", "event_type", "value", "ts"]
    ev = t.events.select(*cols)
    current = governance.latest_state(ev.where("NOT event_type <=> 'purchase'"), ["user_id"],
                                      "ts", "event_id")
    return governance.upsert(current, ev.where("event_type = 'purchase'"), ["user_id"], "ts",
                             "event_id").drop("ts")


@query("""SELECT event_id, user_id, event_type, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id
    ORDER BY event_type = 'purchase' DESC, event_type = 'error' DESC, ts DESC, event_id DESC) AS r
  FROM events) WHERE r = 1""")
def upsert_table(t: Tables):
    """A stored table of the last event per user; errors and then purchases replace its rows."""
    table = VersionedTable(t.spark, scratch_path(t.spark, "last-events"), ["user_id"], buckets=16)
    ev = t.events.select("event_id", "user_id", "event_type", "value", "ts")
    table.upsert(ev, "ts", "event_id")
    for kind in ("error", "purchase"):
        table.upsert(ev.where(F.col("event_type") == kind), "ts", "event_id")
    return table.read().drop("ts")


@query("""WITH new AS (SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders
  WHERE NOT (o_orderstatus = 'F' AND o_orderpriority = '1-URGENT') GROUP BY 1)
SELECT * FROM new WHERE o_custkey NOT IN (SELECT o_custkey FROM orders
  WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT')""")
def insert_ignore(t: Tables):
    orders = t.orders.select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderpriority")
    current = orders.where("o_orderstatus = 'F' and o_orderpriority = '1-URGENT'").select(
        "o_custkey", "o_orderkey")
    incoming = orders.where("NOT (o_orderstatus = 'F' and o_orderpriority = '1-URGENT')").select(
        "o_custkey", "o_orderkey")
    return governance.insert_ignore(current, incoming, ["o_custkey"], "o_orderkey")


@query(f"""WITH RECURSIVE {b.USER_EVIDENCE}
SELECT 'dec_' || substr(sha256(window_id || '|{b.STAMP}'), 1, 12) AS decision_id, window_id,
  signals AS confirming_signal_count, 'ewma_alert=' || ewma_alert || ';cusum_alert=' || cusum_alert
  || ';psi_high=' || psi_high || ';bbsd_significant=' || bbsd_significant || ';uae_above_p99='
  || uae_above_p99 || ';labeled_metric_confirmed=' || labeled_metric_confirmed AS evidence
FROM evidence""")
def triage_decision(t: Tables):
    out = governance.triage_decisions(b.user_evidence(t), "window_id", b.stamp())
    text = F.concat_ws(";", *[F.concat(F.lit(f"{s}="), F.col("evidence")[s].cast("string"))
                              for s in rules.SIGNALS])
    return out.select("decision_id", "window_id", "confirming_signal_count",
                      text.alias("evidence"))


@query(f"WITH RECURSIVE {b.INCIDENTS} SELECT * FROM incidents")
def open_incident(t: Tables):
    return b.incident_rows(t).select("incident_id", "priority", "drift_pattern",
                                     "affected_window_id", "model_id")


_RESOLVED = f"""resolved AS (SELECT i.*, CASE WHEN priority <> 'P2_REVIEW' THEN 'retrained' END
    AS action_taken, CASE WHEN priority <> 'P2_REVIEW' THEN TIMESTAMP '{b.STAMP}' END AS resolved_at
  FROM incidents i)"""


def _resolved(t: Tables):
    """Incidents of the two higher priorities are closed; the log keeps both rows."""
    rows = b.incident_rows(t)
    closing = rows.where("priority <> 'P2_REVIEW'").select(
        "incident_id", F.lit("retrained").alias("action_taken"), b.stamp().alias("resolved_at"))
    log = rows.withColumn("event_at", F.lit(1)).unionByName(
        governance.resolve_incidents(rows, closing).withColumn("event_at", F.lit(2)))
    return governance.latest_state(log, ["incident_id"], "event_at").drop("event_at")


@query(f"""WITH RECURSIVE {b.INCIDENTS}, {_RESOLVED}
SELECT incident_id, priority, model_id, action_taken, resolved_at FROM resolved""")
def resolve_incident(t: Tables):
    return _resolved(t).select("incident_id", "priority", "model_id", "action_taken",
                               "resolved_at")


@query(f"""WITH RECURSIVE {b.INCIDENTS}, {_RESOLVED}
SELECT incident_id, priority, model_id FROM resolved WHERE resolved_at IS NULL""")
def open_incidents(t: Tables):
    return governance.open_only(_resolved(t)).select("incident_id", "priority", "model_id")


@query("""SELECT event_id, user_id, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 50""")
def recent(t: Tables):
    rows = t.events.select("event_id", "user_id", "value", "ts")
    return governance.recent(rows, 50, F.col("ts").desc(), F.col("event_id").desc()).drop("ts")


@query("""SELECT event_id, user_id, value FROM events WHERE event_type = 'error'
ORDER BY ts DESC, event_id DESC LIMIT 50""")
def recent_for_model(t: Tables):
    """Filter, then limit."""
    rows = t.events.select("event_id", "user_id", "value", "ts", "event_type")
    return governance.recent(rows, 50, F.col("ts").desc(), F.col("event_id").desc(),
                             where=F.col("event_type") == "error").select(
        "event_id", "user_id", "value")


@query("""SELECT event_id, user_id, value FROM (SELECT * FROM events
  ORDER BY ts DESC, event_id DESC LIMIT 50) WHERE contains(lower(event_type), 'err')""")
def recent_page(t: Tables):
    """Limit, then filter, as a dashboard page does."""
    rows = t.events.select("event_id", "user_id", "value", "ts", "event_type")
    return governance.recent(rows, 50, F.col("ts").desc(), F.col("event_id").desc(),
                             then=rules.contains_ci(F.col("event_type"), "ERR")).select(
        "event_id", "user_id", "value")


_QUEUE = """queue AS (
  SELECT 'lq' || o_orderkey AS item_id, 'P' || least(3, CAST(substr(o_orderpriority, 1, 1) AS INT) - 1)
    AS priority_bucket, CASE WHEN o_orderstatus = 'F' THEN 'UNSURE' END AS verdict,
    o_orderdate AS created_at, o_orderpriority FROM orders)"""


def _queue(t: Tables):
    bucket = F.least(F.lit(3), F.substring("o_orderpriority", 1, 1).cast("int") - 1)
    return t.orders.select(
        F.concat(F.lit("lq"), F.col("o_orderkey").cast("string")).alias("item_id"),
        F.concat(F.lit("P"), bucket.cast("string")).alias("priority_bucket"),
        F.when(F.col("o_orderstatus") == "F", "UNSURE").alias("verdict"),
        F.lit(None).cast("string").alias("assigned_reviewer"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
        F.lit(None).cast("timestamp").alias("reviewed_at"), "o_orderpriority")


@query(f"""WITH {_QUEUE} SELECT item_id, priority_bucket, created_at FROM queue
WHERE verdict IS NULL ORDER BY priority_bucket, created_at, item_id LIMIT 100""")
def pending_queue(t: Tables):
    return governance.pending_queue(_queue(t), 100).select("item_id", "priority_bucket",
                                                           "created_at")


@query(f"""WITH {_QUEUE} SELECT item_id, priority_bucket,
  CASE WHEN verdict IS NULL AND o_orderpriority = '2-HIGH' THEN 'CONFIRMED_ANOMALY' ELSE verdict
  END AS verdict, CASE WHEN verdict IS NULL AND o_orderpriority = '2-HIGH' THEN 'expert' END
  AS assigned_reviewer FROM queue""")
def record_verdict(t: Tables):
    queue = _queue(t)
    verdicts = queue.where("verdict is null and o_orderpriority = '2-HIGH'").select(
        "item_id", F.lit("CONFIRMED_ANOMALY").alias("verdict"),
        F.lit("expert").alias("assigned_reviewer"), b.stamp().alias("reviewed_at"))
    log = queue.withColumn("event_at", F.lit(1)).unionByName(
        governance.record_verdicts(queue, verdicts).withColumn("event_at", F.lit(2)))
    return governance.latest_state(log, ["item_id"], "event_at").select(
        "item_id", "priority_bucket", "verdict", "assigned_reviewer")


@query("""SELECT event_id AS feedback_id, user_id AS analysis_id,
  user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value >= 100) AS accepted
FROM events""")
def submit_feedback(t: Tables):
    """Events as feedback on the users with a large purchase."""
    feedback = t.events.select(
        F.col("event_id").alias("feedback_id"), F.col("user_id").alias("analysis_id"))
    analyses = t.events.where("event_type = 'purchase' and value >= 100").select(
        F.col("user_id").alias("analysis_id"))
    good, bad = governance.submit_feedback(feedback, analyses)
    return good.withColumn("accepted", F.lit(True)).unionByName(
        bad.withColumn("accepted", F.lit(False))).select("feedback_id", "analysis_id", "accepted")


_ROLL = """req AS (SELECT DISTINCT 'm' || l_orderkey AS from_model_id, 'm' || l_partkey AS to_model_id
  FROM lineitem WHERE l_orderkey <> l_partkey),
latest AS (SELECT model_id FROM models WHERE o_totalprice >= 100000),
known AS (SELECT * FROM req WHERE from_model_id IN (SELECT model_id FROM latest)
  AND to_model_id IN (SELECT model_id FROM latest))"""


def _rollback(t: Tables):
    latest = b.models(t).where("o_totalprice >= 100000")
    key = {"from_model_id": "l_orderkey", "to_model_id": "l_partkey"}
    req = t.lineitem.where("l_orderkey <> l_partkey").select(
        *[F.concat(F.lit("m"), F.col(c).cast("string")).alias(n) for n, c in key.items()]
    ).distinct().select("*", F.lit("RECALL_DROP").alias("reason"),
                        F.lit("monitor").alias("triggered_by"),
                        F.lit(None).cast("string").alias("incident_id"),
                        b.stamp().alias("event_at"))
    return governance.rollback(latest, req)


@query(f"""WITH {b.MODELS}
SELECT model_id, created_at FROM models WHERE status = 'VALIDATED' ORDER BY created_at DESC""")
def list_models(t: Tables):
    return b.models(t).where("status = 'VALIDATED'").orderBy(F.col("created_at").desc()).select(
        "model_id", "created_at")


@query(f"""WITH {b.MODELS}, {_ROLL}
SELECT from_model_id, to_model_id, TIMESTAMP '{b.STAMP}' AS created_at FROM known""")
def list_rollbacks(t: Tables):
    return _rollback(t)[1].orderBy(F.col("created_at").desc(), "rollback_id").select(
        "from_model_id", "to_model_id", "created_at")


@query(f"""WITH {b.MODELS}
SELECT registry_id, count(*) AS models,
  arg_max(model_id, (created_at, model_id)) FILTER (status = 'ACTIVE_BENCHMARK')
    AS active_benchmark,
  arg_max(model_id, (created_at, model_id)) FILTER (status = 'ACTIVE_COMPANY_PILOT')
    AS active_company_pilot FROM models GROUP BY 1""")
def registry_health(t: Tables):
    return governance.registry_health(b.models(t), ["registry_id"])


@query(f"""WITH {b.MODELS}
SELECT registry_id, status, count(*) AS n_active FROM models
WHERE status IN ('ACTIVE_BENCHMARK', 'ACTIVE_COMPANY_PILOT') GROUP BY 1, 2 HAVING count(*) > 1""")
def multiple_active(t: Tables):
    return governance.multiple_active(b.models(t), ["registry_id"])


@query(f"""WITH {b.MODELS}
SELECT model_id FROM models WHERE status IN ('CANDIDATE', 'VALIDATED')
  AND threshold_id IS NOT NULL AND metrics_path IS NOT NULL""")
def promotable(t: Tables):
    return governance.promotable(b.models(t)).select("model_id")


@query(f"""WITH {b.MODELS}, th AS (SELECT 't' || l_orderkey AS threshold_id,
  max(l_extendedprice) AS image_threshold FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT model_id, threshold_id, image_threshold, image_threshold IS NULL AS missing
FROM models LEFT JOIN th USING (threshold_id) WHERE status = 'ACTIVE_BENCHMARK'""")
def active_threshold(t: Tables):
    key = F.concat(F.lit("t"), F.col("l_orderkey").cast("string"))
    thresholds = t.lineitem.where("l_returnflag = 'R'").groupBy(key.alias("threshold_id")).agg(
        F.max("l_extendedprice").alias("image_threshold"))
    return governance.active_threshold(b.models(t), thresholds).select(
        "model_id", "threshold_id", "image_threshold",
        F.col("image_threshold").isNull().alias("missing"))


@query(f"""WITH {b.MODELS}
SELECT model_id, 'CANDIDATE' AS status FROM models
WHERE o_totalprice >= 300000 AND model_id NOT IN (SELECT model_id FROM models WHERE status = 'RETIRED')
""")
def register_models(t: Tables):
    rows = b.models(t).select("model_id", "status", "created_at", "o_totalprice")
    known = rows.where("status = 'RETIRED'")
    out = governance.register_models(known, rows.where("o_totalprice >= 300000"))
    return out.select("model_id", "status")


_REQUESTS = f"""requests AS (
  SELECT 'm' || l_orderkey AS model_id, CASE l_returnflag WHEN 'A' THEN 'VALIDATED'
    WHEN 'N' THEN 'ACTIVE_BENCHMARK' ELSE 'RETIRED' END AS to_status, count(*) AS n
  FROM lineitem GROUP BY 1, 2),
edges(a, z) AS (VALUES {", ".join(f"('{a}', '{x}')" for a, ts in rules.LIFECYCLE.items() for x in ts)}),
latest AS (SELECT model_id, status FROM models WHERE o_totalprice >= 100000)"""


def _requests(t: Tables):
    to = F.when(F.col("l_returnflag") == "A", "VALIDATED").when(
        F.col("l_returnflag") == "N", "ACTIVE_BENCHMARK").otherwise("RETIRED")
    return t.lineitem.select(
        F.concat(F.lit("m"), F.col("l_orderkey").cast("string")).alias("model_id"),
        to.alias("to_status")).distinct().withColumn("event_at", b.stamp())


@query(f"""WITH {b.MODELS}, {_REQUESTS}
SELECT r.model_id, to_status, status AS from_status, CASE WHEN status IS NULL THEN 'UNKNOWN_MODEL'
  WHEN z IS NOT NULL THEN 'ACCEPTED' ELSE 'NOT_ALLOWED' END AS result
FROM requests r LEFT JOIN latest USING (model_id) LEFT JOIN edges ON a = status AND z = to_status""")
def promote(t: Tables):
    latest = b.models(t).where("o_totalprice >= 100000")
    return governance.promote(latest, _requests(t)).drop("event_at")


@query(f"""WITH {b.MODELS}, latest AS (SELECT * FROM models WHERE o_totalprice >= 100000),
requests AS (SELECT DISTINCT 'm' || l_orderkey AS model_id FROM lineitem)
SELECT model_id, status AS from_status, CASE WHEN status IS NULL THEN 'UNKNOWN_MODEL'
  WHEN status IN ('RETIRED', 'REJECTED') THEN 'NOT_ALLOWED' ELSE 'ACCEPTED' END AS result
FROM requests LEFT JOIN latest USING (model_id)""")
def demote(t: Tables):
    latest = b.models(t).where("o_totalprice >= 100000")
    requests = _requests(t).select("model_id", "event_at").distinct()
    return governance.demote(latest, requests).drop("event_at", "to_status")


@query(f"""WITH {b.MODELS}, req AS (SELECT registry_id, arg_max(model_id, o_orderkey) AS model_id
  FROM models WHERE status IN ('CANDIDATE', 'VALIDATED', 'REJECTED') GROUP BY 1),
good AS (SELECT req.* FROM req JOIN models m USING (registry_id, model_id)
  WHERE status IN ('CANDIDATE', 'VALIDATED') AND threshold_id IS NOT NULL
    AND metrics_path IS NOT NULL)
SELECT registry_id, model_id, 'ACTIVE_BENCHMARK' AS status FROM good
UNION ALL SELECT m.registry_id, m.model_id, 'RETIRED' FROM models m JOIN good USING (registry_id)
WHERE m.status = 'ACTIVE_BENCHMARK'""")
def promote_and_retire(t: Tables):
    models = b.models(t)
    req = models.where(F.col("status").isin("CANDIDATE", "VALIDATED", "REJECTED")).groupBy(
        "registry_id").agg(F.max_by("model_id", "o_orderkey").alias("model_id")).withColumn(
        "event_at", b.stamp())
    return governance.promote_and_retire(models, req).drop("event_at")


@query(f"""WITH {b.MODELS}, {_ROLL}
SELECT to_model_id AS model_id, 'ACTIVE_BENCHMARK' AS status FROM known
UNION ALL SELECT from_model_id, 'RETIRED' FROM known""")
def rollback(t: Tables):
    return _rollback(t)[0].drop("event_at")


@query(f"""WITH {b.MODELS}, {_ROLL}
SELECT 'rb_' || substr(sha256(from_model_id || '|' || to_model_id || '|{b.STAMP}'), 1, 12)
  AS rollback_id, from_model_id, to_model_id, 'RECALL_DROP' AS reason, 'monitor' AS triggered_by
FROM known""")
def rollback_events(t: Tables):
    return _rollback(t)[1].drop("incident_id", "created_at")


@query(f"""WITH {b.MODELS}, {_ROLL}
SELECT from_model_id, to_model_id FROM req EXCEPT SELECT from_model_id, to_model_id FROM known""")
def rollback_rejected(t: Tables):
    return _rollback(t)[2].select("from_model_id", "to_model_id")


@query(f"""WITH {b.MODELS},
s AS (SELECT *, lag(status) OVER (PARTITION BY registry_id ORDER BY created_at, o_orderkey) AS prev
  FROM models),
edges(a, z) AS (VALUES {", ".join(f"('{a}', '{x}')" for a, ts in rules.LIFECYCLE.items() for x in ts)})
SELECT model_id, prev AS previous_status, status FROM s LEFT JOIN edges ON a = prev AND z = status
WHERE prev IS NOT NULL AND z IS NULL""")
def invalid_transitions(t: Tables):
    """Orders of one customer read as the status log of one model."""
    from plumbline.operators.series import time_chunk

    out = governance.invalid_transitions(b.models(t), ["registry_id"],
                                         ["created_at", "o_orderkey"],
                                         time_chunk("created_at", 366 * b.DAY))
    return out.select("model_id", "previous_status", "status")


@query("""SELECT d.doc_id, CASE WHEN p.page_id IS NULL THEN 'MISSING'
  WHEN sha256(p.html) = sha256(d.text) THEN 'OK' WHEN d.lang = 'en' THEN 'OK' ELSE 'MISMATCH' END
  AS integrity FROM documents d LEFT JOIN pages p ON p.page_id = d.doc_id""")
def integrity_check(t: Tables):
    """Documents as registered artifacts, pages as the files; English records are up to date."""
    pages = t.pages.select(F.col("page_id").cast("string").alias("path"),
                           F.sha2("html", 256).alias("sha256"))
    docs = t.documents.select("doc_id", "lang", F.sha2("text", 256).alias("text_sha")).join(
        pages.select(F.col("path").cast("long").alias("doc_id"), "sha256"), "doc_id", "left")
    registry = docs.select(
        "doc_id", F.col("doc_id").cast("string").alias("artifact_path"),
        F.when((F.col("lang") == "en") & F.col("sha256").isNotNull(), F.col("sha256")).otherwise(
            F.col("text_sha")).alias("artifact_sha256"))
    return governance.integrity_check(registry, pages).select("doc_id", "integrity")


_PAIRS = """pairs AS (SELECT *, CAST(score >= 5e-1 AS INT) AS champion_decision,
  CAST(challenger_score >= 5e-1 AS INT) AS challenger_decision,
  score * 100 AS challenger_latency_ms FROM scored)"""


def _pairs(t: Tables):
    rows = b.scored(t)
    champion = rows.select("doc_id", "model_id", "label",
                           (F.col("score") >= 0.5).cast("int").alias("decision"),
                           (F.col("score") * 80).alias("latency_ms"))
    challenger = rows.select("doc_id",
                             (F.col("challenger_score") >= 0.5).cast("int").alias("decision"),
                             (F.col("score") * 100).alias("latency_ms"))
    return compare.paired_predictions(champion, challenger, "doc_id")


@query(f"""WITH {b.SCORED}, {_PAIRS}
SELECT doc_id, champion_decision, challenger_decision, round(challenger_latency_ms, 6)
  AS challenger_latency_ms FROM pairs""")
def paired_predictions(t: Tables):
    return rounded(_pairs(t).select("doc_id", "champion_decision", "challenger_decision",
                                    "challenger_latency_ms"), "challenger_latency_ms")


_CANARY = """canary AS (SELECT model_id, count(*) AS sample_count,
  avg(CAST(champion_decision <> challenger_decision AS INT)) AS disagreement_rate,
  coalesce(avg(challenger_decision) FILTER (label = 1), 0)
    - coalesce(avg(champion_decision) FILTER (label = 1), 0) AS critical_recall_delta,
  quantile_cont(challenger_latency_ms, 95e-2) AS latency_p95_ms FROM pairs GROUP BY 1)"""


@query(f"""WITH {b.SCORED}, {_PAIRS}, {_CANARY}
SELECT model_id, sample_count, round(disagreement_rate, 6) AS disagreement_rate,
  round(critical_recall_delta, 6) AS critical_recall_delta,
  round(latency_p95_ms, 6) AS latency_p95_ms FROM canary""")
def canary_metrics(t: Tables):
    out = compare.canary_metrics(_pairs(t), ["model_id"])
    return rounded(out, "disagreement_rate", "critical_recall_delta", "latency_p95_ms")


@query(f"""WITH {b.SCORED}, {_PAIRS}, {_CANARY}
SELECT 'can_' || substr(sha256(model_id || '|next_' || model_id || '|{b.STAMP}'), 1, 12)
    AS canary_id, model_id AS champion_model_id, 'next_' || model_id AS challenger_model_id,
  sample_count, round(disagreement_rate, 6) AS disagreement_rate,
  round(critical_recall_delta, 6) AS critical_recall_delta,
  round(latency_p95_ms, 6) AS latency_p95_ms, CASE WHEN disagreement_rate <= 1e-1
    AND critical_recall_delta >= -2e-2 THEN 'PASSED' ELSE 'FAILED' END AS status,
  TIMESTAMP '{b.STAMP}' AS created_at FROM canary""")
def record_canary(t: Tables):
    found = compare.canary_metrics(_pairs(t), ["model_id"])
    out = compare.canary_record(found, F.col("model_id"), F.concat(F.lit("next_"), "model_id"),
                                b.stamp(), DriftPolicy(canary_max_disagreement=0.1))
    return rounded(out, "disagreement_rate", "critical_recall_delta", "latency_p95_ms")


@query(f"""WITH {b.SCORED}, {_PAIRS}, {_CANARY}
SELECT model_id AS champion_model_id, sample_count FROM canary WHERE model_id = 'len_en'""")
def list_canaries(t: Tables):
    """Canaries of one champion, newest first."""
    found = compare.canary_metrics(_pairs(t), ["model_id"])
    runs = compare.canary_record(found, F.col("model_id"), F.concat(F.lit("next_"), "model_id"),
                                 b.stamp())
    return runs.where("champion_model_id = 'len_en'").orderBy(F.col("created_at").desc()).select(
        "champion_model_id", "sample_count")
