"""Rule, filter and projection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import rules
from plumbline.operators.calibration import only_split
from plumbline.plans import bindings as b
from plumbline.plans.registry import Tables, query
from plumbline.policy import GatePolicy


def _tally(df, *keys):
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("row_key").alias("key_sum"))


@query(f"""WITH {b.SCORED}
SELECT doc_id, CASE WHEN lang = 'fr' THEN 'ABSTAIN' WHEN toxic = 1 THEN 'REVIEW'
  WHEN score >= 5e-1 THEN 'ANOMALY' ELSE 'NORMAL' END AS decision FROM scored""")
def decide(t: Tables):
    gate = F.when(F.col("lang") == "fr", "ABSTAIN").when(F.col("toxic") == 1, "REVIEW").otherwise(
        "PASS")
    return b.scored(t).select("doc_id", rules.decide(F.col("score"), F.lit(0.5), gate).alias(
        "decision"))


@query(f"""WITH {b.SCORED}
SELECT doc_id, CASE WHEN label = 1 AND score >= 5e-1 THEN 'true_positive'
  WHEN label = 1 THEN 'false_negative' WHEN score >= 5e-1 THEN 'false_positive'
  ELSE 'true_negative' END AS outcome FROM scored""")
def outcome(t: Tables):
    return b.scored(t).select("doc_id", rules.outcome(F.col("label"), F.col("score"), F.lit(0.5)
                                                      ).alias("outcome"))


@query("""WITH d AS (
  SELECT l_orderkey, l_extendedprice AS s, l_discount AS area,
    CASE WHEN l_returnflag = 'N' THEN 0e0 ELSE 40000e0 END AS thr,
    CASE WHEN l_linestatus = 'F' AND l_tax > 5e-2 THEN 'REVIEW' WHEN l_tax = 0 THEN 'ABSTAIN'
      ELSE 'PASS' END AS gate FROM lineitem),
e AS (SELECT *, CASE WHEN gate <> 'PASS' THEN gate WHEN s >= thr THEN 'ANOMALY' ELSE 'NORMAL' END
  AS decision FROM d),
p AS (SELECT *, CASE WHEN decision = 'ABSTAIN' THEN 'ABSTAIN' WHEN decision = 'NORMAL' THEN 'P0'
  WHEN thr <= 0 OR s / thr >= 2 OR area >= 1e-1 THEN 'P3'
  WHEN s / thr >= 125e-2 OR area >= 3e-2 THEN 'P2' ELSE 'P1' END AS review_priority FROM e)
SELECT decision, review_priority, count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS key_sum
FROM p GROUP BY 1, 2""")
def review_priority(t: Tables):
    thr = F.when(F.col("l_returnflag") == "N", 0.0).otherwise(40000.0)
    gate = F.when((F.col("l_linestatus") == "F") & (F.col("l_tax") > 0.05), "REVIEW").when(
        F.col("l_tax") == 0, "ABSTAIN").otherwise("PASS")
    score = F.col("l_extendedprice")
    rows = t.lineitem.select(
        F.col("l_orderkey").alias("row_key"), score, "l_discount", thr.alias("thr"),
        rules.decide(score, thr, gate).alias("decision"))
    rows = rows.withColumn("review_priority", rules.review_priority(
        F.col("decision"), score, F.col("thr"), F.col("l_discount")))
    return _tally(rows, "decision", "review_priority")


@query("""WITH d AS (
  SELECT l_orderkey, l_quantity * 20 AS w, 40e0 + l_linenumber * 10 AS h, l_discount * 100 AS sd,
    l_extendedprice / 1000 AS blur, l_tax * 3200 AS mean FROM lineitem),
e AS (
  SELECT l_orderkey,
    list_filter([CASE WHEN w < 64 OR h < 64 THEN 'image_too_small' END,
      CASE WHEN NOT (w / h BETWEEN 1e-1 AND 10) THEN 'extreme_aspect_ratio' END,
      CASE WHEN sd < 2 THEN 'near_uniform_image' END], lambda x: x IS NOT NULL) AS hard,
    list_filter([CASE WHEN blur < 20 THEN 'possible_blur' END,
      CASE WHEN mean < 12 THEN 'possible_underexposure' END,
      CASE WHEN mean > 243 THEN 'possible_overexposure' END], lambda x: x IS NOT NULL) AS soft
  FROM d)
SELECT CASE WHEN len(hard) > 0 THEN 'ABSTAIN' WHEN len(soft) > 0 THEN 'REVIEW' ELSE 'PASS' END
    AS status,
  array_to_string(CASE WHEN len(hard) > 0 THEN hard ELSE soft END, ',') AS reasons,
  count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS key_sum FROM e GROUP BY 1, 2""")
def quality_gate(t: Tables):
    gate = rules.quality_gate(
        F.col("l_quantity") * 20, F.lit(40.0) + F.col("l_linenumber") * 10,
        F.col("l_discount") * 100, F.col("l_extendedprice") / 1000, F.col("l_tax") * 3200,
        GatePolicy())
    rows = t.lineitem.select(F.col("l_orderkey").alias("row_key"), gate.alias("g")).select(
        "row_key", F.col("g.status").alias("status"),
        F.array_join("g.reasons", ",").alias("reasons"))
    return _tally(rows, "status", "reasons")


@query("""WITH d AS (
  SELECT l_orderkey, CAST(l_quantity > 25 AS INT) + CAST(l_discount > 5e-2 AS INT)
    + CAST(l_tax > 4e-2 AS INT) + CAST(l_returnflag = 'R' AS INT)
    + CAST(l_linestatus = 'F' AS INT) + CAST(l_extendedprice > 30000 AS INT) AS c FROM lineitem)
SELECT c AS signals, c >= 2 AS needs_retraining, CASE WHEN c >= 5 THEN 'P0_BLOCKED'
  WHEN c >= 3 THEN 'P1_INCIDENT' WHEN c >= 2 THEN 'P2_REVIEW' ELSE 'INFO' END AS priority,
  count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS key_sum FROM d GROUP BY 1, 2, 3""")
def signal_count(t: Tables):
    count = rules.signal_count(
        F.col("l_quantity") > 25, F.col("l_discount") > 0.05, F.col("l_tax") > 0.04,
        F.col("l_returnflag") == "R", F.col("l_linestatus") == "F",
        F.col("l_extendedprice") > 30000)
    rows = t.lineitem.select(F.col("l_orderkey").alias("row_key"), count.alias("signals"))
    rows = rows.withColumns({"needs_retraining": F.col("signals") >= 2,
                             "priority": rules.incident_priority(F.col("signals"))})
    return _tally(rows, "signals", "needs_retraining", "priority")


@query("""SELECT lang, CASE WHEN s >= 9e-1 THEN 'P0' WHEN s >= 75e-2 THEN 'P1'
  WHEN s >= 5e-1 THEN 'P2' ELSE 'P3' END AS bucket, count(*) AS n,
  CAST(sum(doc_id) AS BIGINT) AS key_sum
FROM (SELECT *, n_chars / (n_chars + 2000e0) AS s FROM documents) GROUP BY 1, 2""")
def urgency_bucket(t: Tables):
    score = F.col("n_chars") / (F.col("n_chars") + 2000.0)
    rows = t.documents.select(F.col("doc_id").alias("row_key"), "lang",
                              rules.urgency_bucket(score).alias("bucket"))
    return _tally(rows, "lang", "bucket")


@query("""SELECT doc_id, substr(text, 1, 1) IN ('=', '+', '-', '@') AS quoted,
  sha256(CASE WHEN substr(text, 1, 1) IN ('=', '+', '-', '@') THEN '''' || text ELSE text END)
    AS safe_hash FROM documents""")
def spreadsheet_safe(t: Tables):
    safe = rules.spreadsheet_safe(F.col("text"))
    return t.documents.select("doc_id", (safe != F.col("text")).alias("quoted"),
                              F.sha2(safe, 256).alias("safe_hash"))


@query(r"""WITH n AS (
  SELECT page_id, string_split(regexp_replace(url, '/+$', ''), '/')[-1] AS name FROM pages)
SELECT page_id, translate(lower(CASE WHEN regexp_matches(name, '^.+\.[^.]+$')
  THEN regexp_replace(name, '\.[^.]+$', '') ELSE name END), '-_', '') AS normalized_name FROM n""")
def normalized_name(t: Tables):
    return t.pages.select("page_id", rules.normalized_name(F.col("url")).alias("normalized_name"))


@query("SELECT page_id, sha256(url) AS path_key FROM pages")
def path_key(t: Tables):
    return t.pages.select("page_id", rules.path_key(F.col("url")).alias("path_key"))


_EDGES = ", ".join(f"('{a}', '{x}')" for a, targets in rules.LIFECYCLE.items() for x in targets)


@query(f"""WITH {b.MODELS}, edges(a, z) AS (VALUES {_EDGES}),
m AS (SELECT *, lead(status) OVER (PARTITION BY registry_id ORDER BY created_at, o_orderkey)
  AS target FROM models)
SELECT status, target, z IS NOT NULL AS allowed, count(*) AS n
FROM m LEFT JOIN edges ON a = status AND z = target WHERE target IS NOT NULL GROUP BY 1, 2, 3""")
def transition_allowed(t: Tables):
    from plumbline.operators.series import previous_value, time_chunk

    steps = previous_value(b.models(t), ["registry_id"], ["created_at", "o_orderkey"], "status",
                           "source", time_chunk("created_at", 366 * b.DAY))
    return steps.where(F.col("source").isNotNull()).select(
        F.col("source").alias("status"), F.col("status").alias("target")).withColumn(
        "allowed", rules.transition_allowed(F.col("status"), F.col("target"))).groupBy(
        "status", "target", "allowed").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT o_orderpriority, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS key_sum
FROM orders WHERE lower(o_orderpriority) LIKE '%e%' GROUP BY 1""")
def contains_ci(t: Tables):
    rows = t.orders.where(rules.contains_ci(F.col("o_orderpriority"), "E"))
    return _tally(rows.select("o_orderpriority", F.col("o_orderkey").alias("row_key")),
                  "o_orderpriority")


@query(f"""WITH {b.SCORED}
SELECT model_id, count(*) AS n FROM scored WHERE split = 'validation' GROUP BY 1""")
def split_guard(t: Tables):
    rows = only_split(b.scored(t).where("split = 'validation'"), "split", "validation")
    return rows.groupBy("model_id").agg(F.count(F.lit(1)).alias("n"))


@query(r"""SELECT doc_id,
  regexp_matches(text, '(?i)(api[_-]?key|secret|token)\s*=\s*[''"][^''"]{8,}') AS secret,
  regexp_matches(text, '\b(TODO|FIXME|HACK)\b') AS marker FROM documents""")
def text_flags(t: Tables):
    return t.documents.select("doc_id", rules.secret_flag(F.col("text")).alias("secret"),
                              rules.marker_flag(F.col("text")).alias("marker"))


@query("""SELECT doc_id, sha256(text) AS sha256 FROM documents""")
def content_hash(t: Tables):
    return t.documents.select("doc_id", F.sha2("text", 256).alias("sha256"))
