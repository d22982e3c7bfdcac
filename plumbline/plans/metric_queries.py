"""Metric and calibration queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import calibration, metrics
from plumbline.plans import bindings as b
from plumbline.plans.registry import Tables, query, rounded

K = ["model_id"]

_COUNTS = """count(*) FILTER (label = 0 AND score < 5e-1) AS tn,
  count(*) FILTER (label = 0 AND score >= 5e-1) AS fp,
  count(*) FILTER (label = 1 AND score < 5e-1) AS fn,
  count(*) FILTER (label = 1 AND score >= 5e-1) AS tp"""
_PRF = """round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp)::DOUBLE END, 6) AS precision,
  round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn)::DOUBLE END, 6) AS recall,
  round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn)::DOUBLE END, 6)
    AS f1,
  round(CASE WHEN tn + fp = 0 THEN NULL ELSE tn / (tn + fp)::DOUBLE END, 6) AS specificity"""

# pairs of an anomaly and a normal item, the definition of the area under the curve
_RANK = """auc AS (
  SELECT p.model_id, avg(CASE WHEN p.score > n.score THEN 1e0 WHEN p.score = n.score THEN 5e-1
    ELSE 0e0 END) AS auroc
  FROM scored p JOIN scored n ON p.model_id = n.model_id AND p.label = 1 AND n.label = 0 GROUP BY 1),
steps AS (SELECT model_id, score, count(*) FILTER (label = 1) AS p, count(*) AS n
  FROM scored GROUP BY 1, 2),
curve AS (SELECT model_id, p, sum(p) OVER w AS cp, sum(n) OVER w AS cn, sum(p) OVER
  (PARTITION BY model_id) AS tp FROM steps WINDOW w AS (PARTITION BY model_id ORDER BY score DESC)),
ap AS (SELECT model_id, sum(p / tp::DOUBLE * (cp / cn::DOUBLE)) AS ap FROM curve
  WHERE tp > 0 GROUP BY 1),
rank AS (SELECT model_id, count(*) FILTER (label = 1) AS positives,
    count(*) FILTER (label = 0) AS negatives, round(any_value(auroc), 6) AS auroc,
    round(CASE WHEN count(*) FILTER (label = 0) > 0 THEN any_value(ap) END, 6)
      AS average_precision
  FROM scored LEFT JOIN auc USING (model_id) LEFT JOIN ap USING (model_id) GROUP BY 1)"""


@query(f"""WITH {b.SCORED}, c AS (SELECT model_id, {_COUNTS} FROM scored GROUP BY 1)
SELECT *, {_PRF} FROM c""")
def confusion(t: Tables):
    out = metrics.prf(metrics.confusion(b.scored(t), K, "label", "score", F.lit(0.5)))
    return rounded(out, "precision", "recall", "f1", "specificity")


@query(f"""WITH {b.SCORED}, c AS (SELECT model_id, {_COUNTS} FROM scored GROUP BY 1)
SELECT model_id, 'actual_normal' AS actual, tn AS predicted_normal, fp AS predicted_anomaly FROM c
UNION ALL SELECT model_id, 'actual_anomaly', fn, tp FROM c""")
def confusion_table(t: Tables):
    return metrics.confusion_table(
        metrics.confusion(b.scored(t), K, "label", "score", F.lit(0.5)), K)


@query(f"WITH {b.SCORED}, {_RANK} SELECT * FROM rank")
def ranking_metrics(t: Tables):
    out = metrics.ranking_metrics(b.scored(t), K, "label", "score")
    return rounded(out, "auroc", "average_precision")


@query(f"""WITH {b.SCORED}, {_RANK}, c AS (SELECT model_id, {_COUNTS} FROM scored GROUP BY 1)
SELECT c.*, {_PRF}, 5e-1 AS threshold, positives, negatives, auroc, average_precision
FROM c JOIN rank USING (model_id)""")
def evaluation_report(t: Tables):
    rows = b.scored(t).withColumn("threshold", F.lit(0.5))
    out = metrics.evaluation_report(rows, K, "label", "score", "threshold")
    return rounded(out, "precision", "recall", "f1", "specificity", "auroc", "average_precision")


# upper-neighbour quantile: 0-based index ceil(q * (n - 1)) of the sorted values
_HIGHER = """ranked AS (
  SELECT model_id, score, row_number() OVER (PARTITION BY model_id ORDER BY score) - 1 AS i,
    count(*) OVER (PARTITION BY model_id) AS n FROM scored WHERE label = 0),
thr AS (SELECT model_id, score AS threshold FROM ranked WHERE i = ceil(95e-2 * (n - 1) - 1e-9))"""


@query(f"""WITH {b.SCORED}, {_HIGHER},
r AS (SELECT model_id, any_value(threshold) AS threshold,
  avg(CASE WHEN label = 1 THEN CAST(score >= threshold AS INT)::DOUBLE END) AS recall
  FROM scored LEFT JOIN thr USING (model_id) GROUP BY 1)
SELECT model_id, CASE WHEN recall IS NOT NULL THEN round(threshold, 6) END AS threshold,
  CASE WHEN threshold IS NOT NULL THEN round(recall, 6) END AS recall FROM r""")
def recall_at_fpr(t: Tables):
    out = metrics.recall_at_fpr(b.scored(t), K, "label", "score", 0.05)
    return rounded(out, "threshold", "recall")


@query(f"""WITH {b.SCORED}
SELECT model_id, round(quantile_cont(score, 995e-3), 6) AS threshold,
  'normal_quantile_0.995' AS method, 'PROVISIONAL_NORMAL_ONLY' AS status
FROM scored WHERE label = 0 AND split = 'validation' GROUP BY 1""")
def normal_quantile_threshold(t: Tables):
    rows = calibration.only_split(b.scored(t).where("split = 'validation'"), "split", "validation")
    out = calibration.normal_quantile_threshold(rows, K, "label", "score")
    return rounded(out, "threshold")


# every candidate against every item
_F1 = """val AS (SELECT model_id, label, score FROM scored WHERE split = 'validation'),
cand AS (SELECT DISTINCT model_id, score AS c FROM val),
tried AS (
  SELECT model_id, c, avg(CASE WHEN label = 0 THEN CAST(score >= c AS INT)::DOUBLE END) AS fpr,
    2 * count(*) FILTER (label = 1 AND score >= c)::DOUBLE
      / (count(*) FILTER (score >= c) + count(*) FILTER (label = 1)) AS f1
  FROM cand JOIN val USING (model_id) GROUP BY 1, 2),
best AS (SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY f1 DESC, c) AS r
  FROM tried WHERE fpr <= 5e-2),
top AS (SELECT model_id, max(score) FILTER (label = 0) AS m, max(label) AS has FROM val GROUP BY 1),
f1 AS (
  SELECT top.model_id, has, CASE WHEN c IS NULL THEN nextafter(m, 'inf'::DOUBLE) ELSE c END AS threshold,
    coalesce(fpr, 0) AS fpr, coalesce(f1, 0) AS f1
  FROM top LEFT JOIN best ON best.model_id = top.model_id AND r = 1)"""


@query(f"""WITH {b.SCORED}, {_F1}
SELECT model_id, round(threshold, 6) AS threshold, round(fpr, 6) AS fpr, round(f1, 6) AS f1,
  'recall_at_fpr_then_f1' AS method, 'LOCKED' AS status FROM f1""")
def f1_threshold_at_fpr(t: Tables):
    rows = b.scored(t).where("split = 'validation'")
    out = calibration.f1_threshold_at_fpr(rows, K, "label", "score", 0.05)
    return rounded(out, "threshold", "fpr", "f1")


@query(f"""WITH {b.SCORED}, {_F1},
q AS (SELECT model_id, quantile_cont(score, 995e-3) AS t FROM val WHERE label = 0 GROUP BY 1)
SELECT model_id, round(CASE WHEN has = 1 THEN threshold ELSE t END, 6) AS image_threshold,
  round(CASE WHEN has = 1 THEN threshold ELSE t END, 6) AS pixel_threshold,
  CASE WHEN has = 1 THEN 'recall_at_fpr_then_f1' ELSE 'normal_quantile_0.995' END AS method,
  CASE WHEN has = 1 THEN 'LOCKED' ELSE 'PROVISIONAL_NORMAL_ONLY' END AS status,
  5e-2 AS target_normal_fpr, 'validation' AS calibration_split,
  TIMESTAMP '{b.STAMP}' AS created_at FROM f1 JOIN q USING (model_id)""")
def record_threshold(t: Tables):
    rows = b.scored(t).where("split = 'validation'")
    found = calibration.calibrate(rows, K, "label", "score", 0.05)
    out = calibration.threshold_record(found, F.col("model_id"), F.lit("a" * 64), b.stamp(), 0.05)
    return rounded(out.drop("threshold_id", "dataset_manifest_sha256"), "image_threshold",
                   "pixel_threshold")


@query(f"""WITH {b.PIXELS},
c AS (SELECT model, count(*) FILTER (v >= 15e-2 AND m = 1) AS i,
  count(*) FILTER (v >= 15e-2) AS p, count(*) FILTER (m = 1) AS t FROM pixels GROUP BY 1)
SELECT model, round(CASE WHEN p + t - i > 0 THEN i / (p + t - i)::DOUBLE ELSE 1 END, 6) AS pixel_iou,
  round(CASE WHEN p + t > 0 THEN 2 * i / (p + t)::DOUBLE ELSE 1 END, 6) AS pixel_dice FROM c""")
def pixel_overlap(t: Tables):
    maps = b.maps_and_masks(t).withColumn("scores", F.transform(
        "scores", lambda v: v.cast("double")))
    out = metrics.pixel_overlap(maps, ["model"], "scores", "mask", F.lit(0.15))
    return rounded(out, "pixel_iou", "pixel_dice")


_PIXEL_RANK = """steps AS (SELECT model, v, count(*) FILTER (m = 1) AS p,
    count(*) FILTER (m = 0) AS n FROM pixels GROUP BY 1, 2),
curve AS (SELECT *, sum(p) OVER w AS cp, sum(n) OVER w AS cn, sum(p) OVER (PARTITION BY model) AS tp,
    sum(n) OVER (PARTITION BY model) AS tn
  FROM steps WINDOW w AS (PARTITION BY model ORDER BY v DESC)),
pr AS (SELECT model, CAST(any_value(tp) AS BIGINT) AS positives,
    CAST(any_value(tn) AS BIGINT) AS negatives,
    sum(n * (cp - p / 2e0)) / (any_value(tp)::DOUBLE * any_value(tn)) AS auroc,
    sum(p * (cp::DOUBLE / (cp + cn))) / any_value(tp) AS ap FROM curve GROUP BY 1)"""


@query(f"""WITH {b.PIXELS}, {_PIXEL_RANK}
SELECT model, positives, negatives, round(auroc, 6) AS auroc, round(ap, 6) AS average_precision
FROM pr""")
def pixel_ranking(t: Tables):
    pix = metrics.explode_pixels(b.maps_and_masks(t), ["model"], "scores", "mask")
    out = metrics.ranking_metrics(pix, ["model"], "pixel_label", "pixel_score")
    return rounded(out, "auroc", "average_precision")


@query(f"""WITH {b.PIXELS}
SELECT model, round(quantile_cont(v, 999e-3), 6) AS pixel_threshold,
  'normal_pixel_quantile_0.999' AS method FROM pixels GROUP BY 1""")
def pixel_normal_threshold(t: Tables):
    pix = metrics.explode_pixels(b.maps_and_masks(t), ["model"], "scores", "mask")
    return rounded(calibration.pixel_normal_threshold(pix, ["model"], "pixel_score"),
                   "pixel_threshold")


_PROBS = ", ".join(f"({i}, {p!r}::DOUBLE)" for i, p in enumerate(
    calibration.linspace(0.8, 0.9999, 256)))


@query(f"""WITH {b.PIXELS}, probs(j, q) AS (VALUES {_PROBS}),
s AS (SELECT model, v, m, row_number() OVER (PARTITION BY model ORDER BY v) - 1 AS i,
  count(*) OVER (PARTITION BY model) AS n FROM pixels),
pos AS (SELECT DISTINCT model, j, q * (n - 1) AS x, floor(q * (n - 1) + 1e-9) AS lo,
  ceil(q * (n - 1) - 1e-9) AS hi FROM s, probs),
cand AS (SELECT pos.model, j, a.v + (z.v - a.v) * greatest(x - lo, 0e0) AS c
  FROM pos JOIN s a ON a.model = pos.model AND a.i = lo JOIN s z ON z.model = pos.model AND z.i = hi),
reach AS (SELECT s.model, s.m, (SELECT count(*) FROM cand k WHERE k.model = s.model AND k.c <= s.v)
  AS r FROM s),
f AS (SELECT cand.model, j, c, 2 * count(*) FILTER (r > j AND m = 1)::DOUBLE
    / (count(*) FILTER (r > j) + count(*) FILTER (m = 1)) AS f1
  FROM cand JOIN reach ON reach.model = cand.model GROUP BY 1, 2, 3),
best AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY f1 DESC, j) AS b FROM f)
SELECT model, round(c, 6) AS pixel_threshold, round(f1, 6) AS f1, 'pixel_f1' AS method
FROM best WHERE b = 1""")
def pixel_f1_threshold(t: Tables):
    pix = metrics.explode_pixels(b.maps_and_masks(t), ["model"], "scores", "mask")
    out = calibration.pixel_f1_threshold(pix, ["model"], "pixel_label", "pixel_score")
    return rounded(out, "pixel_threshold", "f1")


@query(f"""WITH {b.PIXELS}, {_PIXEL_RANK}, o AS (
  SELECT model, count(*) FILTER (v >= 15e-2 AND m = 1) AS i, count(*) FILTER (v >= 15e-2) AS p,
    count(*) FILTER (m = 1) AS t FROM pixels GROUP BY 1),
img AS (SELECT model, vec_id, max(v) AS s, max(m) AS l FROM pixels GROUP BY 1, 2),
c AS (SELECT model, 2e-1 AS threshold, count(*) FILTER (l = 0 AND s < 2e-1) AS tn,
    count(*) FILTER (l = 0 AND s >= 2e-1) AS fp, count(*) FILTER (l = 1 AND s < 2e-1) AS fn,
    count(*) FILTER (l = 1 AND s >= 2e-1) AS tp FROM img GROUP BY 1)
SELECT model, threshold, tn, fp, fn, tp, {_PRF},
  round(CASE WHEN p + t - i > 0 THEN i / (p + t - i)::DOUBLE ELSE 1 END, 6) AS pixel_iou,
  round(CASE WHEN p + t > 0 THEN 2 * i / (p + t)::DOUBLE ELSE 1 END, 6) AS pixel_dice,
  round(auroc, 6) AS pixel_auroc, round(ap, 6) AS pixel_average_precision
FROM c JOIN o USING (model) JOIN pr USING (model)""")
def evaluation_report_with_pixels(t: Tables):
    maps = b.maps_and_masks(t).withColumn("scores", F.transform(
        "scores", lambda v: v.cast("double")))
    items = maps.select("model", F.array_max("scores").alias("score"),
                        F.array_max("mask").alias("label"), F.lit(0.2).alias("threshold"))
    report = metrics.evaluation_report(items, ["model"], "label", "score", "threshold")
    overlap = metrics.pixel_overlap(maps, ["model"], "scores", "mask", F.lit(0.15))
    ranking = metrics.ranking_metrics(
        metrics.explode_pixels(maps, ["model"], "scores", "mask"), ["model"], "pixel_label",
        "pixel_score")
    out = metrics.with_pixel_report(report, overlap, ranking, ["model"])
    return rounded(
        out.drop("positives", "negatives", "auroc", "average_precision"), "precision", "recall",
        "f1", "specificity", "pixel_iou", "pixel_dice", "pixel_auroc", "pixel_average_precision")


@query(f"""WITH {b.SCORED},
s AS (SELECT model_id, label, min(score) AS lo, max(score) AS hi FROM scored GROUP BY 1, 2),
w AS (SELECT model_id, label, CASE WHEN lo = hi THEN lo - 5e-1 ELSE lo END AS lo,
  CASE WHEN lo = hi THEN hi + 5e-1 ELSE hi END AS hi FROM s),
h AS (SELECT model_id, label, least(29, floor((score - lo) / (hi - lo) * 30))::INT AS bin,
  count(*) AS n FROM scored JOIN w USING (model_id, label) GROUP BY 1, 2, 3)
SELECT w.model_id, w.label, g.bin::INT AS bin, round(lo + g.bin * ((hi - lo) / 30), 6) AS bin_start,
  round(lo + (g.bin + 1) * ((hi - lo) / 30), 6) AS bin_end, coalesce(n, 0) AS n
FROM w JOIN range(0, 30) AS g(bin) ON true
LEFT JOIN h ON h.model_id = w.model_id AND h.label = w.label AND h.bin = g.bin""")
def score_histogram(t: Tables):
    out = metrics.score_histogram(b.scored(t), ["model_id", "label"], "score")
    return rounded(out, "bin_start", "bin_end")


@query("""SELECT 'len_' || lang AS model_id, count(DISTINCT n_chars / (n_chars + 2000e0))
  AS distinct_scores FROM documents GROUP BY 1""")
def distinct_scores(t: Tables):
    """Scores need no label, so every document counts."""
    n = F.col("n_chars")
    rows = t.documents.select(F.concat(F.lit("len_"), "lang").alias("model_id"),
                              (n / (n + F.lit(2000.0))).alias("score"))
    return metrics.distinct_scores(rows, K, "score")


@query(f"""WITH {b.SCORED}, {_HIGHER}
SELECT DISTINCT model_id, round(c, 9) AS candidate FROM (
  SELECT model_id, score AS c FROM scored WHERE label = 0
  UNION SELECT model_id, score FROM scored WHERE label = 1
  UNION SELECT model_id, threshold FROM thr)""")
def candidate_scores(t: Tables):
    from plumbline.operators.ordered import exact_quantiles

    rows = b.scored(t)
    normal, anomaly = rows.where("label = 0"), rows.where("label = 1")
    floor = exact_quantiles(normal, K, "score", [0.95], "higher").select("model_id", "quantile")
    both = normal.select("model_id", "score").union(anomaly.select("model_id", "score"))
    return both.union(floor).distinct().select("model_id", F.round("score", 9).alias("candidate"))


# --- keys that are NULL, have one class, or are absent ---------------------------------------

_NULLED = f"""{b.SCORED.replace("scored AS", "known AS")},
scored AS (SELECT * REPLACE (CASE WHEN lang = 'en' THEN '~' ELSE model_id END AS model_id)
  FROM known WHERE doc_id % 5 <> 0)"""


def _nulled(t: Tables):
    """English items have no model, and every fifth item has no score."""
    return b.scored(t).withColumns({
        "model_id": F.when(F.col("lang") != "en", F.col("model_id")),
        "score": F.when(F.col("doc_id") % 5 != 0, F.col("score"))})


@query(f"WITH {_NULLED}, {_RANK} SELECT * REPLACE (nullif(model_id, '~') AS model_id) FROM rank")
def ranking_metrics_null_key(t: Tables):
    out = metrics.ranking_metrics(_nulled(t), K, "label", "score")
    return rounded(out, "auroc", "average_precision")


@query(f"""WITH {_NULLED.replace("scored AS (", "one AS (")},
scored AS (SELECT * REPLACE ('all' AS model_id) FROM one), {_RANK}
SELECT * EXCLUDE (model_id) FROM rank""")
def ranking_metrics_overall(t: Tables):
    out = metrics.ranking_metrics(_nulled(t), [], "label", "score")
    return rounded(out, "auroc", "average_precision")


@query("""SELECT round(quantile_cont(value, 5e-1), 6) AS p50,
  round(quantile_cont(value, 95e-2), 6) AS p95, round(quantile_cont(value, 99e-2), 6) AS p99,
  count(*) AS n, round(avg(value), 6) AS mean_ms,
  round(1000 / avg(value), 6) AS throughput_per_second FROM events""")
def latency_overall(t: Tables):
    out = metrics.latency_profile(t.events, [], "value")
    return rounded(out, "p50", "p95", "p99", "mean_ms", "throughput_per_second")


@query(f"""WITH {b.SCORED.replace("scored AS", "known AS")},
scored AS (SELECT * FROM known WHERE lang <> 'de' OR label = 1), {_F1}
SELECT model_id, round(threshold, 6) AS threshold,
  round(CASE WHEN threshold IS NOT NULL THEN fpr END, 6) AS fpr,
  round(CASE WHEN threshold IS NOT NULL THEN f1 END, 6) AS f1,
  CASE WHEN threshold IS NULL THEN 'NO_NORMALS' ELSE 'LOCKED' END AS status FROM f1""")
def f1_threshold_one_class(t: Tables):
    """One model has anomalies only."""
    rows = b.scored(t).where("split = 'validation' AND (lang <> 'de' OR label = 1)")
    out = calibration.f1_threshold_at_fpr(rows, K, "label", "score", 0.05)
    return rounded(out.drop("method"), "threshold", "fpr", "f1")
