"""How the supplied tables stand in for scores, metric series, files, images and models.

Each binding is a DataFrame function and a SQL fragment that says the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import rules
from plumbline.operators import series
from plumbline.operators.lifecycle import random_features
from plumbline.plans.registry import Tables

DAY = 86400
STAMP = "2024-02-01 00:00:00"
BASELINE_END = "2024-01-11 00:00:00"


def stamp() -> Column:
    """The fixed time that audit rows of the registered queries carry."""
    return F.to_timestamp(F.lit(STAMP))


def ntz_safe(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp") for c in columns})


# --- scored items: documents with labels -----------------------------------------------------

def scored(t: Tables) -> DataFrame:
    """Items scored by text length, one model per language; anomaly = low quality."""
    n = F.col("n_chars")
    number = F.substring("source", 4, 9).cast("int")
    return t.documents.select("doc_id", "source", "lang", "n_chars").join(
        t.labels, "doc_id").select(
        "doc_id", "source", "lang", F.concat(F.lit("len_"), "lang").alias("model_id"),
        F.when(number < 10, "validation").otherwise("test").alias("split"),
        (1 - F.col("quality")).alias("label"), "toxic",
        (n / (n + F.lit(2000.0))).alias("score")).withColumn(
        "challenger_score", F.lit(0.75) * F.col("score") + F.lit(0.25) * F.col("toxic"))


SCORED = """scored AS (
  SELECT d.doc_id, d.source, d.lang, 'len_' || d.lang AS model_id,
    CASE WHEN CAST(substr(d.source, 4) AS INT) < 10 THEN 'validation' ELSE 'test' END AS split,
    1 - l.quality AS label, l.toxic, d.n_chars / (d.n_chars + 2000e0) AS score,
    75e-2 * (d.n_chars / (d.n_chars + 2000e0)) + 25e-2 * l.toxic AS challenger_score
  FROM documents d JOIN labels l USING (doc_id))"""


# --- metric series: daily event values -------------------------------------------------------

def daily(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type", F.date_trunc("day", "ts").cast("timestamp").alias("day")
                            ).agg(F.avg("value").alias("metric"))


def daily_baseline(days: DataFrame) -> DataFrame:
    first = days.where(F.col("day") < F.to_timestamp(F.lit(BASELINE_END)))
    return series.baseline_stats(first, ["event_type"], "metric")


def daily_points(t: Tables) -> DataFrame:
    days = daily(t)
    rows = series.with_baseline(days, daily_baseline(days), ["event_type"])
    return series.drift_monitor(rows, ["event_type"], ["day"], "metric",
                                series.time_chunk("day", 30 * DAY))


DAILY = f"""daily AS (
  SELECT event_type, CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, avg(value) AS metric
  FROM events GROUP BY 1, 2),
base AS (
  SELECT event_type, avg(metric) AS mu, stddev_samp(metric) AS sd, count(metric) AS n
  FROM daily WHERE day < TIMESTAMP '{BASELINE_END}' GROUP BY 1)"""


def scan_sql(key: str, order: str, value: str, numbered: str) -> str:
    """Sequential control charts as a recursive query over rows numbered 1.. per key."""
    return f"""scan AS (
  SELECT {key}, {order}, i, {value}, mu, sd, 25e-2 * {value} + 75e-2 * mu AS e,
    greatest(0e0, (mu - {value}) / sd - 25e-2) AS c FROM {numbered} WHERE i = 1
  UNION ALL
  SELECT n.{key}, n.{order}, n.i, n.{value}, n.mu, n.sd, 25e-2 * n.{value} + 75e-2 * s.e,
    greatest(0e0, s.c + (n.mu - n.{value}) / n.sd - 25e-2)
  FROM scan s JOIN {numbered} n ON n.{key} = s.{key} AND n.i = s.i + 1),
chart AS (
  SELECT *, mu - 3 * sd * sqrt(25e-2 / 175e-2 * (1 - pow(75e-2, 2 * i))) AS lim FROM scan),
points AS (
  SELECT *, CASE WHEN e < lim AND c > 4 THEN 'BOTH_ALERT' WHEN e < lim THEN 'EWMA_ALERT'
    WHEN c > 4 THEN 'CUSUM_ALERT' ELSE 'STABLE' END AS trend_status FROM chart),
worst AS (
  SELECT {key}, min({order}) AS window_start, max({order}) AS window_end, count(*) AS n_points,
    arg_max({value}, i) AS metric_value,
    arg_max(i, CASE trend_status WHEN 'STABLE' THEN 0 WHEN 'EWMA_ALERT' THEN 1
      WHEN 'CUSUM_ALERT' THEN 2 ELSE 3 END * 1000000000::BIGINT - i) AS worst_i
  FROM points GROUP BY 1),
windows AS (
  SELECT w.{key}, window_start, window_end, metric_value, p.e AS ewma_value, p.c AS cusum_value,
    p.trend_status, CASE WHEN p.trend_status = 'STABLE' THEN 'STABLE'
      WHEN p.trend_status = 'BOTH_ALERT' AND n_points <= 3 THEN 'SUDDEN'
      WHEN p.trend_status IN ('CUSUM_ALERT', 'BOTH_ALERT') THEN 'GRADUAL' ELSE 'TECHNICAL'
      END AS drift_pattern, n_points
  FROM worst w JOIN points p ON p.{key} = w.{key} AND p.i = w.worst_i)"""


DAILY_SCAN = f"""{DAILY},
numbered AS (
  SELECT event_type, day, metric, mu, sd,
    row_number() OVER (PARTITION BY event_type ORDER BY day) AS i
  FROM daily JOIN base USING (event_type)),
{scan_sql("event_type", "day", "metric", "numbered")}"""


def user_windows(t: Tables) -> DataFrame:
    """One drift window per user over the raw event values."""
    ev = ntz_safe(t.events.select("user_id", "ts", "event_id", "value"), "ts")
    first = ev.where(F.col("ts") < F.to_timestamp(F.lit(BASELINE_END)))
    base = series.baseline_stats(first, ["user_id"], "value").where("baseline_std > 0")
    rows = series.with_baseline(ev, base, ["user_id"])
    # a user without a baseline has no chart and so no window; chunks keep a busy user splittable
    points = series.drift_monitor(rows, ["user_id"], ["ts", "event_id"], "value",
                                  series.time_chunk("ts", DAY)).where(
        F.col("trend_status") != "NO_BASELINE")
    return series.window_rollup(points, ["user_id"], "value", "ts")


USER_SCAN = f"""ubase AS (
  SELECT user_id, avg(value) AS mu, stddev_samp(value) AS sd FROM events
  WHERE ts < TIMESTAMP '{BASELINE_END}' GROUP BY 1 HAVING stddev_samp(value) > 0),
unumbered AS (
  SELECT user_id, ts, value, mu, sd,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i
  FROM events JOIN ubase USING (user_id)),
{scan_sql("user_id", "ts", "value", "unumbered")}"""


def event_vectors(t: Tables) -> DataFrame:
    """Events as vectors of value and hundredths of the day; ``ref`` marks the baseline."""
    ts = F.col("ts").cast("timestamp")
    clock = F.unix_micros(ts) % (DAY * 1_000_000) / (DAY * 10_000.0)
    return t.events.select("event_id", "user_id", "event_type", "value", F.array("value", clock).alias(
        "x"), (ts < F.to_timestamp(F.lit(BASELINE_END))).alias("ref"))


VECTORS = f"""ev AS (
  SELECT event_id, user_id, event_type, value, ts < TIMESTAMP '{BASELINE_END}' AS ref,
    [value, epoch_us(ts) % {DAY * 1_000_000} / {DAY * 10_000}e0] AS x FROM events)"""


def two_sample_sql(name: str, source: str, key: str, row_id: str, dim: int, features: int,
                   replicates: int, seed: int = 5, sample: int = 256) -> str:
    """The two-sample test over rows of ``key, row_id, ref`` and a list ``x``, as CTE ``name``."""
    turn, phase = random_features(dim, features, 1.0, seed)
    waves = ", ".join(f"({k}, [{', '.join(repr(float(w)) + '::DOUBLE' for w in turn[k])}], "
                      f"{float(phase[k])!r}::DOUBLE)" for k in range(features))
    return f"""{name}_hash AS (SELECT {row_id} AS id, x, sha256('{seed}|' || {row_id}) AS h FROM {source}),
{name}_few AS (SELECT x, row_number() OVER (ORDER BY h) AS i FROM {name}_hash
  QUALIFY row_number() OVER (ORDER BY h) <= {sample}),
{name}_scale AS (SELECT quantile_cont(list_distance(p.x::DOUBLE[], q.x::DOUBLE[]), 5e-1) AS s
  FROM {name}_few p JOIN {name}_few q ON p.i < q.i),
{name}_wave(k, w, ph) AS (VALUES {waves}),
{name}_z AS (SELECT {key} AS key, {row_id} AS id, k, sqrt({2 / features!r}::DOUBLE) * cos(ph + list_sum(
    list_transform(list_zip(w, x), lambda t: t[1] * t[2]::DOUBLE)) / s) AS z
  FROM {source}, {name}_wave, {name}_scale),
{name}_side AS (SELECT id, r, (strpos('0123456789abcdef', substr(h, 1 + (r // 4)::INT, 1)) - 1
    >> (3 - r % 4)::INT) & 1 = 1 AS one FROM {name}_hash, range({replicates}) AS t(r)
  UNION ALL SELECT {row_id}, {replicates}, ref FROM {source}),
{name}_sum AS (SELECT key, r, k, coalesce(sum(z) FILTER (one), 0) AS s, count(*) FILTER (one) AS n,
    sum(z) AS st, count(*) FILTER (NOT one) AS m
  FROM {name}_z JOIN {name}_side USING (id) GROUP BY 1, 2, 3),
{name}_d AS (SELECT key, r, n, m, CASE WHEN n > 0 AND m > 0 THEN
    sum(pow(s / n - (st - s) / m, 2)) END AS d FROM {name}_sum GROUP BY 1, 2, 3, 4),
{name}_o AS (SELECT *, d / (1 / n + 1 / m) AS o FROM {name}_d),
{name} AS (SELECT a.key, a.n AS n_reference, a.m AS n_current, a.d AS mmd, CASE WHEN a.d IS NOT NULL
    THEN (1 + count(*) FILTER (b.o >= a.o * (1 - 1e-9))) / (1 + count(b.o))::DOUBLE END AS p_value
  FROM {name}_o a LEFT JOIN {name}_o b ON b.key = a.key AND b.r < {replicates}
  WHERE a.r = {replicates} GROUP BY 1, 2, 3, 4)"""


def reference_sql(name: str, key: str) -> str:
    """Mean, strongest direction and error quantiles of the marked vectors in ``ev``, and the errors of
    the others, in two dimensions, where the direction has a closed form."""
    return f"""{name}_sum AS (SELECT {key} AS key, count(*) AS n, avg(x[1]) AS m1, avg(x[2]) AS m2,
    var_pop(x[1]) AS a, var_pop(x[2]) AS d, covar_pop(x[1], x[2]) AS b FROM ev WHERE ref GROUP BY 1),
{name}_dir AS (SELECT *, (a + d) / 2 + sqrt(pow((a - d) / 2, 2) + b * b) AS l FROM {name}_sum),
{name}_turn AS (SELECT *, CASE WHEN b <> 0 THEN l - d WHEN a >= d THEN 1 ELSE 0 END AS v1,
    CASE WHEN b <> 0 THEN b WHEN a >= d THEN 0 ELSE 1 END AS v2 FROM {name}_dir),
{name}_err AS (SELECT t.key, ref, abs((x[1] - m1) * v2 - (x[2] - m2) * v1) / sqrt(v1 * v1 + v2 * v2)
    AS e FROM ev JOIN {name}_turn t ON t.key = ev.{key}),
{name}_ref AS (SELECT key, quantile_cont(e, 95e-2) AS p95, quantile_cont(e, 99e-2) AS p99
  FROM {name}_err WHERE ref GROUP BY 1),
{name} AS (SELECT t.key, n, l / (a + d) AS captured, p95, p99, w.e AS uae_p95_error,
    w.e > p99 AS uae_above_p99
  FROM {name}_turn t JOIN {name}_ref USING (key) LEFT JOIN (SELECT key, quantile_cont(e, 95e-2) AS e
    FROM {name}_err WHERE NOT ref GROUP BY 1) w USING (key))"""


def psi_sql(name: str, key: str, bins: int) -> str:
    """Stability index of the other values in ``ev`` against the marked ones."""
    probs = ", ".join(f"{i / bins!r}" for i in range(1, bins))
    return f"""{name}_q AS (SELECT {key} AS key, quantile_cont(value, [{probs}]) AS edges FROM ev
  WHERE ref GROUP BY 1),
{name}_c AS (SELECT key, len(list_filter(edges, lambda e: e <= value)) AS bin,
    count(*) FILTER (ref) AS r, count(*) FILTER (NOT ref) AS c
  FROM ev JOIN {name}_q q ON q.key = ev.{key} GROUP BY 1, 2),
{name}_t AS (SELECT key, sum(r) AS rn, sum(c) AS cn FROM {name}_c GROUP BY 1),
{name}_p AS (SELECT key, coalesce(r, 0) / rn::DOUBLE + 1e-6 AS pr, coalesce(c, 0) / cn::DOUBLE + 1e-6 AS pc
  FROM (SELECT key, rn, cn, bin FROM {name}_t, range(0, {bins}) AS g(bin)) LEFT JOIN {name}_c USING (key, bin)),
{name} AS (SELECT key, sum((pc - pr) * ln(pc / pr)) AS psi FROM {name}_p GROUP BY 1)"""


#: Settings of the evidence on users, of whom each has few events.
USER_SPLITS, USER_WAVES, USER_BINS = 39, 6, 4


def user_evidence(t: Tables) -> DataFrame:
    """Six signals per user window, each computed from the user's events."""
    from plumbline.operators import metrics, reference_model, two_sample
    from plumbline.session import materialize

    # users lie together, so a task holds few of them; a busy one is cut by its events
    ev = materialize(t.spark, event_vectors(t).drop("event_type").repartitionByRange(
        "user_id", F.xxhash64("event_id")).sortWithinPartitions("user_id"), "user-events")
    test = two_sample.two_sample_test(ev, ["user_id"], "event_id", "x", F.col("ref"), dim=2,
                                      features=USER_WAVES, replicates=USER_SPLITS)
    models = reference_model.fit_reference(ev.where("ref"), ["user_id"], "x", dim=2, rank=1, version="1")
    errors = reference_model.window_errors(ev.where("not ref"), models, ["user_id"], "x", dim=2)
    psi = metrics.population_stability(ev, ["user_id"], "value", F.col("ref"), USER_BINS)
    facts = test.select("user_id", "significant").join(errors.select(
        "user_id", "uae_above_p99"), "user_id", "left").join(psi.select("user_id", "psi"), "user_id", "left")
    s = F.col("trend_status")
    return user_windows(t).join(facts, "user_id").select(
        "user_id", "window_start", "window_end", "metric_value", "ewma_value", "cusum_value",
        "trend_status", "drift_pattern", "n_points",
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("window_id"),
        F.concat(F.lit("model_"), F.col("user_id").cast("string")).alias("model_id"),
        F.lit(None).cast("string").alias("threshold_id"),
        s.isin("EWMA_ALERT", "BOTH_ALERT").alias("ewma_alert"),
        s.isin("CUSUM_ALERT", "BOTH_ALERT").alias("cusum_alert"),
        F.coalesce(F.col("psi") >= 0.25, F.lit(False)).alias("psi_high"),
        F.coalesce("significant", F.lit(False)).alias("bbsd_significant"),
        F.coalesce("uae_above_p99", F.lit(False)).alias("uae_above_p99"),
        (F.col("metric_value") < 10).alias("labeled_metric_confirmed"))


USER_EVIDENCE = f"""{USER_SCAN}, {VECTORS},
{two_sample_sql("test", "ev", "user_id", "event_id", 2, USER_WAVES, USER_SPLITS)},
{reference_sql("model", "user_id")},
{psi_sql("stable", "user_id", USER_BINS)},
signals AS (
  SELECT w.*, 'user_' || w.user_id AS window_id, 'model_' || w.user_id AS model_id,
    trend_status IN ('EWMA_ALERT', 'BOTH_ALERT') AS ewma_alert,
    trend_status IN ('CUSUM_ALERT', 'BOTH_ALERT') AS cusum_alert, coalesce(psi >= 25e-2, false) AS psi_high,
    coalesce(p_value <= 5e-2, false) AS bbsd_significant, coalesce(uae_above_p99, false) AS uae_above_p99,
    metric_value < 10 AS labeled_metric_confirmed
  FROM windows w JOIN test ON test.key = w.user_id LEFT JOIN model ON model.key = w.user_id
  LEFT JOIN stable ON stable.key = w.user_id),
evidence AS (
  SELECT *, CAST(ewma_alert AS INT) + CAST(cusum_alert AS INT) + CAST(psi_high AS INT)
    + CAST(bbsd_significant AS INT) + CAST(uae_above_p99 AS INT)
    + CAST(labeled_metric_confirmed AS INT) AS signals FROM signals)"""


def incident_rows(t: Tables) -> DataFrame:
    from plumbline.operators.governance import open_incidents
    from plumbline.session import materialize

    # windows are stored before incidents refer to them
    ev = materialize(t.spark, user_evidence(t), "windows")
    windows = ev.select("window_id", "drift_pattern", "model_id", "threshold_id")
    return open_incidents(windows, ev.select("window_id", *rules.SIGNALS), stamp())


INCIDENTS = f"""{USER_EVIDENCE},
incidents AS (
  SELECT 'inc_' || substr(sha256(window_id || '|{STAMP}'), 1, 12) AS incident_id,
    CASE WHEN signals >= 5 THEN 'P0_BLOCKED' WHEN signals >= 3 THEN 'P1_INCIDENT'
      WHEN signals >= 2 THEN 'P2_REVIEW' ELSE 'INFO' END AS priority,
    drift_pattern, window_id AS affected_window_id, model_id FROM evidence WHERE signals >= 2)"""


# --- dataset files: documents ----------------------------------------------------------------

def files(t: Tables) -> DataFrame:
    """One manifest row per document; the dataset is the language."""
    number = F.substring("source", 4, 9).cast("int")
    quality = t.labels.select("doc_id", "quality")
    return t.documents.join(quality, "doc_id", "left").select(
        "doc_id", F.concat(F.lit("docs_"), "lang").alias("dataset_id"), "source",
        F.concat_ws("/", "source", F.concat(F.lpad(F.col("doc_id").cast("string"), 9, "0"),
                                            F.lit(".txt"))).alias("relative_path"),
        F.sha2("text", 256).alias("sha256"),
        F.when(number < 12, "train").when(number < 16, "validation").otherwise("test"
                                                                              ).alias("split"),
        F.when(F.col("quality") == 0, "anomaly").otherwise("normal").alias("label"),
        F.when(F.col("quality") == 0, F.concat(F.lit("mask_"), F.col("doc_id").cast("string"))
               ).alias("mask_path"),
        F.concat(F.lit("len"), F.col("n_chars").cast("string")).alias("source_image_id"),
        rules.normalized_name(F.concat("source", F.lit("/"), F.upper("lang"), F.lit("-A_"),
                                       F.floor(F.col("n_chars") / 50).cast("string"),
                                       F.lit(".txt"))).alias("name"))


FILES = """files AS (
  SELECT d.doc_id, 'docs_' || d.lang AS dataset_id, d.source,
    d.source || '/' || lpad(CAST(d.doc_id AS VARCHAR), 9, '0') || '.txt' AS relative_path,
    sha256(d.text) AS sha256,
    CASE WHEN CAST(substr(d.source, 4) AS INT) < 12 THEN 'train'
      WHEN CAST(substr(d.source, 4) AS INT) < 16 THEN 'validation' ELSE 'test' END AS split,
    CASE WHEN l.quality = 0 THEN 'anomaly' ELSE 'normal' END AS label,
    CASE WHEN l.quality = 0 THEN 'mask_' || d.doc_id END AS mask_path,
    'len' || d.n_chars AS source_image_id, d.lang || 'a' || (d.n_chars // 50) AS name
  FROM documents d LEFT JOIN labels l USING (doc_id))"""


# --- images: embeddings as 8 x 8 maps --------------------------------------------------------

def images(t: Tables) -> DataFrame:
    """Vectors as grey 8 x 8 byte images."""
    from plumbline.operators.images import grey_images

    return grey_images(t.embeddings, "vec_id", "embedding", 8, 8)


IMAGES = """px AS (
  SELECT vec_id, label, i, embedding[i]::DOUBLE AS v, (i - 1) // 8 AS y, (i - 1) % 8 AS x
  FROM embeddings, unnest(range(1, 65)) AS r(i)),
span AS (SELECT vec_id, min(v) AS lo, max(v) AS hi FROM px GROUP BY 1),
img AS (
  SELECT px.vec_id AS image_id, label, y, x, v,
    CASE WHEN hi > lo THEN CAST(floor((v - lo) * 255e0 / (hi - lo)) AS INT) ELSE 0 END AS p
  FROM px JOIN span USING (vec_id))"""


def maps_and_masks(t: Tables) -> DataFrame:
    """Score map and truth mask per vector; the model key is the label."""
    e = F.col("embedding")
    both = F.zip_with(e, F.reverse(e), lambda a, b: F.when(
        a.cast("double") + b.cast("double") >= 0.2, 1).otherwise(0))
    return t.embeddings.select("vec_id", F.col("label").alias("model"), e.alias("scores"),
                               both.alias("mask"))


PIXELS = """pixels AS (
  SELECT vec_id, label AS model, embedding[i]::DOUBLE AS v,
    CASE WHEN embedding[i]::DOUBLE + embedding[65 - i]::DOUBLE >= 2e-1 THEN 1 ELSE 0 END AS m
  FROM embeddings, unnest(range(1, 65)) AS r(i))"""


# --- model registry: orders ------------------------------------------------------------------

# fixed values: which registry state an order stands for
OPEN_STATES = {"1-URGENT": "ACTIVE_BENCHMARK", "2-HIGH": "VALIDATED", "3-MEDIUM": "CANDIDATE",
               "4-NOT SPECIFIED": "ACTIVE_COMPANY_PILOT", "5-LOW": "REJECTED"}


def models(t: Tables) -> DataFrame:
    """Orders as registered models; a customer is a registry."""
    state = F.lit(None).cast("string")
    for priority, name in OPEN_STATES.items():
        state = F.when(F.col("o_orderpriority") == priority, name).otherwise(state)
    key = F.col("o_orderkey").cast("string")
    return t.orders.select(
        F.concat(F.lit("r"), F.col("o_custkey").cast("string")).alias("registry_id"),
        F.concat(F.lit("m"), key).alias("model_id"),
        F.when(F.col("o_orderstatus") == "F", "RETIRED").when(
            F.col("o_orderstatus") == "P", "CANDIDATE").otherwise(state).alias("status"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.concat(F.lit("t"), key)
               ).alias("threshold_id"),
        F.when(F.col("o_totalprice") >= 50000, F.concat(F.lit("metrics/"), key)
               ).alias("metrics_path"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"), "o_totalprice",
        "o_orderkey")


_STATES = " ".join(f"WHEN '{p}' THEN '{s}'" for p, s in OPEN_STATES.items())
MODELS = f"""models AS (
  SELECT 'r' || o_custkey AS registry_id, 'm' || o_orderkey AS model_id,
    CASE WHEN o_orderstatus = 'F' THEN 'RETIRED' WHEN o_orderstatus = 'P' THEN 'CANDIDATE'
      ELSE CASE o_orderpriority {_STATES} END END AS status,
    CASE WHEN o_orderpriority <> '5-LOW' THEN 't' || o_orderkey END AS threshold_id,
    CASE WHEN o_totalprice >= 50000 THEN 'metrics/' || o_orderkey END AS metrics_path,
    o_orderdate AS created_at, o_totalprice, o_orderkey
  FROM orders)"""
