"""Dataset, join and set queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import rules
from plumbline.operators import audit, metrics
from plumbline.plans import bindings as b
from plumbline.plans.registry import Tables, query
from plumbline.session import materialize, scratch_path
from plumbline.sources.runs import read_runs
from plumbline.sources.versions import VersionedTable
from plumbline.sources import files as source
from plumbline.sources import sinks


@query(f"""WITH {b.FILES}
SELECT dataset_id, count(*) AS images_total,
  count(*) FILTER (split = 'train' AND label = 'normal') AS train_normal,
  count(*) FILTER (split = 'validation' AND label = 'normal') AS validation_normal,
  count(*) FILTER (split = 'validation' AND label = 'anomaly') AS validation_anomaly,
  count(*) FILTER (split = 'test' AND label = 'normal') AS test_normal,
  count(*) FILTER (split = 'test' AND label = 'anomaly') AS test_anomaly,
  count(mask_path) AS masks FROM files GROUP BY 1""")
def split_counts(t: Tables):
    return audit.split_counts(b.files(t), ["dataset_id"])


_LEAKS = """leaks AS (
  SELECT dataset_id, kind, key, array_to_string(list_sort(list(DISTINCT split)), ',') AS splits
  FROM (SELECT dataset_id, split, 'content_hash' AS kind, sha256 AS key FROM files
    UNION ALL SELECT dataset_id, split, 'source_identity', source_image_id FROM files
    UNION ALL SELECT dataset_id, split, 'normalized_name', name FROM files)
  GROUP BY 1, 2, 3 HAVING count(DISTINCT split) > 1)"""


@query(f"WITH {b.FILES}, {_LEAKS} SELECT * FROM leaks")
def leakage_audit(t: Tables):
    out = audit.leakage_audit(b.files(t), "dataset_id", "sha256", "source_image_id", "name")
    return out.withColumn("splits", F.array_join("splits", ","))


@query(f"""WITH {b.FILES}, {_LEAKS},
c AS (SELECT f.dataset_id, count(*) FILTER (kind = 'content_hash') AS hash_collisions,
  count(*) FILTER (kind = 'source_identity') AS source_collisions,
  count(*) FILTER (kind = 'normalized_name') AS name_collisions
  FROM (SELECT DISTINCT dataset_id FROM files) f LEFT JOIN leaks USING (dataset_id) GROUP BY 1)
SELECT *, CASE WHEN hash_collisions > 0 OR source_collisions > 0 THEN 'FAIL' ELSE 'PASS' END
  AS status FROM c""")
def leakage_status(t: Tables):
    files = b.files(t)
    found = audit.leakage_audit(files, "dataset_id", "sha256", "source_image_id", "name")
    return audit.leakage_status(files, found, "dataset_id")


@query(f"""WITH {b.FILES}, k AS (SELECT DISTINCT split, source_image_id FROM files)
SELECT a.split AS split_a, z.split AS split_b, a.source_image_id
FROM k a JOIN k z ON a.source_image_id = z.source_image_id
WHERE (a.split, z.split) IN (('train', 'validation'), ('train', 'test'), ('validation', 'test'))""")
def shared_between_splits(t: Tables):
    return audit.shared_between_splits(b.files(t), "source_image_id")


_FINGER = f"""hashed AS (SELECT dataset_id, sha256('{{"label":"' || label || '","mask_path":'
    || CASE WHEN mask_path IS NULL THEN 'null' ELSE '"' || mask_path || '"' END
    || ',"relative_path":"' || relative_path || '","sha256":"' || sha256 || '","split":"'
    || split || '"}}') AS h FROM files),
counted AS (SELECT dataset_id, h, count(*) AS n FROM hashed GROUP BY 1, 2),
leaves AS (SELECT dataset_id, h[:8] AS place, sum(n) AS n, sha256(string_agg(h || ':' || n, ','
  ORDER BY h || ':' || n)) AS t FROM counted GROUP BY 1, 2),
nodes AS (SELECT dataset_id, place[:4] AS place, sum(n) AS n, sha256(string_agg(t, ',' ORDER BY t)) AS t
  FROM leaves GROUP BY 1, 2),
finger AS (SELECT dataset_id, CAST(sum(n) AS BIGINT) AS n_rows, sha256(dataset_id || '|'
  || CAST(sum(n) AS BIGINT) || '|' || sha256(string_agg(t, ',' ORDER BY t))) AS fingerprint
  FROM nodes GROUP BY 1)"""
_FINGER_COLS = ["relative_path", "sha256", "split", "label", "mask_path"]


@query(f"WITH {b.FILES}, {_FINGER} SELECT * FROM finger")
def dataset_fingerprint(t: Tables):
    return audit.set_fingerprint(b.files(t), ["dataset_id"], _FINGER_COLS, ["dataset_id"])


@query("""SELECT event_id, sha256(replace(props, ' ', '')) AS config_hash FROM events""")
def config_hash(t: Tables):
    return t.events.select("event_id", audit.config_hash(F.col("props")).alias("config_hash"))


_SPLIT = """g AS (SELECT source, sha256('42:' || source) AS h FROM documents GROUP BY 1),
r AS (SELECT source, row_number() OVER (ORDER BY h) AS i, count(*) OVER () AS n FROM g),
assigned AS (SELECT source, CASE WHEN i <= CASE WHEN n > 1
  THEN least(greatest(1, round_even(n * 25e-2, 0)), n - 1) ELSE 1 END
  THEN 'validation' ELSE 'train' END AS assigned_split FROM r)"""


@query(f"""WITH {_SPLIT}
SELECT doc_id, assigned_split FROM documents JOIN assigned USING (source)""")
def group_split(t: Tables):
    return audit.group_split(t.documents.select("doc_id", "source"), "source", 0.25, 42).select(
        "doc_id", "assigned_split")


@query(f"WITH {_SPLIT} SELECT source FROM assigned WHERE assigned_split = 'train'")
def train_groups(t: Tables):
    """All groups except the validation groups, as a set difference."""
    rows = audit.group_split(t.documents.select("source"), "source", 0.25, 42)
    chosen = rows.where("assigned_split = 'validation'").select("source").distinct()
    return rows.select("source").distinct().exceptAll(chosen)


_DEDUPE = """marked AS (SELECT doc_id, sha256, CASE WHEN row_number() OVER (PARTITION BY sha256
  ORDER BY relative_path) > 1 THEN 'DUPLICATE_INPUT' END AS error_code FROM files)"""


@query(f"WITH {b.FILES}, {_DEDUPE} SELECT doc_id, sha256, error_code FROM marked")
def dedupe_first(t: Tables):
    return audit.dedupe_first(b.files(t).select("doc_id", "sha256", "relative_path"), "sha256",
                              "relative_path").select("doc_id", "sha256", "error_code")


_BATCH = """batch AS (
  SELECT f.doc_id, n_chars, CASE WHEN n_chars < 100 THEN 'IMAGE_INVALID' END AS error_code
  FROM files f JOIN documents d USING (doc_id) WHERE n_chars < 100
  UNION ALL SELECT f.doc_id, n_chars, CASE WHEN row_number() OVER (PARTITION BY sha256
    ORDER BY relative_path) > 1 THEN 'DUPLICATE_INPUT' END
  FROM files f JOIN documents d USING (doc_id) WHERE n_chars >= 100)"""


def _batch(t: Tables):
    """Short documents count as broken files and fail before copies are looked for."""
    rows = t.documents.select(
        "doc_id", "n_chars", F.sha2("text", 256).alias("sha256"),
        F.concat_ws("/", "source", F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("path"))
    broken = rows.where("n_chars < 100").select("doc_id", "n_chars", F.lit("IMAGE_INVALID").alias(
        "error_code"))
    good = audit.dedupe_first(rows.where("n_chars >= 100"), "sha256", "path")
    return audit.batch_result(good.select("doc_id", "n_chars", "error_code"), broken)


@query(f"WITH {b.FILES}, {_BATCH} SELECT doc_id, n_chars, error_code FROM batch")
def batch_result(t: Tables):
    return _batch(t)


@query(f"""WITH {b.FILES}, {_BATCH}
SELECT coalesce(error_code, 'COMPLETED') AS result, count(*) AS n FROM batch GROUP BY 1""")
def batch_summary(t: Tables):
    return audit.batch_summary(_batch(t))


@query(f"""WITH {b.FILES}
SELECT doc_id, sha256 IN (SELECT sha256 FROM files WHERE split = 'train') AS seen
FROM files WHERE split = 'test'""")
def seen_before(t: Tables):
    files = b.files(t).select("doc_id", "sha256", "split")
    test, train = files.where("split = 'test'"), files.where("split = 'train'").select("sha256")
    again = test.join(train, "sha256", "left_semi").select("doc_id", F.lit(True).alias("seen"))
    new = test.join(train, "sha256", "left_anti").select("doc_id", F.lit(False).alias("seen"))
    return again.unionByName(new)


@query("""SELECT l_returnflag, count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS key_sum
FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')
GROUP BY 1""")
def orphans(t: Tables):
    parents = t.orders.where("o_orderstatus = 'F'").select("o_orderkey")
    return audit.orphans(t.lineitem, "l_orderkey", parents, "o_orderkey").groupBy(
        "l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum("l_orderkey").alias("key_sum"))


@query("""WITH m AS (SELECT 'b' || item_id AS k FROM benchmark)
SELECT doc_id, coalesce(m1.k, m2.k) AS mask_path FROM documents
LEFT JOIN m m1 ON m1.k = 'b' || doc_id LEFT JOIN m m2 ON m2.k = 'b' || (n_chars // 200)""")
def pair_masks(t: Tables):
    masks = t.benchmark.select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("k"))
    return audit.pair_masks(
        t.documents.select("doc_id", "n_chars"), masks, "k",
        F.concat(F.lit("b"), F.col("doc_id").cast("string")),
        F.concat(F.lit("b"), F.floor(F.col("n_chars") / 200).cast("string"))).select(
        "doc_id", "mask_path")


_AHASH = """bits AS (SELECT vec_id, i, CASE WHEN embedding[i]::DOUBLE >=
    list_sum(list_transform(embedding, lambda x: x::DOUBLE)) / 64 THEN 1 ELSE 0 END AS bit
  FROM embeddings, unnest(range(1, 65)) AS r(i)),
ahash AS (SELECT vec_id, string_agg(d, '' ORDER BY g) AS hash FROM (
  SELECT vec_id, (i - 1) // 4 AS g, substr('0123456789abcdef',
    1 + sum(bit * CAST(pow(2, 3 - (i - 1) % 4) AS INT))::INT, 1) AS d FROM bits GROUP BY 1, 2)
  GROUP BY 1)"""


@query(f"WITH {_AHASH} SELECT vec_id, hash FROM ahash")
def average_hash(t: Tables):
    return t.embeddings.select("vec_id", audit.average_hash(F.col("embedding"), 8, 8).alias("hash"))


# 2 x 2 block means of an 8 x 8 map, 16 bits
_BHASH = """blocks AS (
  SELECT vec_id, ((i - 1) // 16) * 4 + ((i - 1) % 8) // 2 AS k, avg(embedding[i]::DOUBLE) AS v
  FROM embeddings, unnest(range(1, 65)) AS r(i) GROUP BY 1, 2),
bbits AS (SELECT vec_id, k, CASE WHEN v >= avg(v) OVER (PARTITION BY vec_id) THEN 1 ELSE 0 END
  AS bit FROM blocks),
bhash AS (SELECT vec_id, string_agg(d, '' ORDER BY g) AS hash FROM (
  SELECT vec_id, k // 4 AS g, substr('0123456789abcdef',
    1 + sum(bit * CAST(pow(2, 3 - k % 4) AS INT))::INT, 1) AS d FROM bbits GROUP BY 1, 2)
  GROUP BY 1),
hgroups AS (SELECT hash, min(vec_id) AS item, count(*) AS copies FROM bhash GROUP BY 1)"""


def _block_hashes(t: Tables):
    return t.embeddings.select(
        "vec_id", audit.average_hash(F.col("embedding"), 8, 8, size=4).alias("hash"))


@query(f"WITH {_BHASH} SELECT * FROM hgroups")
def hash_groups(t: Tables):
    return audit.hash_groups(_block_hashes(t), "vec_id", "hash")


@query(f"""WITH {_BHASH}
SELECT a.hash AS hash_a, z.hash AS hash_b, a.item AS item_a, z.item AS item_b,
  a.copies AS copies_a, z.copies AS copies_b,
  bit_count(xor(CAST('0x' || a.hash AS BIGINT), CAST('0x' || z.hash AS BIGINT)))::INT AS distance
FROM hgroups a JOIN hgroups z ON a.hash < z.hash
WHERE bit_count(xor(CAST('0x' || a.hash AS BIGINT), CAST('0x' || z.hash AS BIGINT))) <= 2""")
def near_duplicates(t: Tables):
    groups = audit.hash_groups(_block_hashes(t), "vec_id", "hash")
    return audit.near_duplicates(groups, max_distance=2, blocks=4, digits=4)


@query("""SELECT rule, violations FROM (
  SELECT count(*) FILTER (NOT l_quantity <= 45) AS quantity_bound,
    count(*) FILTER (NOT l_discount BETWEEN 1e-2 AND 9e-2) AS discount_range,
    count(*) FILTER (l_returnflag NOT IN ('A', 'N')) AS returnflag_allowed,
    count(*) FILTER (l_shipdate IS NULL) AS shipdate_present,
    count(*) FILTER (NOT l_tax > 0) AS tax_positive FROM lineitem)
UNPIVOT (violations FOR rule IN (quantity_bound, discount_range, returnflag_allowed,
  shipdate_present, tax_positive))""")
def contract_violations(t: Tables):
    return audit.contract_violations(t.lineitem, {
        "quantity_bound": F.col("l_quantity") <= 45,
        "discount_range": F.col("l_discount").between(0.01, 0.09),
        "returnflag_allowed": F.col("l_returnflag").isin("A", "N"),
        "shipdate_present": F.col("l_shipdate").isNotNull(),
        "tax_positive": F.col("l_tax") > 0})


@query("""WITH f AS (SELECT CASE lang WHEN 'en' THEN 'png' WHEN 'fr' THEN 'jpg'
  WHEN 'de' THEN 'txt' ELSE 'tiff' END AS suffix FROM documents)
SELECT suffix, count(*) AS images FROM f WHERE suffix <> 'txt' GROUP BY 1""")
def inventory(t: Tables):
    ending = F.when(F.col("lang") == "en", "PNG").when(F.col("lang") == "fr", "jpg").when(
        F.col("lang") == "de", "txt").otherwise("Tiff")
    paths = t.documents.select(F.concat_ws(".", F.col("doc_id").cast("string"), ending).alias("p"))
    return source.inventory(paths, "p")


@query(r"""WITH p AS (SELECT page_id, regexp_replace(url, '^https?://[^/]+/', '') AS rest FROM pages),
q AS (SELECT page_id, string_split(rest, '/')[1] AS folder, CASE WHEN rest LIKE 'en/%'
  THEN 'train/good/' ELSE 'test/' || string_split(rest, '/')[1] || '/' END
  || string_split(regexp_replace(rest, '/+$', ''), '/')[-1] AS path FROM p),
s AS (SELECT *, string_split(path, '/')[-1] AS name FROM q)
SELECT page_id, CASE WHEN folder = 'en' THEN 'train' ELSE 'test' END AS split,
  CASE WHEN folder = 'en' THEN 'normal' ELSE 'anomaly' END AS label,
  CASE WHEN folder <> 'en' THEN folder END AS defect_type,
  CASE WHEN regexp_matches(name, '^.+\.[^.]+$') THEN regexp_replace(name, '\.[^.]+$', '')
    ELSE name END AS source_image_id FROM s""")
def path_layout(t: Tables):
    rest = F.regexp_replace("url", r"^https?://[^/]+/", "")
    folder = F.get(F.split(rest, "/"), F.lit(0))
    path = F.concat(F.when(folder == "en", "train/good/").otherwise(
        F.concat(F.lit("test/"), folder, F.lit("/"))), rules.file_name(rest))
    rows = t.pages.select("page_id", path.alias("relative_path"))
    return rows.select("page_id", *[c.alias(n) for n, c in source.layout_columns(
        F.col("relative_path")).items()])


@query("""SELECT 'mvtec_ad_' || lang AS dataset_id, 'MVTec Anomaly Detection Dataset' AS source_name,
  lang AS category, false AS commercial_use, count(*) AS n FROM documents GROUP BY lang""")
def dataset_provenance(t: Tables):
    """Each language, whichever there are, as one category of the same folder layout."""
    out = source.with_provenance(t.documents.select("doc_id", "lang"), "mvtec_ad", F.col("lang"))
    return out.groupBy("dataset_id", "source_name", "category", "commercial_use").agg(
        F.count(F.lit(1)).alias("n"))


@query(f"""WITH {b.FILES}
SELECT dataset_id, relative_path, sha256, split, label, true AS verified FROM files""")
def manifest_roundtrip(t: Tables):
    """Manifest rows written with their fingerprint, read back and verified."""
    rows = b.files(t).select(
        "dataset_id", "relative_path", "sha256", F.lit(8).alias("width"), F.lit(8).alias("height"),
        "label", "split", F.lit(None).cast("string").alias("defect_type"), "mask_path",
        "source_image_id")
    path = scratch_path(t.spark, "manifest")
    source.write_manifest(rows, path)
    schema = T.StructType([*rows.schema.fields, T.StructField("manifest_sha256", T.StringType())])
    back = source.read_manifest(t.spark, path, schema)
    return back.select("dataset_id", "relative_path", "sha256", "split", "label",
                       F.col("manifest_sha256").isNotNull().alias("verified"))


@query(f"""WITH {b.SCORED}
SELECT 'run_' || lang AS run_id, model_id, count(*) AS items, round(max(score), 6) AS top_score
FROM scored GROUP BY lang, model_id""")
def run_artifacts(t: Tables):
    """One JSON record per run folder, read back across runs with the run id from the path."""
    rows = b.scored(t).groupBy("lang", "model_id").agg(
        F.count(F.lit(1)).alias("items"), F.round(F.max("score"), 6).alias("top_score")).select(
        F.concat(F.lit("run_"), "lang").alias("run"), "model_id", "items", "top_score")
    path = scratch_path(t.spark, "runs")
    rows.write.partitionBy("run").json(path)
    schema = rows.drop("run").schema
    found = source.read_run_artifacts(t.spark, f"{path}/*/*.json", schema)
    return found.withColumn("run_id", F.regexp_replace("run_id", "^run=", ""))


@query(f"""WITH {b.SCORED}
SELECT 'run=' || 'run_' || lang AS run_id, model_id, count(*) AS items, round(max(score), 6) AS top_score
FROM scored GROUP BY lang, model_id""")
def run_artifacts_source(t: Tables):
    """The same records through the data source of run folders, a partition for each."""
    rows = b.scored(t).groupBy("lang", "model_id").agg(
        F.count(F.lit(1)).alias("items"), F.round(F.max("score"), 6).alias("top_score")).select(
        F.concat(F.lit("run_"), "lang").alias("run"), "model_id", "items", "top_score")
    path = scratch_path(t.spark, "runs")
    rows.write.partitionBy("run").json(path)
    return read_runs(t.spark, path, rows.drop("run").schema)


@query(f"""WITH {b.SCORED}
SELECT doc_id AS item_id, label AS true_label, CAST(score >= 5e-1 AS INT) AS predicted_label,
  round(score, 6) AS raw_score, 5e-1 AS threshold, CASE WHEN label = 1 AND score >= 5e-1
  THEN 'true_positive' WHEN label = 1 THEN 'false_negative' WHEN score >= 5e-1
  THEN 'false_positive' ELSE 'true_negative' END AS outcome, model_id FROM scored""")
def prediction_table(t: Tables):
    """Per-item predictions written as CSV and read back."""
    score = F.col("score")
    rows = b.scored(t).select(
        F.col("doc_id").alias("item_id"), F.col("label").alias("true_label"),
        (score >= 0.5).cast("int").alias("predicted_label"), F.round(score, 6).alias("raw_score"),
        F.lit(0.5).alias("threshold"),
        rules.outcome(F.col("label"), score, F.lit(0.5)).alias("outcome"), "model_id")
    path = scratch_path(t.spark, "predictions")
    rows.write.option("header", "true").csv(path)
    return t.spark.read.schema(rows.schema).option("header", "true").csv(path)


def _analyses(t: Tables):
    """Events as nested analysis records."""
    ev = t.events
    name = F.concat(F.when(F.col("event_type") == "error", "=").otherwise(""), "event_type",
                    F.lit(".png"))
    return ev.select(
        F.concat(F.lit("ana_"), F.col("event_id").cast("string")).alias("analysis_id"),
        F.col("ts").cast("timestamp").alias("created_at"),
        F.struct(name.alias("filename"), F.sha2("props", 256).alias("sha256")).alias("source"),
        F.struct(F.when(F.col("value") >= 100, "ANOMALY").otherwise("NORMAL").alias("decision"),
                 F.when(F.col("value") >= 100, "P2").otherwise("P0").alias("review_priority"),
                 F.col("value").alias("raw_anomaly_score"),
                 F.lit(0.0).alias("anomaly_area_ratio"),
                 F.lit(0).alias("region_count")).alias("prediction"),
        F.when(F.col("event_type") != "view", F.struct(
            F.concat(F.lit("m_"), "event_type").alias("model_id"))).alias("model"),
        F.when(F.col("event_type") != "view", F.struct(
            F.concat(F.lit("t_"), "event_type").alias("threshold_id"))).alias("threshold"),
        F.struct(F.lit("PASS").alias("status")).alias("quality_gate"),
        F.struct((F.col("value") * 2).alias("total")).alias("timing_ms"))


_FLAT = """SELECT 'ana_' || event_id AS analysis_id, ts AS created_at,
  CASE WHEN event_type = 'error' THEN '''=' ELSE '' END || event_type || '.png' AS filename,
  sha256(props) AS sha256, CASE WHEN value >= 100 THEN 'ANOMALY' ELSE 'NORMAL' END AS decision,
  CASE WHEN value >= 100 THEN 'P2' ELSE 'P0' END AS review_priority, value AS raw_anomaly_score,
  0e0 AS anomaly_area_ratio, 0 AS region_count,
  CASE WHEN event_type <> 'view' THEN 'm_' || event_type ELSE '' END AS model_id,
  CASE WHEN event_type <> 'view' THEN 't_' || event_type ELSE '' END AS threshold_id,
  'PASS' AS quality_status, value * 2 AS total_latency_ms FROM events"""


@query(_FLAT)
def csv_report(t: Tables):
    """Flat report written as CSV and read back."""
    rows = _analyses(t)
    path = scratch_path(t.spark, "csv-report")
    sinks.write_csv_report(rows, path)
    back = t.spark.read.schema(sinks.flat_report(rows).schema).option("header", "true").option(
        "timestampFormat", sinks.TIMESTAMP_FORMAT).option(
        "emptyValue", "").option("nullValue", "~").csv(path)
    return back


@query(_FLAT)
def json_report(t: Tables):
    """Nested report written as JSON, read back and flattened."""
    rows = _analyses(t)
    path = scratch_path(t.spark, "json-report")
    sinks.write_json_report(rows, path)
    return sinks.flat_report(t.spark.read.schema(rows.schema).option(
        "timestampFormat", sinks.TIMESTAMP_FORMAT).json(path))


@query("SELECT event_id, user_id, event_type, value FROM events")
def append_events(t: Tables):
    """Two batches added to one audit table, purchases and then all other events; the first comes
    again, as after a lost answer, and changes nothing."""
    path = scratch_path(t.spark, "events-log")
    rows = t.events.select("event_id", "user_id", "event_type", "value")
    for batch, kind in enumerate(["event_type = 'purchase'", "NOT event_type <=> 'purchase'"]):
        sinks.append(rows.where(kind), path, "events", batch)
    sinks.append(rows.where("event_type = 'purchase'"), path, "events", 0)
    return VersionedTable(t.spark, path).read()


@query(f"""WITH {b.FILES}
SELECT dataset_id, count(*) AS images_total,
  count(*) FILTER (split = 'train' AND label = 'normal') AS train_normal,
  count(*) FILTER (split = 'validation' AND label = 'normal') AS validation_normal,
  count(*) FILTER (split = 'test' AND label = 'normal') AS test_normal,
  count(*) FILTER (split = 'test' AND label = 'anomaly') AS test_anomaly,
  'len_' || dataset_id AS model_id, TIMESTAMP '{b.STAMP}' AS created_at FROM files GROUP BY 1""")
def record_run(t: Tables):
    from plumbline.operators.governance import run_record

    files = b.files(t)
    counts = audit.split_counts(files, ["dataset_id"]).join(
        audit.set_fingerprint(files, ["dataset_id"], _FINGER_COLS, ["dataset_id"]), "dataset_id")
    out = run_record(counts, "dataset_id", F.concat(F.lit("len_"), "dataset_id"), F.lit("thr_1"),
                     F.col("fingerprint"), {"engine": "spark"}, b.stamp())
    return materialize(t.spark, out, "runs").drop(
        "run_id", "threshold_id", "dataset_manifest_sha256", "environment")


@query(f"""WITH {b.MODELS}, s(status) AS (VALUES ('CANDIDATE'), ('VALIDATED'), ('ACTIVE_BENCHMARK'),
  ('ACTIVE_COMPANY_PILOT'), ('RETIRED'), ('REJECTED'), ('UNUSED'))
SELECT s.status, count(model_id) AS n FROM s LEFT JOIN models USING (status) GROUP BY 1""")
def status_counts(t: Tables):
    return metrics.status_counts(b.models(t), "status", [*rules.LIFECYCLE, "UNUSED"])
