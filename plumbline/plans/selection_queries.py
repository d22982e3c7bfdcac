"""Selection and nearest-neighbour queries on embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import clusters, lifecycle, scoring, selection
from plumbline.plans import bindings as b
from plumbline.plans.registry import Tables, query, rounded

_PICKS = 8


def greedy_sql(where: str, k: int) -> str:
    """Greedy k-centre, one step after the other."""
    steps = [f"""u AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / n) AS v
  FROM (SELECT *, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n
    FROM embeddings WHERE {where})),
p1 AS (SELECT vec_id, v FROM u ORDER BY v[1] DESC, vec_id LIMIT 1),
d1 AS (SELECT u.vec_id, u.v, list_sum(list_transform(list_zip(u.v, p1.v),
  lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM u, p1 WHERE u.vec_id <> p1.vec_id)"""]
    for i in range(2, k + 1):
        steps.append(f"""p{i} AS (SELECT vec_id, v FROM d{i - 1} ORDER BY d DESC, vec_id LIMIT 1),
d{i} AS (SELECT a.vec_id, a.v, least(a.d, list_sum(list_transform(list_zip(a.v, p{i}.v),
  lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS d FROM d{i - 1} a, p{i}
  WHERE a.vec_id <> p{i}.vec_id)""")
    union = " UNION ALL ".join(f"SELECT {i} AS pick, vec_id FROM p{i}" for i in range(1, k + 1))
    return ",\n".join(steps) + f",\npicks AS ({union})"


@query(f"WITH {greedy_sql('true', _PICKS)} SELECT pick, vec_id FROM picks")
def diverse_top_k(t: Tables):
    return selection.diverse_top_k(t.embeddings, "vec_id", "embedding", _PICKS)


_DRIFT = "least(1e0, abs(embedding[1]::DOUBLE) * 4)"


@query(f"""WITH {greedy_sql(f"{_DRIFT} >= 3e-1", _PICKS)}
SELECT pick, 'lq_' || substr(sha256(vec_id || '|{b.STAMP}'), 1, 12) AS item_id,
  sha256('map/' || vec_id || '.png') AS image_sha256, 'map/' || vec_id || '.png' AS source_path,
  CASE WHEN {_DRIFT} >= 9e-1 THEN 'P0' WHEN {_DRIFT} >= 75e-2 THEN 'P1' WHEN {_DRIFT} >= 5e-1
    THEN 'P2' ELSE 'P3' END AS priority_bucket, 'drift_coreset' AS selection_reason,
  round({_DRIFT}, 6) AS drift_score
FROM picks JOIN embeddings USING (vec_id)""")
def select_candidates(t: Tables):
    rows = t.embeddings.select(
        "vec_id", "embedding", F.least(F.lit(1.0), F.abs(F.get("embedding", F.lit(0)).cast(
            "double")) * 4).alias("drift"),
        F.concat(F.lit("map/"), F.col("vec_id").cast("string"), F.lit(".png")).alias("source_path"))
    out = selection.select_candidates(rows, "vec_id", "embedding", "drift", _PICKS, b.stamp(), 0.3)
    return rounded(out.select("pick", "item_id", "image_sha256", "source_path", "priority_bucket",
                              "selection_reason", "drift_score"), "drift_score")


def _knn_sql(queries: str, bank: str, k: int) -> str:
    return f"""d AS (SELECT q.vec_id, sqrt(list_sum(list_transform(list_zip(q.embedding, n.embedding),
    lambda z: pow(z[1]::DOUBLE - z[2]::DOUBLE, 2)))) AS d
  FROM {queries} q, {bank} n),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d) AS i FROM d)
SELECT vec_id, round(avg(d), 6) AS score FROM r WHERE i <= {k} GROUP BY 1"""


_KNN = "WITH bank AS (SELECT * FROM embeddings WHERE label = 0), " + _knn_sql(
    "embeddings", "bank", 9)


def _bank(t: Tables):
    return t.embeddings.where("label = 0").select("vec_id", "embedding")


@query(_KNN)
def knn_score(t: Tables):
    out = scoring.knn_score(t.embeddings, _bank(t), "vec_id", "embedding")
    return rounded(out, "score")


@query(_KNN)
def knn_score_blocks(t: Tables):
    """The same scores from many small blocks."""
    out = scoring.knn_score(t.embeddings, _bank(t), "vec_id", "embedding", block_rows=150)
    return rounded(out, "score")


_SHIFTED = """WITH moved AS (SELECT vec_id, label, list_transform(embedding,
  lambda x: x::DOUBLE + 1000) AS embedding FROM embeddings),
bank AS (SELECT * FROM moved WHERE label = 0), """


@query(_SHIFTED + _knn_sql("moved", "bank", 9))
def knn_score_shifted(t: Tables):
    """Vectors that lie close together far from the origin."""
    moved = t.embeddings.withColumn("embedding", F.transform(
        "embedding", lambda x: x.cast("double") + 1000))
    out = scoring.knn_score(moved, moved.where("label = 0"), "vec_id", "embedding")
    return rounded(out, "score")


def _union_sql(groups: int, share: int, keep: int) -> str:
    """Greedy picks per hash group and then among all of them."""
    parts = []
    for g in range(groups):
        where = f"('0x' || substr(sha256(vec_id::VARCHAR), 1, 8))::BIGINT % {groups} = {g}"
        parts.append(f"g{g} AS (SELECT vec_id FROM (WITH {greedy_sql(where, share)} "
                     "SELECT * FROM picks))")
    union = " UNION ALL ".join(f"SELECT vec_id FROM g{g}" for g in range(groups))
    return ",\n".join(parts) + f""",
core AS ({union}),
kept AS (SELECT vec_id FROM (WITH {greedy_sql("vec_id IN (FROM core)", keep)} SELECT * FROM picks)),
bank AS (SELECT * FROM embeddings WHERE vec_id IN (FROM kept))"""


@query(f"WITH {_union_sql(2, 8, 8)}, {_knn_sql('embeddings', 'bank', 3)}")
def knn_score_thinned(t: Tables):
    """Scores against a core-set: greedy in two groups, then greedy on their union."""
    bank = selection.thin_bank(t.embeddings, "vec_id", "embedding", keep=8, groups=2)
    return rounded(scoring.knn_score(t.embeddings, bank, "vec_id", "embedding", k=3), "score")


@query("""WITH m AS (SELECT label, list(a ORDER BY i) AS m FROM (SELECT label, i, avg(embedding[i]::DOUBLE)
    AS a FROM embeddings, range(1, 65) AS r(i) GROUP BY 1, 2) GROUP BY 1),
d AS (SELECT vec_id, label, sqrt(list_sum(list_transform(list_zip(embedding, m),
    lambda z: pow(z[1]::DOUBLE - z[2], 2)))) AS d FROM embeddings JOIN m USING (label))
SELECT label, arg_min(vec_id, d) AS vec_id, round(min(d), 6) AS distance, count(*) AS members
FROM d GROUP BY 1""")
def group_medoids(t: Tables):
    """The vector nearest to the mean of each label."""
    rows = clusters.group_distances(t.embeddings, "vec_id", "label", "embedding", 64)
    return rounded(clusters.medoids(rows, "vec_id", "label"), "distance")


def _clustered(t: Tables):
    cols = {"critical": F.col("label") == 9, "disagreement": F.col("vec_id") % 7 == 0,
            "drift_score": F.col("vec_id") * 37 % 101 / 101.0,
            "uncertainty_score": F.col("vec_id") * 53 % 97 / 97.0}
    return clusters.clustered_candidates(t.embeddings, "vec_id", "embedding", dim=64, k=64,
                                         keep=[c.alias(n) for n, c in cols.items()])


@query()
def cluster_medoids(t: Tables):
    """Found clusters, their medoids and sizes; moving centres have no SQL form."""
    return clusters.medoids(_clustered(t), "vec_id")


@query()
def cluster_quota_selection(t: Tables):
    """A budget of 100 over found clusters, of which each sends one medoid."""
    return lifecycle.quota_selection(_clustered(t), "vec_id", "cluster", 100, distance="distance")
