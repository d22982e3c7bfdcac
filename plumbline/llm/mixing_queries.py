"""Query of the source mixing."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.llm.mixing import mix_sources
from plumbline.llm.registry import query, table

_U = "('0x' || substr(md5({}), 1, 13))::BIGINT / 4503599627370496e0"
_COUNT_U = _U.format("'7|' || coalesce(doc_id::VARCHAR, '') || '|count'")
_PLACE_U = _U.format("'7|' || coalesce(doc_id::VARCHAR, '') || '|' || copy || '|place'")


@query("op7_mixing", f"""
WITH sizes AS (SELECT source, sum(length(coalesce(text, '')))::BIGINT AS size
  FROM documents GROUP BY source),
weights AS (SELECT source, size, CASE WHEN size > 0 THEN pow(size::DOUBLE, 5e-1) ELSE 0e0 END AS w
  FROM sizes),
total AS (SELECT sum(w ORDER BY source) AS w, sum(size)::DOUBLE AS s FROM weights),
rates AS (SELECT source, CASE WHEN size > 0 THEN weights.w / total.w * total.s / size ELSE 0e0 END
  AS rate FROM weights, total),
chance AS (SELECT source, rate, k, CASE WHEN rate > 0 THEN exp(k * ln(rate) - rate - lgamma(k + 1))
    WHEN k = 0 THEN 1e0 ELSE 0e0 END AS p
  FROM (SELECT source, rate, unnest(range(floor(rate + 12 * sqrt(rate) + 41)::BIGINT)) AS k FROM rates)),
steps AS (SELECT source, rate, sum(p) OVER (PARTITION BY source ORDER BY k) / sum(p) OVER (
    PARTITION BY source) AS c FROM chance),
drawn AS (SELECT doc_id, source, {_COUNT_U} AS u FROM documents),
counted AS (SELECT doc_id, d.source, rate, count(*) FILTER (c <= u) AS copies
  FROM drawn d JOIN steps s ON d.source IS NOT DISTINCT FROM s.source GROUP BY ALL)
SELECT doc_id, source, copies::INTEGER AS copies, copy::INTEGER AS copy, round(rate, 9) AS rate,
  {_PLACE_U} AS shuffle_key
FROM (SELECT *, unnest(range(copies)) AS copy FROM counted)""")
def op7_mixing(spark, folder):
    out = mix_sources(table(spark, folder, "documents"))
    return out.select("doc_id", "source", "_mix.copies", "_mix.copy",
                      F.round("_mix.rate", 9).alias("rate"), F.col("_mix.key").alias("shuffle_key"))
