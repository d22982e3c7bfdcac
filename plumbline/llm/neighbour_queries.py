"""Query of the nearest-neighbour search."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.llm.neighbours import nearest
from plumbline.llm.registry import query, table


@query("op8_neighbours", """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id,
    list_reduce(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]), lambda a, b: a + b)
      AS score
  FROM v q, v c WHERE q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id)
SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id
    ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s) WHERE rank <= 20""")
def op8_neighbours(spark, folder):
    return nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0, k=20)
