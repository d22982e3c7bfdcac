"""Query of the line deduplication."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.llm.line_dedup import drop_repeated_lines
from plumbline.llm.registry import query, table


@query("op3_line_dedup", """
WITH lines AS (
  SELECT doc_id, generate_subscripts(parts, 1) AS pos, unnest(parts) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)),
keyed AS (SELECT *, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key
  FROM lines),
gone AS (SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key
  HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone.key IS NOT NULL) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (gone.key IS NULL), ''))
    AS kept_sha256
FROM keyed LEFT JOIN gone USING (key) GROUP BY doc_id""")
def op3_line_dedup(spark, folder):
    out = drop_repeated_lines(table(spark, folder, "documents"), min_docs=10, min_chars=1,
                              keep_first=False)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))
