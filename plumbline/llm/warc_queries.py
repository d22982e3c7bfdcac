"""Query of the WARC writer."""

from __future__ import annotations

from plumbline.llm.registry import query, table
from plumbline.llm.warc import archive_round_trip


@query("op9_warc", """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS size, sha1(payload) AS hex,
  max(page_id) OVER (PARTITION BY payload) AS last FROM p),
bits AS (SELECT page_id, size, last, list_transform(string_split(hex, ''), lambda x: strpos(
  '0123456789abcdef', x) - 1) AS n FROM d)
SELECT page_id, size AS payload_bytes, array_to_string(list_transform(range(32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(5), lambda j:
      ((n[1 + (i * 5 + j) // 4] >> (3 - (i * 5 + j) % 4)) & 1) << (4 - j)))::INTEGER, 1)), '')
    AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> last THEN last END AS refers_to
FROM bits""")
def op9_warc(spark, folder):
    return archive_round_trip(table(spark, folder, "pages"), shard_bytes=16 << 20,
                              file_bytes=4 << 20)
