"""Query of the conversation repair, with the damage it is measured on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.conversations import repair_report
from plumbline.llm.registry import query, table


def damaged(rows: DataFrame) -> tuple[DataFrame, Column]:
    """Rows dropped, emptied, cut, repeated or given another role, by a hash; and their copies."""
    blank = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"),
                    F.coalesce(F.col("turn").cast("string"), blank))
    kind, text = F.crc32(name) % 20, F.coalesce("text", blank)
    there = kind != 0
    out = rows.select(
        "conv_id", F.when(there, F.col("turn")).alias("turn"),
        F.when(kind == 4, F.lit("user")).when(there, F.col("role")).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(text, "[.!?]", "")).when(
            there, text).alias("text"), F.when(kind == 3, 2).when(there, 1).otherwise(0).alias("copies"))
    return out, F.col("copies")


_CRC32 = """list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(name, ''),
    lambda c: ascii(c)::BIGINT)), lambda crc, c: list_reduce(list_prepend(xor(crc, c), range(8)),
    lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END))"""


# Rows go forward one by one; per conversation and state of the grammar (0 nothing, 1 system, 2 user,
# 3 assistant) the cheapest and then the ASCII-least edits are kept.
@query("op12_conversation_repair", rf"""
WITH RECURSIVE named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
hit AS (SELECT *, xor({_CRC32}, 4294967295) % 20 AS kind FROM named),
rows AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END
      AS text FROM hit, range(CASE WHEN kind = 3 THEN 2 ELSE 1 END) WHERE kind <> 0),
ordered AS (SELECT *, row_number() OVER (
    PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM rows),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth,
    rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS stem FROM ordered),
marked AS (SELECT *, CASE WHEN stem = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate'
    WHEN right(stem, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'none' END AS fault,
    role[1] AS initial, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM placed),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n
  FROM marked GROUP BY conv_id),
dp AS (SELECT conv_id, 0::BIGINT AS i, n, x.q, x.cost, x.audit, x.lines FROM counts,
    (VALUES (0, 0, '', []::VARCHAR[]), (2, 3, 'I', ['user:']), (3, 6, 'II', ['user:', 'assistant:']))
      AS x(q, cost, audit, lines)
  UNION ALL
  SELECT conv_id, i, n, q, cost, audit, lines FROM (
    SELECT m.conv_id, m.i, m.n, x.q, m.cost + 3 * x.puts AS cost, m.audit || repeat('I', x.puts) AS audit,
      m.lines || CASE WHEN x.puts = 0 THEN [] WHEN m.q = 2 THEN ['assistant:', 'user:'][:x.puts]
        ELSE ['user:', 'assistant:'][:x.puts] END AS lines
    FROM (
      SELECT d.conv_id, r.i, d.n, e.q, d.cost + e.cost AS cost, d.audit || e.edit AS audit,
        d.lines || CASE e.edit WHEN 'D' THEN [] WHEN 'K' THEN [r.role || ':' || r.text]
          ELSE [CASE e.q WHEN 2 THEN 'user:' ELSE 'assistant:' END || r.text] END AS lines
      FROM dp d JOIN marked r ON r.conv_id IS NOT DISTINCT FROM d.conv_id AND r.i = d.i + 1,
        LATERAL (SELECT d.q AS q, 4 AS cost, 'D' AS edit UNION ALL
          SELECT CASE d.q WHEN 2 THEN 3 ELSE 2 END, 3 + 3 * (r.fault = 'truncated')::INTEGER, 'R'
            WHERE r.fault IN ('none', 'truncated') UNION ALL
          SELECT CASE r.initial WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END,
            3 * (r.fault = 'truncated')::INTEGER, 'K' WHERE r.fault IN ('none', 'truncated') AND (
              r.initial = 's' AND d.q = 0 OR r.initial = 'u' AND d.q <> 2
              OR r.initial = 'a' AND d.q = 2)) e) m,
      LATERAL (SELECT m.q AS q, 0 AS puts UNION ALL SELECT CASE m.q WHEN 2 THEN 3 ELSE 2 END, 1
        UNION ALL SELECT CASE m.q WHEN 2 THEN 2 ELSE 3 END, 2) x)
  QUALIFY row_number() OVER (PARTITION BY conv_id, q ORDER BY cost, audit) = 1),
best AS (SELECT * FROM dp WHERE i = n AND q IN (0, 3)
  QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY cost, audit) = 1)
SELECT o.conv_id, coalesce(c.gaps, 0)::BIGINT AS gaps, coalesce(c.blank, 0)::BIGINT AS blank,
  coalesce(c.duplicate, 0)::BIGINT AS duplicate, coalesce(c.truncated, 0)::BIGINT AS truncated,
  coalesce(c.illegal, 0)::BIGINT AS illegal, coalesce(b.cost, 0)::BIGINT AS cost,
  coalesce(b.audit, '') AS audit, sha256(coalesce(array_to_string(b.lines, chr(10)), ''))
    AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM o.conv_id""")
def op12_conversation_repair(spark, folder):
    rows, copies = damaged(table(spark, folder, "conversations"))
    return repair_report(rows, copies=copies)
