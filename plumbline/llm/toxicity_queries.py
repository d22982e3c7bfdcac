"""Query of the toxicity classifier."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.llm.registry import query, table
from plumbline.llm.text import learns
from plumbline.llm.toxicity import score_toxicity


@query("op2_toxicity")
def op2_toxicity(spark, folder):
    out = score_toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"),
                         learns("doc_id"))
    return out.select("doc_id", (~learns("doc_id")).alias("held_out"), "score",
                      (F.col("score") >= 0.3).cast("int").alias("predicted"),
                      F.size("offending").alias("n_offending"))
