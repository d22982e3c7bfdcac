"""Query of the quality classifier."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.llm.quality import score_quality
from plumbline.llm.registry import query, table
from plumbline.llm.text import learns


@query("op1_quality")
def op1_quality(spark, folder):
    out = score_quality(table(spark, folder, "documents"), table(spark, folder, "labels"),
                        learns("doc_id"))
    return out.select("doc_id", (~learns("doc_id")).alias("held_out"), "score",
                      (F.col("score") >= 0.7).cast("int").alias("predicted"))
