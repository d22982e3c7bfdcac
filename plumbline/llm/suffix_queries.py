"""Query of the suffix-array deduplication."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.llm.registry import query, table
from plumbline.llm.suffix_dedup import cut_repeats


@query("op6_suffix_dedup")
def op6_suffix_dedup(spark, folder):
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return cut_repeats(table(spark, folder, "documents"), length=400).select(
        "doc_id", "n_bytes", gone.alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
