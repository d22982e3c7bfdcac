"""Query of the language identification."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.llm.language import identify_languages
from plumbline.llm.registry import query, table
from plumbline.llm.text import learns


@query("op13_language")
def op13_language(spark, folder):
    docs = table(spark, folder, "documents")
    return identify_languages(docs, learns("doc_id")).select(
        "doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)).alias(
            "held_out"), "lang_pred", "score")
