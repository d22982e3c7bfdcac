"""Query of the SimHash near-duplicates."""

from __future__ import annotations

from plumbline.llm.registry import query, table
from plumbline.llm.simhash import near_duplicates


@query("op5_simhash")
def op5_simhash(spark, folder):
    return near_duplicates(table(spark, folder, "documents"), shingle=3, radius=2)
