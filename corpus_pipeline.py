"""The corpus pipeline: stages in order, each a function of (spark, docs, sf_dir).

Quality filter, SimHash near-duplicates, benchmark decontamination, mixing by source, token files.
Each stage works on all rows its predecessor kept. All but the last return the columns of
``documents``; the last returns the index of the token files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm.decontaminate import keep_clean
from plumbline.llm.mixing import mixed_rows
from plumbline.llm.quality import keep_quality
from plumbline.llm.registry import table
from plumbline.llm.simhash import one_per_group
from plumbline.llm.text import learns
from plumbline.llm.token_files import token_index
from plumbline.llm.token_queries import END_ID, TOKENIZER
from plumbline.session import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble does not reject."""
    return keep_quality(docs, table(spark, sf_dir, "labels"), learns("doc_id"), least=0.5)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 0.8 of its five-word shingles."""
    return one_per_group(docs, shingle=5, similarity=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without ten words in a row of any benchmark item."""
    return keep_clean(docs, table(spark, sf_dir, "benchmark"), window=10)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that sources weigh as the square root of their sizes, shuffled."""
    return mixed_rows(docs).select("_row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mixture; the index read back from them."""
    return token_index(docs, TOKENIZER, END_ID)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates),
          ("decontamination", decontamination), ("mixing", mixing), ("tokens", tokens)]

#: The tokenizer and the fitted model have no SQL form; tests compare with plain Python instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(spark, stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
