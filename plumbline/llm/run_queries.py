"""Query of the periodic runs, with the repetition it is measured on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.periodic_runs import periodic_runs
from plumbline.llm.registry import query, table
from plumbline.llm.text import whole


def with_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text``; a tenth of the texts, by a hash, repeats a stretch of words to its end."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10).cast("long")
    split = docs.select("doc_id", whole("text").alias("text"), h.alias("h"), g.alias("g"), F.when(
        h % 10 == 0, F.filter(F.split(whole("text"), r"[\x20\x09-\x0D]+"), lambda w: w != "")).alias("w"))
    n = F.size("w")
    a = F.col("g") % F.greatest(n, F.lit(1))
    p = F.floor((n - a) / (F.lit(3) + F.col("g") % 8)) + 1
    placed = split.select("doc_id", "text", "w", n.alias("n"), a.cast("int").alias("a"),
                          p.cast("int").alias("p"))
    n, a, p = F.col("n"), F.col("a"), F.col("p")
    again = F.flatten(F.array_repeat(F.slice("w", a + 1, p), F.ceil((n - a) / p).cast("int")))
    words = F.concat(F.slice("w", F.lit(1), a), F.slice(again, F.lit(1), n - a))
    return placed.select("doc_id", F.when(F.coalesce(n > 0, F.lit(False)), F.array_join(
        words, " ")).otherwise(F.col("text")).alias("text"))


@query("op11_periodic_runs")
def op11_periodic_runs(spark, folder):
    found = periodic_runs(with_repeats(table(spark, folder, "documents")), least=24, times=3)
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.concat_ws("", F.transform(lines, lambda x: F.concat(x, F.lit("\n")))), 256).alias(
            "runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))
