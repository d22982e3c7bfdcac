"""Population stability against a stored reference.

The reference is one small row per key: bin edges and counts. Windows are compared with that row and
the reference's own rows are not read again. New reference rows add to the counts, and summaries over
the same edges add up, so the reference grows without being read either; only new edges need its rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.ordered import exact_quantiles, join_same, join_spread


def _bin_counts(rows: DataFrame, edges: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows per key and bin of the edges; equal values are one row before they are joined."""
    valued = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_x")).agg(
        F.count(F.lit(1)).alias("_n"))
    at = F.size(F.filter("edges", lambda e: e <= F.col("_x")))
    return join_spread(valued, edges.select(*keys, "edges"), keys, "_x").groupBy(
        *keys, at.alias("_bin")).agg(F.sum("_n").alias("_n"))


def _as_arrays(counts: DataFrame, keys: list[str], bins: Column) -> DataFrame:
    """Counts by bin as one array per key, zeros included."""
    listed = counts.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_bin", "_n"))).alias("_m"))
    return listed.withColumn("counts", F.transform(
        F.sequence(F.lit(0), bins - 1), lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(0).cast("long"))))


def reference_summary(rows: DataFrame, keys: Sequence[str], value: str, bins: int = 10) -> DataFrame:
    """``edges`` (linear quantiles; the outer bins are open) and ``counts`` of the reference per key.

    NULL values do not count, and a key without a value has no summary.
    """
    if bins < 2:
        raise ValueError("at least two bins are needed")
    keys = list(keys)
    probs = [i / bins for i in range(1, bins)]
    edges = exact_quantiles(rows, keys, value, probs).groupBy(*keys).agg(
        F.sort_array(F.collect_list("quantile")).alias("edges"))  # bins - 1 entries per key
    counts = _as_arrays(_bin_counts(rows, edges, keys, value), keys, F.lit(bins))
    return join_same(edges, counts.drop("_m"), keys)


def extend_summary(summary: DataFrame, rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The summary with the counts of new reference rows; keys that have none yet are left out."""
    keys = list(keys)
    new = _bin_counts(rows, summary, keys, value).groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("_bin", "_n"))).alias("_m"))
    both = join_same(summary, new, keys, "left")
    return both.withColumn("counts", F.transform("counts", lambda n, i: n + F.coalesce(
        F.try_element_at("_m", i), F.lit(0).cast("long")))).drop("_m")


def merge_summaries(summaries: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Summaries over the same edges, as parts of a reference leave them, added up per key."""
    keys = list(keys)
    parts = summaries.select(*keys, "edges", F.posexplode("counts").alias("_bin", "_n")).groupBy(
        *keys, "edges", "_bin").agg(F.sum("_n").alias("_n"))
    return parts.groupBy(*keys, "edges").agg(F.transform(F.sort_array(F.collect_list(
        F.struct("_bin", "_n"))), lambda p: p["_n"]).alias("counts"))


def stability_index(summary: DataFrame, rows: DataFrame, keys: Sequence[str], value: str,
                    epsilon: float = 1e-6) -> DataFrame:
    """``n_reference``, ``n_current`` and ``psi`` of the window's rows per key of the summary.

    A key without rows in the window keeps its row with a NULL index.
    """
    keys = list(keys)
    now = _bin_counts(rows, summary, keys, value).groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("_bin", "_n"))).alias("_m"))

    def total(of: Column) -> Column:
        return F.aggregate(of, F.lit(0).cast("long"), lambda t, n: t + n)

    both = join_same(summary, now, keys, "left").withColumn("_now", F.transform(
        "counts", lambda n, i: F.coalesce(F.try_element_at("_m", i), F.lit(0).cast("long")))).withColumns({
            "n_reference": total(F.col("counts")), "n_current": total(F.col("_now"))})
    terms = F.zip_with("counts", "_now", lambda r, c: F.struct(
        (r / F.col("n_reference") + epsilon).alias("r"), (c / F.col("n_current") + epsilon).alias("c")))
    psi = F.aggregate(terms, F.lit(0.0), lambda t, p: t + (p["c"] - p["r"]) * F.ln(p["c"] / p["r"]))
    return both.select(*keys, "n_reference", "n_current", F.when(
        (F.col("n_reference") > 0) & (F.col("n_current") > 0), psi).alias("psi"))
