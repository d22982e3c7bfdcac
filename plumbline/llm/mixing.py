"""Mixing sources to target weights by Poisson replication.

Every source gets a repetition rate: its target share of the mixture's size over its own size. A
document's count is drawn from a Poisson distribution with that rate by inverting it at a uniform
number, which is a hash of the seed and the document, so a rerun draws the same counts and a split
of the work changes nothing. Documents are exploded by their counts, and all copies are ordered by
another hash: a global shuffle as a sort in ranges of that hash.

The rates are one row per source. They are broadcast while there are at most ``broadcast_sources``,
which is counted first; beyond that Spark joins by shuffle and splits skewed sources.

Cases: sizes are code points of the text, so null and empty texts add nothing; a source of size 0
has rate 0 unless all sources have, then nothing is drawn. A null source is a source. Rows that
repeat an id and text draw equal counts and stay distinct rows; equal shuffle keys are ordered by
id and copy. An empty table gives an empty result. All columns are kept, whatever their names;
only ``mix_sources``, which puts ``_mix`` beside them, refuses a column of that name.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.text import whole
from plumbline.session import materialize

_UNIT = 1 << 52


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the MD5 of the parts, joined by bars; null parts are empty."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(_UNIT))


def temperature_weights(sizes: DataFrame, exponent: float) -> DataFrame:
    """Target weights of sources in proportion to ``size ** exponent``."""
    return sizes.withColumn("weight", F.when(F.col("size") > 0, F.pow(
        F.col("size").cast("double"), F.lit(exponent))).otherwise(0.0))


def poisson_steps(rate: float) -> np.ndarray:
    """Cumulated probabilities of 0, 1, 2, ..., beyond which the tail is below a double's precision.

    Probabilities are built outward from the most likely count, as multiples of its own, and
    normalised at the end: exp(-rate) is no double for rates above 745.
    """
    mode, last = int(rate), int(rate + 12 * math.sqrt(rate) + 40)
    above = np.cumprod(rate / np.arange(mode + 1, last + 1))
    below = np.cumprod(np.arange(mode, 0, -1) / rate) if mode else np.empty(0)
    steps = np.cumsum(np.concatenate([below[::-1], [1.0], above]))
    return steps / steps[-1]


def repetition_rates(sizes: DataFrame, target_size: float | None = None) -> DataFrame:
    """``source``, ``rate`` and the Poisson distribution's ``steps`` from ``size`` and ``weight``.

    ``target_size`` is the mixture's expected size, by default that of the input. ``steps`` are the
    cumulated probabilities of 0, 1, 2, ... until they no longer grow.
    """
    total = sizes.agg(F.sum("weight").alias("_w"), F.sum("size").alias("_s")).first()
    weights, size = float(total["_w"] or 0), target_size or float(total["_s"] or 0)
    rate = F.when((F.col("size") > 0) & F.lit(weights > 0),
                  F.col("weight") / F.lit(weights or 1.0) * F.lit(size) / F.col("size")).otherwise(0.0)
    rated = sizes.select("source", rate.alias("rate"))

    def stepped(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            steps = pa.array([poisson_steps(r.as_py()) for r in batch["rate"]], pa.list_(pa.float64()))
            yield pa.record_batch({"source": batch["source"], "rate": batch["rate"], "steps": steps})

    return rated.mapInArrow(
        stepped, f"source {dict(rated.dtypes)['source']}, rate double, steps array<double>")


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               source_col: str = "source", *, seed: int = 7, exponent: float = 0.5,
               target_size: float | None = None, broadcast_sources: int = 10_000) -> DataFrame:
    """All copies in shuffled order: ``_row``, a struct of all columns of ``docs``, and ``_mix``.

    ``_mix`` has copy, copies, rate and key. A copy's number runs from 0; ``key`` is its place on the
    unit interval, the sort key. Keys are uniform, so equal parts of the interval are the partitions
    of the sort and no row is drawn twice to find its cuts.
    """
    spark = docs.sparkSession
    # the sum by source is small and decides the rates, so it is stored before it is used twice
    sizes = materialize(spark, docs.groupBy(F.col(source_col).alias("source")).agg(
        F.sum(F.char_length(whole(text_col)).cast("long")).alias("size")), "source-sizes")
    rates = materialize(spark, repetition_rates(temperature_weights(sizes, exponent), target_size),
                        "source-rates")
    small = rates.select(F.col("source").alias("_of"), F.col("rate").alias("_rate"), "steps")
    if rates.count() <= broadcast_sources:
        small = F.broadcast(small)
    rows = docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("_id"), F.col(
        source_col).alias("_source"))
    counted = rows.join(small, F.col("_source").eqNullSafe(F.col("_of"))).withColumn(
        "_u", uniform(F.lit(seed), F.col("_id"), F.lit("count"))).withColumn(
            "_count", F.expr("size(filter(steps, c -> c <= _u))")).filter("_count > 0")
    copies = counted.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.col("_count") - 1)))
    keyed = copies.select("_row", "_id", F.struct(
        F.col("_copy").alias("copy"), F.col("_count").alias("copies"), F.col("_rate").alias("rate"),
        uniform(F.lit(seed), F.col("_id"), F.col("_copy"), F.lit("place")).alias("key")).alias("_mix"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return keyed.repartitionById(parts, F.floor(F.col("_mix.key") * parts).cast("int")
                                 ).sortWithinPartitions("_mix.key", "_id", "_mix.copy").select(
        "_row", "_mix")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                source_col: str = "source", **options) -> DataFrame:
    """``mixed_rows`` as the columns of ``docs`` and ``_mix``."""
    if any(c.lower() == "_mix" for c in docs.columns):
        raise ValueError("_mix is already a column; mixed_rows keeps rows apart from it")
    return mixed_rows(docs, id_col, text_col, source_col, **options).select("_row.*", "_mix")
