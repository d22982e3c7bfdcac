"""Order statistics and running totals that never put one key into one task.

A plain window over a key sorts all rows of that key in one task. Here the value range is cut
into slices first. The cut points come from sketches over all rows, merged in two steps, so a slice
holds about one part of the table whatever share a single key has. Sketch error only moves the cut
points; every result below stays exact.

Keys may be NULL, which is a key like any other, and there may be no keys at all.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SLICE = "_slice"


def key_list(keys: Sequence[str], *more: str) -> str:
    """Columns for PARTITION BY; without any, one constant."""
    return ", ".join([f"`{k}`" for k in keys] + list(more)) or "1"


def join_same(left: DataFrame, right: DataFrame, keys: Sequence[str],
              how: str = "inner") -> DataFrame:
    """Join on equal keys, where NULL equals NULL; the keys of ``left`` stay.

    Without keys ``right`` must have one row.
    """
    if not keys:
        return left.join(F.broadcast(right), how=how) if how != "left" else left.join(
            F.broadcast(right), F.lit(True), how)
    mine = {k: f"_right_{i}" for i, k in enumerate(keys)}
    other = right.withColumnsRenamed(mine)
    same = None
    for k, name in mine.items():
        test = left[k].eqNullSafe(other[name])
        same = test if same is None else same & test
    return left.join(other, same, how).drop(*mine.values())


def join_spread(left: DataFrame, right: DataFrame, keys: Sequence[str], by: str,
                how: str = "inner", salts: int = 16) -> DataFrame:
    """`join_same` with a small table of one row per key, where a hot key goes to many tasks.

    Rows of ``left`` are dealt by a hash of column ``by``, of which no value should be hot, and
    ``right`` is repeated once per salt.
    """
    if not keys:
        return join_same(left, right, keys, how)
    dealt = left.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return join_same(dealt, copies, [*keys, "_salt"], how).drop("_salt")


def default_slices(df: DataFrame) -> int:
    """About four slices per shuffle partition.

    A cluster sized for a large table has many shuffle partitions and so gets many slices.
    """
    return max(64, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def count_at_most(ordered: Column, entries: int, value: Column) -> Column:
    """How many of at most ``entries`` ascending array entries are at most ``value``: bisection."""
    steps = [1 << k for k in reversed(range(max(1, entries).bit_length()))]
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda at, step: F.when(
        F.coalesce(F.get(ordered, at + step - 1) <= value, F.lit(False)), at + step).otherwise(at))


def slice_cuts(df: DataFrame, value: str, slices: int | None = None) -> tuple[Column, int]:
    """Cut points of ``value`` as a one-row scalar subquery, and the number of slices.

    Every map task adds its sketch to one of several groups, and the groups' quantiles, which stand
    for equal shares of a group, are merged; so no task takes in the sketches of all tasks.
    """
    slices = slices or default_slices(df)
    groups = max(1, math.isqrt(slices))
    probs = ", ".join(f"{i / slices!r}D" for i in range(1, slices))
    sketch = f"percentile_approx(`{value}`, array({probs}), {max(1000, 2 * slices)})"
    by_group = df.select(value, (F.spark_partition_id() % groups).alias("_g")).groupBy("_g").agg(
        F.expr(sketch).alias("_q"))
    cuts = by_group.select(F.explode("_q").alias(value)).agg(F.expr(
        f"percentile_approx(`{value}`, array({probs}), {max(1000, 2 * slices)})").alias("cuts"))
    return cuts.select(F.coalesce("cuts", F.array())).scalar(), slices


def with_slice(df: DataFrame, value: str, cuts: Column, slices: int,
               name: str = _SLICE) -> DataFrame:
    """Add the slice number: how many cut points lie at or below the value."""
    return df.withColumn("_cuts", cuts).withColumn(
        name, count_at_most(F.col("_cuts"), slices, F.col(value))).drop("_cuts")


def running_totals(df: DataFrame, keys: Sequence[str], order: str, totals: Sequence[str],
                   slice_col: str, descending: bool = False, suffix: str = "_cum") -> DataFrame:
    """Inclusive running sums of ``totals`` per key along ``order`` (unique within the key).

    ``slice_col`` must grow with ``order``. Rows are summed inside each (key, slice); the small
    table of slice sums gives the amount carried in from earlier slices.
    """
    keys = list(keys)
    order_sql = f"{order} DESC" if descending else order
    slice_sql = f"{slice_col} DESC" if descending else slice_col
    sums = df.groupBy(*keys, slice_col).agg(*[F.expr(f"sum({c}) AS _s_{c}") for c in totals])
    carry = sums.selectExpr(*[f"`{k}`" for k in keys], slice_col, *[
        f"coalesce(sum(_s_{c}) OVER (PARTITION BY {key_list(keys)} ORDER BY {slice_sql} "
        f"ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS _in_{c}" for c in totals])
    local = df.selectExpr("*", *[
        f"sum({c}) OVER (PARTITION BY {key_list(keys, slice_col)} ORDER BY {order_sql} "
        f"ROWS UNBOUNDED PRECEDING) AS _l_{c}" for c in totals])
    return join_same(local, carry, [*keys, slice_col]).selectExpr(
        *[f"`{c}`" for c in df.columns], *[f"_l_{c} + _in_{c} AS {c}{suffix}" for c in totals])


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float],
                    method: str = "linear", slices: int | None = None) -> DataFrame:
    """Exact quantiles per key: rows (keys, prob, quantile, n).

    ``linear`` interpolates between neighbours, ``higher`` takes the upper neighbour. Three
    passes: sketch, slice counts, and a last one that shuffles only the slices that hold a wanted
    rank. NULL values are ignored.
    """
    if method not in ("linear", "higher"):
        raise ValueError("method must be 'linear' or 'higher'")
    if not probs or any(not 0.0 <= p <= 1.0 for p in probs):
        raise ValueError("probabilities must lie in [0, 1]")
    keys = list(keys)
    rows = df.select(*keys, F.col(value).alias("_v")).where(F.col("_v").isNotNull())
    cuts, slices = slice_cuts(rows, "_v", slices)
    sliced = with_slice(rows, "_v", cuts, slices)

    by = key_list(keys)
    array = ", ".join(f"{float(p)!r}D" for p in probs)
    # 1e-9 guards against float noise in p * (n - 1)
    lo = "ceil(p * (_total - 1) - 1e-9D)" if method == "higher" else "floor(p * (_total - 1) + 1e-9D)"
    counts = sliced.groupBy(*keys, _SLICE).agg(F.expr("count(*) AS _n")).selectExpr(
        "*", f"sum(_n) OVER (PARTITION BY {by}) AS _total",
        f"sum(_n) OVER (PARTITION BY {by} ORDER BY {_SLICE}) - _n AS _below")
    wanted = counts.withColumn("_want", F.expr(f"""filter(
        transform(array({array}), p -> struct(p AS prob, {lo} AS lo,
            ceil(p * (_total - 1) - 1e-9D) AS hi, p * (_total - 1) AS at)),
        w -> (w.lo >= _below AND w.lo < _below + _n) OR (w.hi >= _below AND w.hi < _below + _n))"""))
    targets = wanted.where("size(_want) > 0").drop("_n")

    picked = (
        # at most one target row per (keys, slice), so the join only filters
        join_same(sliced, targets, [*keys, _SLICE])
        .groupBy(*keys, _SLICE, "_v").agg(F.expr("count(*) AS _m"), *[
            F.first(c).alias(c) for c in ("_below", "_total", "_want")])
        .withColumn("_to", F.expr(
            f"_below + sum(_m) OVER (PARTITION BY {key_list(keys, _SLICE)} ORDER BY _v)"))
    )
    hits = picked.selectExpr(
        *[f"`{k}`" for k in keys], "_v", "_total", "_to", "_to - _m AS _from",
        """explode(filter(_want, w -> (w.lo >= _to - _m AND w.lo < _to)
            OR (w.hi >= _to - _m AND w.hi < _to))) AS _w""")
    ends = hits.groupBy(*keys, F.col("_w.prob").alias("prob")).agg(
        F.expr("max(CASE WHEN _w.lo >= _from AND _w.lo < _to THEN _v END) AS _a"),
        F.expr("max(CASE WHEN _w.hi >= _from AND _w.hi < _to THEN _v END) AS _b"),
        F.expr("greatest(max(_w.at - _w.lo), 0D) AS _f"), F.expr("max(_total) AS n"))
    quantile = "_b" if method == "higher" else "_a + (_b - _a) * _f"
    return ends.selectExpr(*[f"`{k}`" for k in keys], "prob",
                           f"double({quantile}) AS quantile", "n")


def quantiles_wide(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float],
                   method: str = "linear", slices: int | None = None) -> DataFrame:
    """One row per key with one named column per probability."""
    rows = exact_quantiles(df, keys, value, list(probs.values()), method, slices)
    return rows.groupBy(*keys).agg(
        *[F.max(F.when(F.col("prob") == F.lit(float(p)), F.col("quantile"))).alias(name)
          for name, p in probs.items()],
        F.max("n").alias("n"))
