"""Control charts over ordered series, safe for one very long series.

A series is cut into time chunks. Each chunk is scanned on its own; a small table with one row
per (series, chunk) carries the state from chunk to chunk. Both recurrences allow that:

* CUSUM. With S the running sum of z - k, the chart value is S - min(0, running minimum of S).
* EWMA. A chunk maps the incoming value e to (1-w)^n * e + E, where E starts from zero.

Inside a chunk the EWMA sum is built in blocks so that (1-w)^-j stays below 1e18; weights older
than two blocks are below 1e-17 and vanish in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import rules
from plumbline.operators.ordered import join_same, key_list
from plumbline.policy import DEFAULT_POLICY, DriftPolicy

_CHUNK = "_chunk"


def time_chunk(ts: str, seconds: int) -> Column:
    """Number of the fixed-length time chunk a timestamp falls into."""
    return F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / (seconds * 1_000_000))


def baseline_stats(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean and sample standard deviation of a fixed validation period, one row per key."""
    return df.groupBy(*keys).agg(
        F.avg(value).alias("baseline_mean"), F.stddev_samp(value).alias("baseline_std"),
        F.count(value).alias("baseline_n"))


def with_baseline(df: DataFrame, baseline: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Attach the fixed baseline of each series; a series without one keeps its rows.

    The join is left open to the planner: few series broadcast by themselves, many do not.
    """
    return join_same(df, baseline.select(*keys, "baseline_mean", "baseline_std"), keys, "left")


def require_baselines(df: DataFrame, baseline: DataFrame, keys: Sequence[str]) -> None:
    """Raise where a series has no baseline or one with a spread that is not positive."""
    bad = (
        join_same(df.select(*keys).distinct(), baseline, keys, "left")
        .where(F.col("baseline_std").isNull() | ~(F.col("baseline_std") > 0)).limit(1).count()
    )
    if bad:
        raise ValueError("every series needs a baseline with a positive standard deviation")


def drift_monitor(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str,
                  chunk: Column, policy: DriftPolicy = DEFAULT_POLICY) -> DataFrame:
    """EWMA and downward CUSUM charts, one output row per observation.

    ``df`` carries ``baseline_mean`` and ``baseline_std``. ``order`` sorts a series uniquely and
    ``chunk`` grows with it. Adds position, ewma, ewma_lower_limit, cusum_down, both alerts and
    trend_status. Rows without a value, and rows of a series without a baseline that has a spread,
    are no observations: their status is NO_VALUE or NO_BASELINE, the other columns are NULL and
    the charts pass over them.
    """
    has_base = F.coalesce(F.col("baseline_std") > 0, F.lit(False)) & F.col(
        "baseline_mean").isNotNull()
    has_value = F.col(value).isNotNull()
    charted = _charts(df.where(has_base & has_value), list(keys), order, value, chunk, policy)
    idle = df.where(~(has_base & has_value)).withColumn("trend_status", F.when(
        ~has_base, "NO_BASELINE").otherwise("NO_VALUE"))
    return charted.unionByName(idle, allowMissingColumns=True)


def _charts(df: DataFrame, keys: list[str], order: Sequence[str], value: str, chunk: Column,
            policy: DriftPolicy) -> DataFrame:
    """The charts over rows that all have a value and a baseline."""
    w, by = policy.ewma_lambda, key_list(keys)
    along = ", ".join(f"`{c}`" for c in order)
    reach, keep = _reach(w), f"{1.0 - w!r}D"
    upto = f"(PARTITION BY {by}, {_CHUNK} ORDER BY {along} ROWS UNBOUNDED PRECEDING)"
    rows = (
        df.withColumn(_CHUNK, chunk)
        .withColumn("_z", F.expr(f"(baseline_mean - `{value}`) / baseline_std - {policy.cusum_k_sigma!r}D"))
        .selectExpr("*", f"row_number() OVER (PARTITION BY {by}, {_CHUNK} ORDER BY {along}) AS _r",
                    f"sum(_z) OVER {upto} AS _s")
        .selectExpr("*", f"min(_s) OVER {upto} AS _m"))
    rows = _local_ewma(rows, by, along, value, w)

    past = f"(PARTITION BY {by} ORDER BY {_CHUNK} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    ends = rows.groupBy(*keys, _CHUNK).agg(
        F.expr("max(_r) AS _n"), F.expr("max_by(_s, _r) AS _sum"), F.expr("min(_m) AS _low"),
        F.expr("max_by(_e, _r) AS _end"))
    ends = ends.selectExpr("*", f"coalesce(sum(_n) OVER {past}, 0L) AS _pos0",
                           f"coalesce(sum(_sum) OVER {past}, 0D) AS _s0")
    ends = ends.selectExpr("*", f"coalesce(min(_s0 + _low) OVER {past}, 0D) AS _m0", "_pos0 + _n AS _at")
    if w < 1.0:
        # the EWMA after a chunk is a sum of earlier ends, each times keep ^ rows since; counted from the
        # start of a block of ``reach`` rows the powers stay in range, and what lies before the block
        # in front weighs less than 1e-17
        ends = ends.selectExpr("*", f"_at div {reach} AS _blk", f"pow({keep}, _at % {reach}) AS _p").selectExpr(
            "*", "_end / _p AS _g").selectExpr(
            "*", f"sum(_g) OVER (PARTITION BY {by}, _blk ORDER BY {_CHUNK} ROWS UNBOUNDED PRECEDING) AS _own",
            f"""sum(_g) OVER (PARTITION BY {by} ORDER BY _blk RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING)
                AS _front""")
        ends = ends.withColumn("_end", F.expr(f"_p * (_own + pow({keep}, {reach}) * coalesce(_front, 0D))"))
    carry = ends.selectExpr(*[f"`{k}`" for k in keys], _CHUNK, "_pos0", "_s0", "_m0",
                            f"coalesce(lag(_end) OVER (PARTITION BY {by} ORDER BY {_CHUNK}), 0D) AS _e0")

    out = join_same(rows, carry, [*keys, _CHUNK]).selectExpr(
        *[f"`{c}`" for c in df.columns], "_pos0 + _r AS position",
        f"_e + pow({keep}, _r) * _e0 + pow({keep}, _pos0 + _r) * baseline_mean AS ewma",
        f"""baseline_mean - {float(policy.ewma_limit_sigma)!r}D * baseline_std * sqrt(
            {w / (2.0 - w)!r}D * (1 - pow({keep}, 2 * (_pos0 + _r)))) AS ewma_lower_limit""",
        "_s0 + _s - least(0D, _m0, _s0 + _m) AS cusum_down"
    ).selectExpr("*", "ewma < ewma_lower_limit AS ewma_alert",
                 f"cusum_down > {float(policy.cusum_h_sigma)!r}D AS cusum_alert")
    return out.withColumn("trend_status", rules.trend_status(F.col("ewma_alert"),
                                                             F.col("cusum_alert")))


def _reach(w: float) -> int:
    """Rows after which an EWMA weight is below 1e-17."""
    return 1 if w >= 1.0 else max(1, math.ceil(math.log(1e-17) / math.log(1.0 - w)))


def _local_ewma(rows: DataFrame, by: str, along: str, value: str, w: float) -> DataFrame:
    """EWMA inside each chunk, started from zero, as column ``_e``."""
    if w >= 1.0:
        return rows.withColumn("_e", F.col(value).cast("double"))
    size, keep = _reach(w), f"{1.0 - w!r}D"
    return (
        rows.selectExpr("*", f"(_r - 1) div {size} AS _b", f"(_r - 1) % {size} AS _j")
        .selectExpr("*", f"""{w!r}D * pow({keep}, _j) * sum(`{value}` * pow({keep}, -_j)) OVER (
            PARTITION BY {by}, {_CHUNK}, _b ORDER BY {along} ROWS UNBOUNDED PRECEDING) AS _be""")
        # the last row of the block before
        .selectExpr("*", f"""max(CASE WHEN _j = {size - 1} THEN _be END) OVER (
            PARTITION BY {by}, {_CHUNK} ORDER BY _b RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS _bl""")
        .withColumn("_e", F.expr(f"_be + pow({keep}, _j + 1) * coalesce(_bl, 0D)"))
        .drop("_b", "_j", "_be", "_bl"))


def window_rollup(points: DataFrame, keys: Sequence[str], value: str, ts: str) -> DataFrame:
    """One drift window per key: worst status (first row on ties) and the last value."""
    status = F.col("trend_status")
    rank = (F.when(status == "STABLE", 0).when(status == "EWMA_ALERT", 1)
            .when(status == "CUSUM_ALERT", 2).otherwise(3))
    worst = F.max_by(F.struct("trend_status", "ewma", "cusum_down"),
                     F.struct(rank, -F.col("position")))
    out = points.groupBy(*keys).agg(
        worst.alias("_w"), F.max_by(value, "position").alias("metric_value"),
        F.count(F.lit(1)).alias("n_points"), F.min(ts).alias("window_start"),
        F.max(ts).alias("window_end"))
    return out.select(
        *keys, "window_start", "window_end", "metric_value",
        F.col("_w.ewma").alias("ewma_value"), F.col("_w.cusum_down").alias("cusum_value"),
        F.col("_w.trend_status").alias("trend_status"),
        rules.drift_pattern(F.col("_w.trend_status"), F.col("n_points")).alias("drift_pattern"),
        "n_points")


def previous_value(df: DataFrame, keys: Sequence[str], order: Sequence[str], column: str,
                   name: str, chunk: Column) -> DataFrame:
    """Add the value of the row before, per key along ``order``, chunk by chunk.

    The first row of a chunk takes the last value of the chunk before it.
    """
    by = key_list(keys)
    along = ", ".join(f"`{c}`" for c in order)
    rows = df.withColumn(_CHUNK, chunk)
    last = rows.groupBy(*keys, _CHUNK).agg(
        F.expr(f"max_by(struct(`{column}` AS v), struct({along})) AS _last"))
    carry = last.selectExpr(*[f"`{k}`" for k in keys], _CHUNK,
                            f"lag(_last) OVER (PARTITION BY {by} ORDER BY {_CHUNK}) AS _in")
    inside = f"(PARTITION BY {by}, {_CHUNK} ORDER BY {along})"
    return join_same(rows.selectExpr(
        "*", f"row_number() OVER {inside} AS _r", f"lag(`{column}`) OVER {inside} AS _lag"
    ), carry, [*keys, _CHUNK]).selectExpr(
        *[f"`{c}`" for c in df.columns],
        f"CASE WHEN _r = 1 THEN _in.v ELSE _lag END AS `{name}`")


def lagged_drop(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str,
                chunk: Column, policy: DriftPolicy = DEFAULT_POLICY) -> DataFrame:
    """Drop from the window before to this one, and its class."""
    return previous_value(df, keys, order, value, "prior_value", chunk).withColumn(
        "drop_amount", F.col("prior_value") - F.col(value)).withColumn(
        "drop_class", rules.sudden_drop_class(F.col("prior_value"), F.col(value), policy))
