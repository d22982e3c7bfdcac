"""Streaming forms of the metric feed, the drift monitor and duplicate removal."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from plumbline.policy import DEFAULT_POLICY, DriftPolicy
from plumbline.session import ROCKSDB_PROVIDER, scratch_path


def metric_feed(stream: DataFrame, keys: Sequence[str], ts: str, value: str, window: str,
                watermark: str) -> DataFrame:
    """Mean per series and tumbling window; rows later than the watermark are dropped."""
    return (
        stream.withWatermark(ts, watermark)
        .groupBy(*keys, F.window(ts, window).alias("_w"))
        .agg(F.avg(value).alias("metric_value"), F.count(F.lit(1)).alias("n"))
        .select(*keys, F.col("_w.start").alias("window_start"),
                F.col("_w.end").alias("window_end"), "metric_value", "n"))


def stream_dedupe(stream: DataFrame, digest: str, ts: str, watermark: str) -> DataFrame:
    """First arrival per content hash; the state is dropped once the watermark has passed."""
    return stream.withWatermark(ts, watermark).dropDuplicatesWithinWatermark([digest])


class _Chart(StatefulProcessor):
    """Keeps position, EWMA and CUSUM of one series, and when its last window ended.

    Times are microseconds. A window that closed without rows is reported when the next rows come or
    when an event-time timer says that it is over, whichever is first.
    """

    def __init__(self, key: str, policy: DriftPolicy, expire: int) -> None:
        self.key, self.policy, self.expire = key, policy, expire

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("chart", T.StructType([
            T.StructField("position", T.LongType()), T.StructField("ewma", T.DoubleType()),
            T.StructField("cusum", T.DoubleType()), T.StructField("end", T.LongType()),
            T.StructField("width", T.LongType()), T.StructField("silent", T.LongType()),
            T.StructField("based", T.BooleanType())]))

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=[self.key, "starts_us", "ends_us", "metric_value", "position", "ewma",
                                          "ewma_lower_limit", "cusum_down", "trend_status"])
        return out.astype({"position": "Int64", "metric_value": "float64", "ewma": "float64",
                           "ewma_lower_limit": "float64", "cusum_down": "float64"})

    @staticmethod
    def _idle(key, start: int, end: int, based: bool) -> tuple:
        return (key[0], start, end, None, None, None, None, None, "NO_VALUE" if based else "NO_BASELINE")

    def _silence(self, key, at: list, upto: int, out: list[tuple]) -> bool:
        """Report the windows without rows before ``upto``; whether the series died meanwhile."""
        while at[3] + at[4] <= upto:
            at[5] += 1
            out.append(self._idle(key, at[3], at[3] + at[4], at[6]))
            at[3] += at[4]
            if at[5] >= self.expire:
                return True
        return False

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues
                        ) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values("ends_us", ignore_index=True)
        w, p = self.policy.ewma_lambda, self.policy
        # position, ewma, cusum, end of the last window, its width, silent windows, has a baseline
        at = list(self.state.get()) if self.state.exists() else None
        out: list[tuple] = []
        for start, end, x, mu, sigma in zip(pdf["starts_us"].tolist(), pdf["ends_us"].tolist(),
                                            pdf["metric_value"], pdf["baseline_mean"],
                                            pdf["baseline_std"]):
            if at is None or self._silence(key, at, start, out):
                at = [0, 0.0, 0.0, end, end - start, 0, True]
            at[3], at[4], at[5] = end, end - start, 0
            at[6] = bool(pd.notna(mu) and pd.notna(sigma) and sigma > 0)
            if not at[6] or pd.isna(x):
                row = self._idle(key, start, end, at[6])
                out.append((*row[:3], None if pd.isna(x) else float(x), *row[4:]))
                continue
            pos = at[0] + 1
            ewma = w * x + (1.0 - w) * (mu if at[0] == 0 else at[1])
            cusum = max(0.0, at[2] + (mu - x) / sigma - p.cusum_k_sigma)
            spread = (w / (2.0 - w) * (1.0 - (1.0 - w) ** (2 * pos))) ** 0.5
            limit = mu - p.ewma_limit_sigma * sigma * spread
            low, high = ewma < limit, cusum > p.cusum_h_sigma
            status = ("BOTH_ALERT" if low and high else "EWMA_ALERT" if low
                      else "CUSUM_ALERT" if high else "STABLE")
            at[:3] = [pos, float(ewma), float(cusum)]
            out.append((key[0], start, end, float(x), pos, ewma, limit, cusum, status))
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self._keep(at)
        yield self._frame(out)

    def _keep(self, at: list) -> None:
        self.state.update((int(at[0]), float(at[1]), float(at[2]), int(at[3]), int(at[4]), int(at[5]),
                           bool(at[6])))
        self.handle.registerTimer(-(-(at[3] + at[4]) // 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.state.exists():
            return
        at, out = list(self.state.get()), []
        if self._silence(key, at, timerValues.getCurrentWatermarkInMs() * 1000, out):
            self.state.clear()  # a series that comes back starts anew
        else:
            self._keep(at)
        if out:
            yield self._frame(out)

    def close(self) -> None:
        pass


def stream_drift_monitor(feed: DataFrame, key: str, policy: DriftPolicy = DEFAULT_POLICY,
                         expire_windows: int = 30) -> DataFrame:
    """Control charts over closed windows, state per series in the RocksDB store.

    ``feed`` is a metric feed with its baseline attached. Windows close in time order, so the
    state only ever moves forward. Statuses are those of :func:`series.drift_monitor`: a window
    without a value, also one in which the series was silent, is NO_VALUE, one of a series without
    a baseline that has a spread is NO_BASELINE, and the charts pass over both. A series silent for
    ``expire_windows`` windows is forgotten and starts anew should it come back.
    """
    if expire_windows < 1:
        raise ValueError("a series must be kept for a window at least")
    conf, setting = feed.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    if conf.get(setting) != ROCKSDB_PROVIDER:
        conf.set(setting, ROCKSDB_PROVIDER)  # the operator runs on no other store
    schema = T.StructType([
        feed.schema[key], T.StructField("starts_us", T.LongType()), T.StructField("ends_us", T.LongType()),
        T.StructField("metric_value", T.DoubleType()), T.StructField("position", T.LongType()),
        T.StructField("ewma", T.DoubleType()), T.StructField("ewma_lower_limit", T.DoubleType()),
        T.StructField("cusum_down", T.DoubleType()), T.StructField("trend_status", T.StringType())])
    timed = feed.withColumns({"starts_us": F.unix_micros("window_start"), "ends_us": F.unix_micros("window_end")})
    charts = timed.groupBy(key).transformWithStateInPandas(
        statefulProcessor=_Chart(key, policy, expire_windows), outputStructType=schema,
        outputMode="Append", timeMode="EventTime")
    return charts.select(key, F.timestamp_micros("starts_us").alias("window_start"), F.timestamp_micros(
        "ends_us").alias("window_end"), *schema.names[3:])


def run_to_table(stream: DataFrame, label: str, output_mode: str = "append") -> DataFrame:
    """Run an append stream over everything available and read back what it wrote."""
    spark: SparkSession = stream.sparkSession
    out, checkpoint = scratch_path(spark, label), scratch_path(spark, f"{label}-checkpoint")
    query = (stream.writeStream.format("parquet").option("path", out)
             .option("checkpointLocation", checkpoint).outputMode(output_mode)
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
