import time

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from plumbline.operators import series
from plumbline.streaming import feeds

SCHEMA = "id long, k string, ts timestamp, x double, digest string"


def rows(n, start, step, seed):
    rng = np.random.default_rng(seed)
    t0 = pd.Timestamp(start)
    return pd.DataFrame([(i, "ab"[i % 2], t0 + i * pd.Timedelta(step), float(rng.normal(1, 0.2)), f"d{i % 40}")
                         for i in range(n)], columns=["id", "k", "ts", "x", "digest"])


def as_stream(spark, folder, frames):
    for i, f in enumerate(frames):
        time.sleep(1.1 if i else 0)  # the file source reads in order of modification time
        spark.createDataFrame(f, SCHEMA).coalesce(1).write.parquet(str(folder / f"part{i}"))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder / "*"))


def test_stream_charts_equal_batch_charts(spark, tmp_path):
    data = rows(600, "2024-01-01", "10min", 1)
    data.loc[data.index > 400, "x"] -= 0.5
    stream = as_stream(spark, tmp_path, [data[:250], data[250:410], data[410:]])
    feed = feeds.metric_feed(stream, ["k"], "ts", "x", "2 hours", "1 hour")
    base = F.lit(1.0), F.lit(0.1)
    with_base = feed.withColumn("baseline_mean", base[0]).withColumn("baseline_std", base[1])
    got = feeds.run_to_table(feeds.stream_drift_monitor(with_base, "k"), "t").orderBy("k", "window_end").toPandas()
    batch = spark.createDataFrame(data, SCHEMA).groupBy("k", F.window("ts", "2 hours").alias("w")).agg(
        F.avg("x").alias("metric")).select("k", F.col("w.end").alias("window_end"), "metric").withColumn(
        "baseline_mean", base[0]).withColumn("baseline_std", base[1])
    want = series.drift_monitor(batch, ["k"], ["window_end"], "metric", series.time_chunk("window_end", 86400))
    want = want.orderBy("k", "window_end").toPandas()
    closed = data.ts.max() - pd.Timedelta("1h")
    want = want[want.window_end <= closed].reset_index(drop=True)
    assert len(got) == len(want) > 80
    np.testing.assert_allclose(got.ewma, want.ewma, atol=1e-12)
    np.testing.assert_allclose(got.cusum_down, want.cusum_down, atol=1e-9)
    assert (got.trend_status == want.trend_status).all() and (got.position == want.position).all()
    assert "BOTH_ALERT" in set(got.trend_status)


def test_late_rows_are_dropped_and_copies_removed(spark, tmp_path):
    data = rows(200, "2024-01-01", "10min", 2)
    late = data[:6].assign(x=1000.0)
    # rows are held against the watermark of the batch before, so the late ones come third
    stream = as_stream(spark, tmp_path / "a", [data[:100], data[100:], late])
    feed = feeds.run_to_table(feeds.metric_feed(stream, ["k"], "ts", "x", "2 hours", "1 hour"), "feed")
    assert feed.agg(F.max("metric_value")).head()[0] < 10
    again = as_stream(spark, tmp_path / "b", [data, data])
    out = feeds.run_to_table(feeds.stream_dedupe(again.select("digest", "ts"), "digest", "ts", "30 days"), "dd")
    assert out.count() == 40


def _closed_windows(spark, data, width, grid, base):
    """All windows of the grid with their mean, NULL where there is none, as the batch chart reads them."""
    batch = spark.createDataFrame(data, SCHEMA).groupBy("k", F.window("ts", width).alias("w")).agg(
        F.avg("x").alias("metric")).select("k", F.col("w.end").alias("window_end"), "metric")
    every = spark.createDataFrame([(k, e) for k, ends in grid.items() for e in ends], "k string, window_end timestamp")
    return series.with_baseline(every.join(batch, ["k", "window_end"], "left"), base, ["k"])


def test_gaps_nulls_and_no_spread_equal_the_batch_chart(spark, tmp_path):
    data = rows(600, "2024-01-01", "10min", 5)
    data["x"] = data.x.astype(object)
    data.loc[(data.index >= 100) & (data.index < 130), "x"] = None  # windows without a value
    data = data[~((data.index >= 200) & (data.index < 330) & (data.k == "a"))]  # a is silent for a while
    data = data[~((data.index >= 480) & (data.k == "b"))]  # and b from then on
    flat = data[data.k == "b"].assign(k="flat")
    data = pd.concat([data, flat]).sort_values("ts", kind="stable")
    base = spark.createDataFrame([("a", 1.0, 0.1), ("b", 1.0, 0.1), ("flat", 1.0, 0.0)],
                                 "k string, baseline_mean double, baseline_std double")
    cut = [data[data.id < 260], data[(data.id >= 260) & (data.id < 500)], data[data.id >= 500]]
    stream = as_stream(spark, tmp_path, cut)
    feed = feeds.metric_feed(stream, ["k"], "ts", "x", "2 hours", "1 hour").join(F.broadcast(base), "k", "left")
    got = feeds.run_to_table(feeds.stream_drift_monitor(feed, "k"), "t").orderBy("k", "window_end").toPandas()
    closed = data.ts.max() - pd.Timedelta("1h")
    ends = pd.date_range("2024-01-01 02:00", closed, freq="2h").to_pydatetime().tolist()
    want = series.drift_monitor(_closed_windows(spark, data, "2 hours", dict.fromkeys(["a", "b", "flat"], ends), base),
                                ["k"], ["window_end"], "metric", series.time_chunk("window_end", 86400))
    want = want.orderBy("k", "window_end").toPandas()
    assert list(zip(got.k, got.window_end, got.trend_status)) == list(zip(want.k, want.window_end, want.trend_status))
    np.testing.assert_allclose(got.ewma.astype(float), want.ewma.astype(float), atol=1e-12)
    np.testing.assert_allclose(got.cusum_down.astype(float), want.cusum_down.astype(float), atol=1e-9)
    counts = got.groupby(["k", "trend_status"]).size()
    assert counts["flat", "NO_BASELINE"] == len(ends) and counts["a", "NO_VALUE"] > 8 and counts["b", "NO_VALUE"] > 8


def test_a_dead_series_starts_anew(spark, tmp_path):
    data = rows(400, "2024-01-01", "10min", 7)
    quiet = (data.id > 60) & (data.id < 300) & (data.k == "a")
    stream = as_stream(spark, tmp_path, [data[(data.id < 150) & ~quiet], data[(data.id >= 150) & ~quiet]])
    feed = feeds.metric_feed(stream, ["k"], "ts", "x", "2 hours", "1 hour").withColumns(
        {"baseline_mean": F.lit(1.0), "baseline_std": F.lit(0.1)})
    got = feeds.run_to_table(feeds.stream_drift_monitor(feed, "k", expire_windows=4), "t").where("k = 'a'").orderBy(
        "window_end").toPandas()
    status = got.trend_status.tolist()
    assert status.count("NO_VALUE") == 4  # then it is forgotten
    back = got[got.window_end > got[got.trend_status == "NO_VALUE"].window_end.max()]
    assert back.position.tolist()[:3] == [1, 2, 3] and len(back) > 3
