"""Poisson mixing: the distribution, its repeatability and the target weights."""

import hashlib
import math

import pytest

from plumbline.llm.mixing import mix_sources, mixed_rows, poisson_steps


def unit(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:13], 16) / 2 ** 52


def poisson(rate, u):
    k, p = 0, math.exp(-rate)
    total = p
    while total <= u and k < rate + 12 * math.sqrt(rate) + 40:
        k += 1
        p *= rate / k
        total += p
    return k


@pytest.mark.parametrize("sources", [10_000, 0])
def test_counts_are_the_inverse_distribution(spark, sources):
    sizes = {"a": 300, "b": 60, None: 20}
    rows = [(i, "x" * (5 + i % 7), s) for s, n in sizes.items() for i in range(1000 * len(str(s)), 1000 * len(str(s)) + n)]
    rows += [(5, None, "none"), (6, "", "none"), (None, "xyz", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix_sources(docs.repartition(4), broadcast_sources=sources).collect()
    own = {}
    for i, t, s in rows:
        own[s] = own.get(s, 0) + len(t or "")
    total = sum(own.values())
    weights = {s: math.sqrt(n) for s, n in own.items()}
    want = []
    for i, t, s in rows:
        rate = weights[s] / sum(weights.values()) * total / own[s] if own[s] else 0.0
        for c in range(poisson(rate, unit(f"7|{'' if i is None else i}|count"))):
            want.append((unit(f"7|{'' if i is None else i}|{c}|place"), repr(i), c, s))
    keys = [r._mix.key for r in got]
    assert keys == sorted(keys)
    assert sorted((r._mix.key, repr(r.doc_id), r._mix.copy, r.source) for r in got) == sorted(
        want, key=lambda w: (w[0], w[1], w[2])) or sorted(map(repr, want)) == sorted(
        repr((r._mix.key, repr(r.doc_id), r._mix.copy, r.source)) for r in got)


def test_target_weights_are_met(spark):
    docs = spark.range(30_000).selectExpr(
        "id AS doc_id", "repeat('x', 10) AS text", "if(id % 10 = 0, 'small', 'large') AS source")
    counts = {r.source: r.n for r in mix_sources(docs).groupBy("source").count().withColumnRenamed(
        "count", "n").collect()}
    assert counts["small"] / sum(counts.values()) == pytest.approx(0.25, abs=0.01)
    assert sum(counts.values()) == pytest.approx(30_000, rel=0.03)


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", None)],
                                 "doc_id long, text string, source string")
    assert mix_sources(docs).count() == 0 and mix_sources(docs.limit(0)).count() == 0
    same = spark.createDataFrame([(1, "xx", "a")] * 3, "doc_id long, text string, source string")
    assert mix_sources(same).count() % 3 == 0
    with pytest.raises(ValueError):
        mix_sources(docs.withColumn("_MIX", docs.doc_id))
    own = same.selectExpr("*", "1 AS _mix", "2 AS _mix_u", "3 AS _row", "4 AS _id", "5 AS steps", "6 AS _u")
    assert mixed_rows(own).select("_row.*").columns == own.columns


def test_rows_are_drawn_once(spark):
    docs = spark.range(1000).selectExpr("id AS doc_id", "repeat('x', 10) AS text", "'s' AS source")
    plan = mix_sources(docs)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and plan.count("Exchange ") - plan.count("BroadcastExchange ") == 1


def test_rates_beyond_the_range_of_exp(spark):
    docs = spark.range(400).selectExpr("id AS doc_id", "'x' AS text", "'s' AS source")
    counts = [r.n for r in mix_sources(docs, target_size=400 * 1200.0).groupBy("doc_id").count()
              .withColumnRenamed("count", "n").collect()]
    assert len(counts) == 400
    mean = sum(counts) / 400
    assert mean == pytest.approx(1200, abs=4 * math.sqrt(1200 / 400))
    assert sum((c - mean) ** 2 for c in counts) / 399 == pytest.approx(1200, rel=0.3)
    for rate in (0.0, 0.3, 1.0, 7.5, 700.0, 745.0, 3000.5, 60_000.0):
        steps = poisson_steps(rate)
        chance = [b - a for a, b in zip([0.0, *steps], steps)]
        middle = sum(k * p for k, p in enumerate(chance))
        assert middle == pytest.approx(rate, rel=1e-9, abs=1e-9)
        assert sum((k - middle) ** 2 * p for k, p in enumerate(chance)) == pytest.approx(
            rate, rel=1e-6, abs=1e-9)
