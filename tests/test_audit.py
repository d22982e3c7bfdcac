import datetime
import hashlib
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline import schemas
from plumbline.operators import audit


def file_rows(spark, rows):
    return spark.createDataFrame(
        rows, "dataset_id string, sha256 string, source string, name string, split string")


def test_leakage(spark):
    df = file_rows(spark, [("d", "h1", "s1", "n1", "train"), ("d", "h1", "s2", "n2", "test"),
                           ("d", "h2", "s3", "n3", "train"), ("d", "h3", "s4", "n3", "validation"),
                           ("e", "h9", "s9", "n9", "train"), ("e", "h8", "s8", "n9", "test")])
    found = audit.leakage_audit(df, "dataset_id", "sha256", "source", "name")
    assert {(r.dataset_id, r.kind, r.key, tuple(r.splits)) for r in found.collect()} == {
        ("d", "content_hash", "h1", ("test", "train")),
        ("d", "normalized_name", "n3", ("train", "validation")),
        ("e", "normalized_name", "n9", ("test", "train"))}
    status = {r.dataset_id: r.status for r in audit.leakage_status(df, found, "dataset_id").collect()}
    assert status == {"d": "FAIL", "e": "PASS"}
    with pytest.raises(ValueError):
        audit.require_no_leakage(found)
    audit.require_no_leakage(found.where("dataset_id = 'e'"))


@pytest.mark.parametrize("n_groups,fraction", [(4, 0.25), (1, 0.5), (2, 0.99), (20, 0.125),
                                               (500, 0.3), (3, 0.01)])
def test_group_split_equals_sorted_hashes(spark, n_groups, fraction):
    groups = [f"g{i}" for i in range(n_groups)]
    df = spark.createDataFrame([(i, g) for i, g in enumerate(groups * 2)], "item int, grp string")
    got = audit.group_split(df, "grp", fraction, 42)
    chosen = {r.grp for r in got.where("assigned_split = 'validation'").collect()}
    ranked = sorted(groups, key=lambda g: hashlib.sha256(f"42:{g}".encode()).hexdigest())
    k = max(1, round(n_groups * fraction))
    k = min(k, n_groups - 1) if n_groups > 1 else k
    assert chosen == set(ranked[:k])
    assert got.count() == 2 * n_groups
    assert got.groupBy("grp").agg(F.countDistinct("assigned_split").alias("n")).where(
        "n > 1").count() == 0
    with pytest.raises(ValueError):
        audit.group_split(df, "grp", 1.0, 42)


def test_dedupe_keeps_first_path_even_when_a_third_is_one_hash(spark):
    rows = [(f"p{i:04d}", "hot" if i % 3 == 0 else f"h{i % 50}") for i in range(600)]
    out = audit.dedupe_first(spark.createDataFrame(rows, "path string, sha string"), "sha", "path")
    kept = {r.sha: r.path for r in out.where("error_code is null").collect()}
    want = {}
    for p, h in rows:
        want.setdefault(h, p)
    assert kept == want and out.count() == 600


def test_fingerprint_ignores_order_and_sees_changes(spark):
    df = spark.range(500).select(F.lit("d").alias("dataset_id"), F.col("id").cast("string").alias("a"),
                                 F.when(F.col("id") % 2 == 0, "x").alias("b"))

    def fp(frame):
        return audit.set_fingerprint(frame, ["dataset_id"], ["a", "b"], ["dataset_id"]
                                     ).head().fingerprint

    base = fp(df)
    assert fp(df.repartition(7).orderBy(F.rand(1))) == base
    changed = df.withColumn("a", F.when(F.col("a") == "7", "8").otherwise(F.col("a")))
    assert fp(changed) != base
    assert fp(df.where("a <> '499'")) != base
    assert fp(df.union(df.where("a = '1'"))) != base
    assert fp(df.withColumn("b", F.coalesce("b", F.lit("null")))) != base


def test_config_hash_sorts_keys_at_every_level(spark):
    docs = ['{"b": 1, "a": {"z": [3, 1], "y": "q"}}', '{"a":{"y":"q","z":[3,1]},"b":1}']
    df = spark.createDataFrame([(d,) for d in docs], "t string")
    want = hashlib.sha256(json.dumps(json.loads(docs[0]), sort_keys=True,
                                     separators=(",", ":")).encode()).hexdigest()
    assert {r.h for r in df.select(audit.config_hash(F.col("t")).alias("h")).collect()} == {want}


def brute_hash(px, size):
    px = np.asarray(px, float)
    b = px.reshape(size, px.shape[0] // size, size, px.shape[1] // size).mean(axis=(1, 3)).ravel()
    bits = "".join("1" if v >= b.mean() else "0" for v in b)
    return f"{int(bits, 2):0{size * size // 4}x}"


@pytest.mark.parametrize("size", [2, 4, 8])
def test_average_hash(spark, size):
    rng = np.random.default_rng(3)
    px = rng.integers(0, 255, (30, 16, 8))
    df = spark.createDataFrame(pd.DataFrame({"i": range(30), "px": [p.ravel().tolist() for p in px]}))
    got = df.select("i", audit.average_hash(F.col("px"), 16, 8, size).alias("h")).orderBy("i").collect()
    assert [r.h for r in got] == [brute_hash(p, size) for p in px]


@pytest.mark.parametrize("d,blocks", [(3, None), (3, 4), (1, 4), (2, 5)])
@pytest.mark.parametrize("hot", [3, 10_000])
def test_near_duplicates_finds_every_pair(spark, d, blocks, hot):
    rng = np.random.default_rng(6)
    centres = [int(x) for x in rng.integers(0, 2**63, 12)]
    values = [0] * 100 + list(centres)
    for c in centres:
        for _ in range(12):
            v = c
            for bit in rng.choice(64, rng.integers(1, 7), replace=False):
                v ^= 1 << int(bit)
            values.append(v)
    df = spark.createDataFrame([(i, f"{v:016x}") for i, v in enumerate(values)], "id long, h string")
    groups = audit.hash_groups(df, "id", "h")
    assert groups.where("hash = '0000000000000000'").head().copies == 100
    got = audit.near_duplicates(groups, d, blocks, hot_rows=hot).collect()
    pairs = [(r.hash_a, r.hash_b, r.distance) for r in got]
    distinct = sorted({f"{v:016x}" for v in values})
    want = [(a, b, (int(a, 16) ^ int(b, 16)).bit_count()) for i, a in enumerate(distinct)
            for b in distinct[i + 1:] if (int(a, 16) ^ int(b, 16)).bit_count() <= d]
    assert sorted(pairs) == sorted(want) and len(pairs) > 5


def test_a_dense_cluster_is_filed_until_its_bins_fit(spark):
    """Four thousand hashes within three bits of one value: no bin stays hot and no pair is lost."""
    rng = np.random.default_rng(8)
    bits = np.zeros((4_000, 128), np.float32)
    for row in bits:
        row[rng.choice(128, rng.integers(0, 4), replace=False)] = 1
    bits = np.unique(bits, axis=0)
    centre = int.from_bytes(rng.bytes(16), "big")
    packed = np.packbits(bits.astype(np.uint8), axis=1)
    names = [f"{int.from_bytes(p.tobytes(), 'big') ^ centre:032x}" for p in packed]
    groups = audit.hash_groups(spark.createDataFrame(list(enumerate(names)), "id long, h string"), "id", "h")
    pairs = audit.near_duplicates(groups, 3, digits=32, hot_rows=400)
    got = pairs.groupBy("distance").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(
        F.concat("hash_a", "hash_b")).alias("m")).collect()
    weight, want = bits.sum(axis=1), np.zeros(4, np.int64)
    for at in range(0, len(bits), 2000):
        d = weight[at:at + 2000, None] + weight[None] - 2 * bits[at:at + 2000] @ bits.T
        want += np.bincount(d[d <= 3].astype(int), minlength=4)
    assert {r.distance: r.n for r in got} == {i: n // 2 for i, n in enumerate(want.tolist()) if i and n}
    assert all(r.n == r.m for r in got)  # every pair once
    keyed = groups.selectExpr("hash", "item", "copies", "0 AS choice", "substring(hash, 1, 16) AS key",
                              "substring(hash, 17) AS rest", "cast(array() AS array<string>) AS skipped")
    largest = audit._filed(keyed, 4, 100).where("length(rest) >= 4").groupBy("choice", "key").count().agg(
        F.max("count")).first()[0]
    assert largest <= 100 < keyed.groupBy("key").count().agg(F.max("count")).first()[0]


def test_closed_schema_and_contract(spark, tmp_path):
    row = dict(rollback_id="r", from_model_id="a", to_model_id="b", reason="LATENCY",
               triggered_by="me", incident_id=None, created_at=datetime.datetime(2024, 1, 1))
    df = spark.createDataFrame([row], schemas.tables()["rollback_events"])
    ok = {r.rule: r.violations for r in schemas.violations(df, "rollback_events").collect()}
    assert set(ok.values()) == {0}
    bad = df.withColumn("reason", F.lit("MOOD")).withColumn("triggered_by", F.lit(None).cast("string"))
    got = {r.rule: r.violations for r in schemas.violations(bad, "rollback_events").collect()}
    assert got["reason_allowed"] == 1 and got["triggered_by_present"] == 1
    with pytest.raises(ValueError):
        schemas.conform(df.withColumn("extra", F.lit(1)), "rollback_events")
    path = str(tmp_path / "t")
    df.write.json(path)
    assert schemas.read_json_table(spark, "rollback_events", path).head().reason == "LATENCY"
    other = str(tmp_path / "u")
    df.withColumn("extra", F.lit(1)).write.json(other)
    with pytest.raises(ValueError):
        schemas.read_json_table(spark, "rollback_events", other)
    for name in schemas.tables():
        assert schemas.contract(name)
