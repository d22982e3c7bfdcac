"""Versioned tables: what changes, what stays, and what a failure or a replay leaves."""

import os

import pytest
from pyspark.sql import functions as F

from plumbline.sources.files import read_manifest, write_manifest
from plumbline.sources.versions import VersionedTable, stream_into

SCHEMA = "k long, v string, seq int"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def content(table, number=None):
    return sorted(tuple(r) for r in table.read(number).collect())


def files_of(table):
    return {os.path.join(d, f) for p in table.version().paths() for d, _, names in os.walk(p)
            for f in names if f.startswith("part-")}


def test_upsert_touches_only_the_buckets_of_its_keys(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), ["k"], buckets=8)
    table.upsert(frame(spark, [(i, "old", 0) for i in range(200)]), "seq")
    before = files_of(table)
    table.upsert(frame(spark, [(7, "new", 1), (7, "newer", 2), (7, "new", 0)]), "seq")
    after = files_of(table)
    assert len(before & after) >= len(before) - 1 and len(after - before) == 1
    assert content(table) == sorted([(i, "old", 0) for i in range(200) if i != 7] + [(7, "newer", 2)])
    assert len(content(table, 1)) == 200 and (7, "old", 0) in content(table, 1)
    table.upsert(frame(spark, [(1000, "added", 0), (None, "no key", 0), (None, "again", 1)]), "seq")
    assert (None, "again", 1) in table.read().select("k", "v", "seq").collect() and table.read().count() == 202
    # another number of buckets and narrower keys fit the table that is there
    other = VersionedTable(spark, str(tmp_path / "t"), ["k"], buckets=3)
    other.upsert(spark.createDataFrame([(7, "last", 9)], "k int, v string, seq int"), "seq")
    assert [r for r in other.read().collect() if r.k == 7] == [(7, "last", 9)]
    assert other.read().count() == 202


def test_a_failed_job_leaves_the_version_before(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), ["k"], buckets=4)
    table.upsert(frame(spark, [(1, "a", 0), (2, "b", 0)]), "seq")

    @F.udf("string")
    def broken(v):
        raise RuntimeError("lost")

    bad = frame(spark, [(1, "x", 1), (3, "y", 1)]).withColumn("v", broken("v"))
    for write in (lambda: table.upsert(bad, "seq"), lambda: table.overwrite(bad),
                  lambda: table.append(bad, "w", 0)):
        with pytest.raises(Exception, match="lost"):
            write()
    assert content(table) == [(1, "a", 0), (2, "b", 0)] and table.latest() == 1
    with pytest.raises(ValueError):
        table.append(frame(spark, [(1, "a", 0)]).drop("seq"), "w", 0)
    with pytest.raises(FileNotFoundError):
        VersionedTable(spark, str(tmp_path / "none")).read()


def test_a_second_writer_of_a_version_fails(spark, tmp_path, monkeypatch):
    table = VersionedTable(spark, str(tmp_path / "t"))
    table.overwrite(frame(spark, [(1, "a", 0)]))
    old = table.version()
    table.overwrite(frame(spark, [(2, "b", 0)]))
    monkeypatch.setattr(table, "version", lambda number=None: old)
    with pytest.raises(RuntimeError, match="someone else"):
        table.overwrite(frame(spark, [(3, "c", 0)]))
    monkeypatch.undo()
    assert content(table) == [(2, "b", 0)]


def test_append_once_vacuum_and_compact(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), ["k"], buckets=4)
    assert table.append(frame(spark, [(1, "a", 0)]), "one", 0)
    assert table.append(frame(spark, [(1, "a", 0)]), "two", 0)
    assert not table.append(frame(spark, [(1, "a", 0)]), "one", 0)
    assert table.append(frame(spark, [(2, "b", 0)]), "one", 5)
    assert not table.append(frame(spark, [(9, "z", 0)]), "one", 4)
    assert content(table) == [(1, "a", 0), (1, "a", 0), (2, "b", 0)]
    table.compact()
    assert len(table.version().paths()) == 1 and not table.append(frame(spark, []), "one", 5)
    assert table.vacuum(keep=1) == 3 and len(os.listdir(tmp_path / "t" / "_versions")) <= 2
    table.upsert(frame(spark, [(1, "c", 1)]), "seq")  # files the loose rows into buckets
    assert content(table) == [(1, "c", 1), (2, "b", 0)] and "-1" not in table.version().folders


def test_stream_replay_changes_nothing(spark, tmp_path):
    source = tmp_path / "in"
    for i in range(3):
        frame(spark, [(i, "x", i)]).coalesce(1).write.mode("append").parquet(str(source))
    table = VersionedTable(spark, str(tmp_path / "t"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(source))
    for run in range(2):
        stream_into(stream, table, "feed", str(tmp_path / f"checkpoint{run}"))
        assert content(table) == [(0, "x", 0), (1, "x", 1), (2, "x", 2)]
    assert max(table.version().ledger.values()) == table.latest() - 1


def test_manifests_are_replaced_whole(spark, tmp_path):
    from plumbline.sources.files import FILE_COLUMNS

    def rows(n):
        return spark.createDataFrame([("d", *[f"{c}{i}" for c in FILE_COLUMNS]) for i in range(n)],
                                     ["dataset_id", *FILE_COLUMNS])

    path = str(tmp_path / "m")
    write_manifest(rows(3), path)
    write_manifest(rows(2), path)
    schema = rows(1).withColumn("manifest_sha256", F.lit("")).schema
    assert read_manifest(spark, path, schema).count() == 2
    assert VersionedTable(spark, path, layout="json").read(1).count() == 3
