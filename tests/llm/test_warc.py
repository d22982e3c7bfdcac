"""WARC archives: round trip, determinism, rolling and revisits."""

import base64
import gzip
import hashlib
import os

import pytest

from plumbline.llm.warc import (_record, archive_round_trip, parse_records, read_warc, shard_cuts,
                                shard_of, write_warc)
from plumbline.session import scratch_path
from pyspark.sql import functions as F

SCHEMA = "page_id long, url string, html string, _kind string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)


def sha(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_round_trip_and_revisits(spark):
    rows = [(i, f"http://a/{i}", f"<p>{i % 7}é</p>" * (i % 5)) for i in range(200)]
    rows += [(300, None, None), (301, "http://b/\r\nX: y", ""), (302, "u", "z" * 300_000)]
    got = {r.page_id: r for r in archive_round_trip(pages(spark, rows).repartition(5),
                                                    shard_bytes=2000, file_bytes=1500).collect()}
    last = {}
    for i, _, html in rows:
        last[html or ""] = max(i, last.get(html or "", -1))
    assert len(got) == len(rows)
    for i, _, html in rows:
        r, to = got[i], last[html or ""]
        assert r.payload_bytes == len((html or "").encode()) and r.payload_digest == sha(html)
        assert (r.record_type, r.refers_to) == (("response", None) if to == i else ("revisit", to))


def test_small_payloads_are_all_responses(spark):
    rows = [(1, "a", "x"), (2, "b", "x"), (3, "c", "xxxx"), (4, "d", "xxxx")]
    got = {r.page_id: r.record_type for r in archive_round_trip(pages(spark, rows), min_bytes=3).collect()}
    assert got == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def test_repeated_and_null_ids(spark):
    rows = [(1, "a", "x"), (1, "b", "x"), (1, "b", "y"), (None, "c", "x"), (None, "d", "q")]
    got = sorted((repr(r.page_id), r.record_type, r.refers_to, r.payload_digest) for r in
                 archive_round_trip(pages(spark, rows)).collect())
    assert got == sorted([("1", "response", None, sha("x")), ("1", "revisit", 1, sha("x")),
                          ("1", "response", None, sha("y")), ("None", "revisit", 1, sha("x")),
                          ("None", "response", None, sha("q"))])
    assert archive_round_trip(pages(spark, rows).limit(0)).count() == 0


def test_files_do_not_depend_on_the_partitioning(spark, tmp_path):
    rows = [(i * 37 % 1009, f"http://a/{i}", hashlib.sha512(b"%d" % (i % 400)).hexdigest() * 3)
            for i in range(500)]
    found = []
    for parts in (1, 7):
        folder = str(tmp_path / f"w{parts}")
        manifest = write_warc(pages(spark, rows).repartition(parts), folder, shard_bytes=40_000,
                              file_bytes=6_000)
        listed = {r.name: r for r in manifest.collect()}
        found.append({n: (r.sha256, r.records, r.bytes) for n, r in listed.items()})
        assert len({r.shard for r in listed.values()}) > 2 and max(r.file for r in listed.values()) > 0
        on_disk = {n for n in os.listdir(folder) if n.startswith("pages-")}
        assert on_disk == set(listed) and not any("_temporary" in n for n in os.listdir(folder))
        ordered = [listed[n] for n in sorted(listed)]
        assert all(a.last_id <= b.first_id for a, b in zip(ordered, ordered[1:]))
        content = (tmp_path / f"w{parts}" / ordered[0].name).read_bytes()
        assert gzip.decompress(content).startswith(b"WARC/1.1\r\n")
        heads = [h for h, _ in parse_records(content)]
        assert all(h["WARC-Record-ID"].startswith("<urn:uuid:") and "WARC-Block-Digest" in h for h in heads)
        (tmp_path / f"w{parts}" / "pages-stray.warc.gz").write_bytes(b"not in the manifest")
        assert read_warc(spark, manifest, folder).count() == 500
    assert found[0] == found[1]


def test_reading_is_linear_in_the_records():
    """An archive of many members is unpacked once, not once for every member."""
    import time

    def seconds(n):
        body = os.urandom(600).hex()
        content = b"".join(gzip.compress(_record("response", i, "u", f"{i}{body}".encode(), "d", None,
                                                 "2020"), 1, mtime=0) for i in range(n))
        begin = time.process_time()
        assert [int(h["X-Page-Id"]) for h, _ in parse_records(content)] == list(range(n))
        return time.process_time() - begin

    few, many = min(seconds(2_000) for _ in range(3)), seconds(20_000)
    assert many < 30 * few


def test_damaged_archives_are_refused():
    record = gzip.compress(_record("response", 1, "u", b"x" * 500, "d", None, "2020"))
    assert len(list(parse_records(record * 3))) == 3
    for content in (record + record[:-30], gzip.compress(b"HTTP/1.1 200\r\n\r\n"),
                    gzip.compress(gzip.decompress(record)[:-4])):
        with pytest.raises((ValueError, EOFError)):
            list(parse_records(content))


def test_every_shard_is_a_partition(spark):
    rows = [(i, f"u{i}", f"{i}" * 50) for i in range(400)]
    manifest = write_warc(pages(spark, rows), scratch_path(spark, "shards"), shard_bytes=5_000)
    shards = manifest.count()
    assert shards > 4
    assert len(manifest.inputFiles()) == shards  # a task wrote one shard only


def test_cuts(spark):
    ids = spark.range(1000).select(F.col("id").alias("_id"))
    cuts = shard_cuts(ids, 7)
    assert len(cuts) == 6 and cuts == sorted(cuts)
    got = ids.select("_id", shard_of(F.col("_id"), cuts).alias("s")).collect()
    assert all(r.s == sum(c <= r._id for c in cuts) for r in got)
    assert ids.select(shard_of(F.lit(None).cast("long"), cuts)).head()[0] == 0
