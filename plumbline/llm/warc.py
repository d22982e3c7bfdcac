"""A deterministic sharded WARC writer.

Records are range-sorted by page id. The cuts between shards are quantiles of the ids with the
smallest hashes, a bounded sample that depends on the ids alone, so that every run on every cluster
cuts alike. A task writes its shards in order and rolls to a new file once the compressed size is
reached. Headers, record ids and digests are made anew from the payload; every record is a gzip
member of its own. Files are written under temporary names and renamed, and the manifest, written
last by Spark's own committed write, names the files that count.

Of records with equal payloads (by SHA-1) the one with the largest page id is a response and the
others revisit it; payloads below ``min_bytes`` are never revisits. The groups are reduced to their
largest id before anything is joined, so a payload that many pages share gathers nowhere.

Cases: null and empty html is an empty payload. A null page id is smaller than any other and is
written without an id. Of rows with one page id and one payload the first in (url) order is the
response and the others revisit it; other repeated ids are pages of their own. An empty table
writes no file and gives an empty result. Only page id, url and html are read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.files import commit_file, read_file
from plumbline.llm.text import whole
from plumbline.session import materialize, scratch_path

_FILES = ("shard int, file int, name string, records long, bytes long, sha256 string, "
          "first_id long, last_id long")
_SAMPLE = 20_000  # ids that decide the cuts, at most about


def shard_cuts(ids: DataFrame, shards: int) -> list[int]:
    """``shards - 1`` cuts at quantiles of a hash-chosen sample of the long column ``_id``."""
    known = ids.filter("_id is not null").select("_id", F.xxhash64(F.lit("cut"), "_id").alias("_h"))
    count = known.count()
    if shards < 2 or not count:
        return []
    share = F.pmod("_h", F.lit(1 << 32)) / float(1 << 32)
    chosen = sorted(r[0] for r in known.filter(share < _SAMPLE / count).select(
        "_id").distinct().collect())
    return sorted({chosen[len(chosen) * k // shards] for k in range(1, shards)}) if chosen else []


def shard_of(col: Column, cuts: list[int]) -> Column:
    """The number of cuts at or below the value, by bisection; nulls are in shard 0."""
    if not cuts:
        return F.lit(0)
    steps = [1 << k for k in reversed(range(len(cuts).bit_length()))]
    table = F.lit(cuts)
    found = F.aggregate(F.lit(steps), F.lit(0), lambda at, step: F.when(
        F.coalesce(F.get(table, at + step - 1) <= col, F.lit(False)), at + step).otherwise(at))
    return found


def plan_records(pages: DataFrame, id_col: str, url_col: str, html_col: str,
                 min_bytes: int) -> DataFrame:
    """Pages and, for those that are revisits, an extra row with the id they refer to."""
    read = pages.select(F.col(id_col).cast("long").alias("_id"), F.col(url_col).alias("_url"),
                        whole(html_col).alias("_html"))
    digests = read.select("_id", F.sha1(F.col("_html").cast("binary")).alias("_digest"),
                          F.octet_length("_html").alias("_size")).filter(
                              F.col("_size") >= min_bytes)
    groups = digests.groupBy("_digest").agg(F.max("_id").alias("_refers"),
                                            F.count("*").alias("_rows")).filter("_rows > 1")
    revisits = digests.join(groups, "_digest").select("_id", "_digest", "_refers").distinct()
    return read.select("_id", F.lit(1).alias("_kind"), "_url", "_html",
                       F.lit(None).cast("string").alias("_digest"),
                       F.lit(None).cast("long").alias("_refers")).unionByName(revisits.select(
                           "_id", F.lit(0).alias("_kind"), F.lit(None).cast("string").alias("_url"),
                           F.lit(None).cast("string").alias("_html"), "_digest", "_refers"))


def _record(kind: str, page: int | None, url: str | None, payload: bytes, digest: str,
            refers: int | None, date: str) -> bytes:
    """One WARC record, uncompressed."""
    def name(of: int | None) -> str:
        return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{of}/{digest}')}>"

    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode()
    block = http + payload if kind == "response" else http
    own = name(page) if kind == "response" else f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page}/{url}/{digest}/revisit')}>"  # noqa: E501
    head = [("WARC-Type", kind), ("WARC-Record-ID", own), ("WARC-Date", date)]
    if url is not None:
        head.append(("WARC-Target-URI", "".join(url.split())))
    if kind == "revisit":
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                 ("WARC-Refers-To", name(refers)),
                 ("X-Refers-To-Page", "" if refers is None else str(refers))]
    head += [("WARC-Payload-Digest", f"sha1:{digest}"),
             ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"),
             ("X-Page-Id", "" if page is None else str(page)),
             ("X-Payload-Length", str(len(payload))),
             ("Content-Type", "application/http; msgtype=response"),
             ("Content-Length", str(len(block)))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head)
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def base32_sha1(content: bytes) -> str:
    return base64.b32encode(hashlib.sha1(content).digest()).decode()


def _write(folder: str, min_bytes: int, file_bytes: int, date: str, level: int):
    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number, out, ids = None, 0, io.BytesIO(), []
        refers: dict[str, int | None] = {}
        told: object = ()
        responded: set[str] = set()

        def close() -> pa.RecordBatch:
            nonlocal number, out
            content = out.getvalue()
            name = f"pages-{shard:06d}-{number:06d}.warc.gz"
            commit_file(folder, name, content)
            known = [i for i in ids if i is not None]
            row = [shard, number, name, len(ids), len(content), hashlib.sha256(content).hexdigest(),
                   min(known, default=None), max(known, default=None)]
            number, out = number + 1, io.BytesIO()
            ids.clear()
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string(),
                     pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in zip(row, kinds)],
                [c.split()[0] for c in _FILES.split(", ")])

        for batch in batches:
            for row in batch.to_pylist():
                if row["_shard"] != shard:
                    if ids:
                        yield close()
                    shard, number = row["_shard"], 0
                if told != (row["_id"],):  # all rows of a page stand together
                    told = (row["_id"],)
                    refers.clear()
                    responded.clear()
                if row["_kind"] == 0:
                    refers[row["_digest"]] = row["_refers"]
                    continue
                payload = row["_html"].encode("utf-8", "surrogatepass")
                sha = hashlib.sha1(payload)
                key, digest = sha.hexdigest(), base64.b32encode(sha.digest()).decode()
                to = refers.get(key, row["_id"])
                revisit = key in refers and len(payload) >= min_bytes and (
                    to != row["_id"] or key in responded)
                responded.add(key)
                record = _record("revisit" if revisit else "response", row["_id"], row["_url"],
                                 payload, digest, to, date)
                out.write(gzip.compress(record, level, mtime=0))
                ids.append(row["_id"])
                if out.tell() >= file_bytes:
                    yield close()
        if ids:
            yield close()

    return write


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url",
               html_col: str = "html", *, min_bytes: int = 0, shard_bytes: int = 256 << 20,
               file_bytes: int = 64 << 20, date: str = "2020-01-01T00:00:00Z",
               level: int = 6) -> DataFrame:
    """Write the archives to ``folder`` and return the manifest: one row per file.

    A shard covers about ``shard_bytes`` of payload; a file ends after ``file_bytes`` compressed.
    The manifest is also written to ``folder/manifest``, last of all.
    """
    spark = pages.sparkSession
    size = pages.agg(F.sum(F.octet_length(whole(html_col)))).first()[0] or 0
    shards = -(-int(size) // shard_bytes) or 1
    cuts = shard_cuts(pages.select(F.col(id_col).cast("long").alias("_id")), shards)
    rows = plan_records(pages, id_col, url_col, html_col, min_bytes).withColumn(
        "_shard", shard_of(F.col("_id"), cuts))
    ordered = rows.repartitionById(len(cuts) + 1, "_shard").sortWithinPartitions(
        "_shard", "_id", "_kind", "_digest", "_url", "_html")
    files = ordered.mapInArrow(_write(folder, min_bytes, file_bytes, date, level), _FILES)
    files.write.parquet(f"{folder}/manifest")
    return spark.read.schema(files.schema).parquet(f"{folder}/manifest")


def parse_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of every record of an archive, unpacked as it is read."""
    with io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content)), 1 << 17) as stream:
        while first := stream.readline():
            if not first.startswith(b"WARC/"):
                raise ValueError("not a WARC record")
            head = {}
            while line := stream.readline().rstrip(b"\r\n"):
                name, _, value = line.decode().partition(":")
                head[name] = value[1:]
            block = stream.read(int(head["Content-Length"]))
            if stream.read(4) != b"\r\n\r\n":
                raise ValueError("a WARC record is cut short")
            yield head, block


def _number(text: str) -> int | None:
    return int(text) if text.strip() else None


def _read(folder: str):
    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, sha in zip(batch["name"].to_pylist(), batch["sha256"].to_pylist()):
                content = read_file(folder, name)
                if hashlib.sha256(content).hexdigest() != sha:
                    raise ValueError(f"{name} is not the file of the manifest")
                cols: list[list] = [[], [], [], [], []]
                for head, block in parse_records(content):
                    digest, kind = head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"]
                    size = int(head["X-Payload-Length"])
                    if kind == "response":
                        payload = block[block.index(b"\r\n\r\n") + 4:]
                        if (base32_sha1(payload), len(payload)) != (digest, size):
                            raise ValueError(f"{name} has a damaged record")
                    for col, value in zip(cols, (
                            _number(head["X-Page-Id"]), size, digest, kind,
                            _number(head["X-Refers-To-Page"]) if kind == "revisit" else None)):
                        col.append(value)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(),
                                                           pa.string(), pa.int64()))],
                    ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
    return read


def read_warc(spark: SparkSession, manifest: DataFrame, folder: str) -> DataFrame:
    """One row per record of the files in the manifest, with digests checked."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("name", "sha256").repartition(parts, "name").mapInArrow(
        _read(folder), "page_id long, payload_bytes long, payload_digest string, "
                       "record_type string, refers_to long")


def archive_round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write to a new folder of the shared storage and read the archives back."""
    folder = scratch_path(pages.sparkSession, "warc")
    return read_warc(pages.sparkSession, write_warc(pages, folder, **options), folder)
