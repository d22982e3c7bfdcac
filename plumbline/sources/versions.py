"""Tables of immutable files with numbered versions: overwrite, keyed upsert and exactly-once append.

Rows lie in folders that are written once. A version is a small JSON document that names the folders
it consists of, and it is what readers start from: they see the version before or the one after a
change, never a part of it. Documents are written under a temporary name and renamed, and a writer
that finds its number taken fails. A job that fails before that leaves folders nobody names, which
``vacuum`` removes.

Rows are bucketed by a hash of the key. An upsert reads and writes the buckets that incoming keys fall
into and keeps the folders of all others. An append names its writer and batch; the version records the
last batch of each writer together with its rows, so a batch that comes again changes nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators.metrics import best_row

_BUCKET = "_bucket"


class _Files:
    """The file system that holds a path, as Spark sees it."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        jvm = spark._jvm.org.apache.hadoop.fs
        self._path = jvm.Path
        self.fs = jvm.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self, folder: str) -> list[str]:
        path = self._path(folder)
        if not self.fs.exists(path):
            return []
        return [s.getPath().getName() for s in self.fs.listStatus(path)]

    def read(self, path: str) -> str:
        stream = self.fs.open(self._path(path))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, path: str, content: str) -> None:
        """A whole file under a name that nobody has taken."""
        temporary, final = self._path(f"{path}.{uuid.uuid4().hex}.tmp"), self._path(path)
        stream = self.fs.create(temporary, False)
        stream.write(bytearray(content.encode()))
        stream.close()
        if self.fs.exists(final) or not self.fs.rename(temporary, final):
            self.fs.delete(temporary, False)
            raise RuntimeError(f"{path} was written by someone else")

    def remove(self, path: str) -> None:
        self.fs.delete(self._path(path), True)


@dataclass
class Version:
    """What a version consists of: folders by bucket (``-1`` for rows without one) and the ledger."""

    number: int
    schema: str
    buckets: int
    folders: dict[str, list[str]] = field(default_factory=dict)
    ledger: dict[str, int] = field(default_factory=dict)

    def paths(self, buckets: Sequence[int] | None = None) -> list[str]:
        wanted = self.folders if buckets is None else [str(b) for b in buckets if str(b) in self.folders]
        return [f for b in wanted for f in self.folders[b]]


class VersionedTable:
    """A table below ``root``; ``keys`` are needed for upserts only.

    ``layout`` is ``parquet`` or ``json``. The number of buckets is that of the table's first version.
    """

    def __init__(self, spark: SparkSession, root: str, keys: Sequence[str] = (), *, buckets: int = 64,
                 layout: str = "parquet") -> None:
        if buckets < 1 or layout not in ("parquet", "json"):
            raise ValueError("need a bucket, and parquet or json")
        self.spark, self.root, self.keys = spark, root.rstrip("/"), list(keys)
        self.buckets, self.layout = buckets, layout
        self.files = _Files(spark, self.root)

    # --- versions ---------------------------------------------------------------------------

    def _document(self, number: int) -> str:
        return f"{self.root}/_versions/{number:012d}.json"

    def latest(self) -> int:
        """The number of the newest version, 0 for a table without one."""
        return max((int(n[:-5]) for n in self.files.names(f"{self.root}/_versions")
                    if n.endswith(".json")), default=0)

    def version(self, number: int | None = None) -> Version | None:
        number = self.latest() if number is None else number
        if not number:
            return None
        found = json.loads(self.files.read(self._document(number)))
        return Version(number, found["schema"], found["buckets"], found["folders"], found["ledger"])

    def _commit(self, before: Version | None, schema: T.StructType, folders: dict[str, list[str]],
                ledger: dict[str, int]) -> Version:
        now = Version((before.number if before else 0) + 1, schema.json(), self._buckets(before), folders,
                      ledger)
        self.files.create(self._document(now.number), json.dumps(
            {"schema": now.schema, "buckets": now.buckets, "folders": folders, "ledger": ledger}))
        return now

    def _buckets(self, before: Version | None) -> int:
        return before.buckets if before else self.buckets

    def _fitted(self, rows: DataFrame, before: Version | None) -> DataFrame:
        """Rows with the columns and types of the table."""
        if before is None:
            return rows
        schema = T.StructType.fromJson(json.loads(before.schema))
        if sorted(schema.names) != sorted(rows.columns):
            raise ValueError("the columns are not those of the table")
        kinds = dict(rows.dtypes)
        return rows.select(*[F.col(f.name) if kinds[f.name] == f.dataType.simpleString() else F.col(
            f.name).cast(f.dataType) for f in schema])

    # --- reading ----------------------------------------------------------------------------

    def _load(self, schema: T.StructType, paths: list[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read.schema(schema)
        if self.layout == "json":
            return reader.option("mode", "FAILFAST").json(paths)
        return reader.parquet(*paths)

    def read(self, number: int | None = None) -> DataFrame:
        """The rows of a version, by default the newest."""
        found = self.version(number)
        if found is None:
            raise FileNotFoundError(f"{self.root} has no version")
        return self._load(T.StructType.fromJson(json.loads(found.schema)), found.paths())

    # --- writing ----------------------------------------------------------------------------

    def _write(self, rows: DataFrame) -> str:
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        writer = rows.write
        (writer.json if self.layout == "json" else writer.parquet)(folder)
        return folder

    def overwrite(self, rows: DataFrame) -> Version:
        """A version that has these rows only; older versions stay readable until they are vacuumed."""
        before = self.version()
        folder = self._write(rows)
        return self._commit(before, rows.schema, {"-1": [folder]}, before.ledger if before else {})

    def append(self, rows: DataFrame, writer: str, batch: int) -> bool:
        """Add a writer's batch, if it is newer than the last one recorded; whether it was added."""
        before = self.version()
        if before and before.ledger.get(writer, -1) >= batch:
            return False
        rows = self._fitted(rows, before)
        folder = self._write(rows)
        folders = {b: list(f) for b, f in before.folders.items()} if before else {}
        folders.setdefault("-1", []).append(folder)
        self._commit(before, rows.schema, folders, (before.ledger if before else {}) | {writer: batch})
        return True

    def upsert(self, incoming: DataFrame, *order: str) -> Version:
        """Insert rows or replace those of the same key; of several incoming ones the last by ``order``.

        Only buckets of incoming keys are read and written. Rows without a bucket, as ``overwrite`` and
        ``append`` leave them, are filed into buckets by the first upsert after them.
        """
        if not self.keys:
            raise ValueError("an upsert needs keys")
        before = self.version()
        incoming = self._fitted(incoming, before)
        bucket = F.pmod(F.xxhash64(*[F.col(k) for k in self.keys]), F.lit(self._buckets(before))).cast("int")
        new = incoming.withColumn(_BUCKET, bucket)
        loose = bool(before and before.folders.get("-1"))
        # at most as many numbers as there are buckets
        touched = None if loose else sorted(r[0] for r in new.select(_BUCKET).distinct().collect())
        old = self._load(incoming.schema, before.paths(touched) if before else [])
        both = old.withColumn(_BUCKET, bucket).withColumn("_new", F.lit(0)).unionByName(
            new.withColumn("_new", F.lit(1)))
        last = best_row(both, [_BUCKET, *self.keys], F.struct("_new", *order)).select(
            *incoming.columns, _BUCKET)
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        writer = last.repartition(_BUCKET).write.partitionBy(_BUCKET)
        (writer.json if self.layout == "json" else writer.parquet)(folder)
        written = {n.split("=")[1]: [f"{folder}/{n}"] for n in self.files.names(folder)
                   if n.startswith(f"{_BUCKET}=")}
        kept = {} if loose or not before else {b: f for b, f in before.folders.items() if b not in written}
        return self._commit(before, incoming.schema, kept | written, before.ledger if before else {})

    def compact(self) -> Version:
        """The newest rows in one folder; a table that many batches were added to reads faster."""
        return self.overwrite(self.read())

    def vacuum(self, keep: int = 2) -> int:
        """Remove all but the newest ``keep`` versions and the folders that no kept one names.

        Not to be run beside a writer, whose folders no version names yet.
        """
        numbers = sorted(int(n[:-5]) for n in self.files.names(f"{self.root}/_versions") if n.endswith(".json"))
        named = {p for n in numbers[-keep:] for p in self.version(n).paths()}
        tops = {p.removeprefix(f"{self.root}/data/").split("/")[0] for p in named}
        gone = [n for n in self.files.names(f"{self.root}/data") if n not in tops]
        for number in numbers[:-keep]:
            self.files.remove(self._document(number))
        for name in gone:
            self.files.remove(f"{self.root}/data/{name}")
        return len(gone)


def stream_into(stream: DataFrame, table: VersionedTable, writer: str, checkpoint: str) -> None:
    """Add everything a stream has to a table, each batch once, also if it is processed again."""
    query = stream.writeStream.foreachBatch(
        lambda rows, batch: table.append(rows, writer, batch)).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
