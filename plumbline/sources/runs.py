"""Run folders as a Spark data source: one partition per run, the run id as a column.

    spark.dataSource.register(RunArtifacts)
    spark.read.format("run_artifacts").schema("threshold double").option("file", "thresholds.json").load(root)

A run is a folder below ``root``; its records are the JSON files of the given name or ending. Filters
on ``run_id`` choose folders before anything is read. Where a run has a ``fingerprints.json``, an object
of file names and SHA-256 hashes, every file is held against it as it is read. Folders are listed by
Arrow's file systems (local, HDFS, S3, GCS).
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

FINGERPRINTS = "fingerprints.json"


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if ":/" in uri else (fs.LocalFileSystem(), uri)


@dataclass
class RunFolder(InputPartition):
    """One run and the folder it lies in."""

    run_id: str
    folder: str


def _fitted(value, kind: T.DataType):
    """A parsed JSON value as the type of its column; what does not fit is an error."""
    if value is None:
        return None
    if isinstance(kind, (T.DoubleType, T.FloatType)) and not isinstance(value, (str, bool)):
        return float(value)
    if isinstance(kind, T.StringType):
        return value if isinstance(value, str) else json.dumps(value, sort_keys=True)
    if isinstance(kind, T.ArrayType):
        return [_fitted(v, kind.elementType) for v in value]
    if isinstance(kind, T.MapType):
        return {k: _fitted(v, kind.valueType) for k, v in value.items()}
    if isinstance(kind, T.StructType):
        return tuple(_fitted(value.get(f.name), f.dataType) for f in kind)
    if isinstance(kind, T.BooleanType) and isinstance(value, bool):
        return value
    if isinstance(kind, (T.LongType, T.IntegerType)) and isinstance(value, int) and not isinstance(value, bool):
        return value
    raise ValueError(f"{value!r} is no {kind.simpleString()}")


class RunReader(DataSourceReader):
    """Plans a partition per run folder and reads its records."""

    def __init__(self, root: str, file: str, schema: T.StructType) -> None:
        self.root, self.file, self.schema = root.rstrip("/"), file, schema
        self.wanted: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for one in filters:
            values = None
            if getattr(one, "attribute", None) == ("run_id",):
                values = {one.value} if isinstance(one, EqualTo) else (
                    set(one.value) if isinstance(one, In) else None)
            if values is None:
                yield one
            else:
                self.wanted = values if self.wanted is None else self.wanted & values

    def partitions(self) -> list[RunFolder]:
        store, path = _store(self.root)
        runs = [i for i in store.get_file_info(fs.FileSelector(path)) if i.type == fs.FileType.Directory]
        return [RunFolder(i.base_name, i.path) for i in sorted(runs, key=lambda i: i.base_name)
                if self.wanted is None or i.base_name in self.wanted] or [RunFolder("", "")]

    def read(self, partition: RunFolder) -> Iterator[tuple]:
        if not partition.folder:  # no run: Spark still asks for one partition
            return
        store, _ = _store(self.root)
        files = {i.base_name: i.path for i in store.get_file_info(fs.FileSelector(partition.folder))
                 if i.type == fs.FileType.File}

        def content(name: str) -> bytes:
            with store.open_input_file(files[name]) as f:
                return f.read()

        known = json.loads(content(FINGERPRINTS)) if FINGERPRINTS in files else None
        for name in sorted(files):
            if name == FINGERPRINTS or not name.endswith(self.file):
                continue
            data = content(name)
            if known is not None and known.get(name) != hashlib.sha256(data).hexdigest():
                raise ValueError(f"{partition.run_id}/{name} does not match its fingerprint")
            for line in [data] if not data.count(b"\n{") else data.splitlines():
                if line.strip():
                    record = json.loads(line)
                    yield tuple(partition.run_id if f.name == "run_id" else _fitted(
                        record.get(f.name), f.dataType) for f in self.schema)


class RunArtifacts(DataSource):
    """The data source ``run_artifacts``; ``run_id`` is added to the schema where it is not named."""

    @classmethod
    def name(cls) -> str:
        return "run_artifacts"

    def schema(self) -> T.StructType:
        raise ValueError("state the columns of the records as a schema")

    def reader(self, schema: T.StructType) -> RunReader:
        return RunReader(self.options["path"], self.options.get("file", ".json"), schema)


def read_runs(spark: SparkSession, root: str, schema: T.StructType | str, file: str = ".json"):
    """Records of all runs below ``root`` with their ``run_id``, through the data source."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RunArtifacts)
    columns = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    whole = T.StructType([*columns.fields, T.StructField("run_id", T.StringType())])
    return spark.read.format("run_artifacts").schema(whole).option("file", file).load(root)
