"""The data source of run folders: planned partitions, pushed filters, fingerprints."""

import hashlib
import json

import pytest

from plumbline.sources.runs import FINGERPRINTS, RunReader, read_runs
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = "threshold double, name string, tags array<string>, n long"


@pytest.fixture
def root(tmp_path):
    for i in range(6):
        folder = tmp_path / f"run{i}"
        folder.mkdir()
        text = json.dumps({"threshold": i, "name": f"m{i}", "tags": ["a", "b"], "n": None if i == 3 else i})
        (folder / "thresholds.json").write_text(text)
        (folder / "notes.txt").write_text("not a record")
        if i % 2:
            (folder / FINGERPRINTS).write_text(json.dumps({"thresholds.json": hashlib.sha256(text.encode()).hexdigest()}))
    (tmp_path / "loose.json").write_text("{}")
    return tmp_path


def test_reads_all_runs_with_their_ids(spark, root):
    got = {r.run_id: r for r in read_runs(spark, str(root), SCHEMA, "thresholds.json").collect()}
    assert set(got) == {f"run{i}" for i in range(6)}
    assert (got["run4"].threshold, got["run4"].name, got["run4"].tags, got["run4"].n) == (4.0, "m4", ["a", "b"], 4)
    assert got["run3"].n is None


def test_filters_on_the_run_choose_folders(spark, root):
    runs = read_runs(spark, str(root), SCHEMA)
    for i in (0, 1, 4, 5):  # what is left out is never opened
        (root / f"run{i}" / "thresholds.json").write_text("broken")
    assert runs.where(F.col("run_id").isin("run2", "run3") & (F.col("threshold") > 2)).select("run_id").collect() == [("run3",)]
    one = runs.where("run_id = 'run2'")
    assert [r.threshold for r in one.collect()] == [2.0] and one.rdd.getNumPartitions() == 1
    assert runs.where("run_id = 'none'").count() == 0
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan.replace("PushedFilters", "") or "run2" not in plan.split("Filter")[1][:60]


def test_one_partition_per_run(root):
    reader = RunReader(str(root), ".json", T.StructType.fromDDL(SCHEMA))
    assert [p.run_id for p in reader.partitions()] == [f"run{i}" for i in range(6)]


def test_a_changed_file_is_refused(spark, root):
    (root / "run1" / "thresholds.json").write_text('{"threshold": 99}')
    runs = read_runs(spark, str(root), SCHEMA)
    with pytest.raises(Exception, match="does not match its fingerprint"):
        runs.collect()
    assert runs.where("run_id = 'run0'").count() == 1  # has no fingerprints
    (root / "run0" / "thresholds.json").write_text('{"threshold": "high"}')
    with pytest.raises(Exception, match="is no double"):
        runs.where("run_id = 'run0'").collect()
