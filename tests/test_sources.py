import hashlib
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators import governance, images, scoring
from plumbline.sources import files, sinks
from plumbline.sources.versions import VersionedTable


def png(path, rgb):
    h, w, _ = rgb.shape
    raw = b"".join(b"\0" + rgb[y].tobytes() for y in range(h))

    def chunk(kind, data):
        body = kind + data
        return struct.pack(">I", len(data)) + body + struct.pack(">I", zlib.crc32(body))

    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0))
                     + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def picture(seed, h=72, w=80):
    return np.random.default_rng(seed).integers(0, 256, (h, w, 3)).astype(np.uint8)


@pytest.fixture
def dataset(tmp_path):
    root = tmp_path / "data" / "carpet"
    for i in range(4):
        png(root / "train/good" / f"{i:03d}.png", picture(i))
    for i in range(2):
        png(root / "test/good" / f"g{i}.PNG", picture(10 + i))
        png(root / "test/tear" / f"t{i}.png", picture(20 + i))
        png(root / "ground_truth/tear" / f"t{i}_mask.png", picture(30 + i))
    (root / "readme.txt").write_text("not an image")
    return tmp_path / "data"


def test_scan_hash_and_inventory(spark, dataset):
    found = {r.path.rsplit("/", 1)[1]: r for r in files.hash_files(spark, str(dataset)).collect()}
    assert len(found) == 10 and "readme.txt" not in found
    raw = (dataset / "carpet/train/good/000.png").read_bytes()
    assert found["000.png"].sha256 == hashlib.sha256(raw).hexdigest()
    counts = files.inventory(files.hash_files(spark, str(dataset)), "path").collect()
    assert [(r.suffix, r.images) for r in counts] == [("png", 10)]


def test_decode_is_rgb_and_keeps_broken_files(spark, dataset):
    (dataset / "carpet/train/good/bad.png").write_bytes(b"no picture")
    out = files.scan_images(spark, str(dataset / "carpet/train"))
    bad = out.where("error_code is not null").collect()
    assert [r.path.rsplit("/", 1)[1] for r in bad] == ["bad.png"] and bad[0].height is None
    row = files.to_rgb(out).where(F.col("image_id").endswith("001.png")).head()
    assert (np.frombuffer(row.pixels, np.uint8).reshape(72, 80, 3) == picture(1)).all()


def test_read_dataset_pairs_masks(spark, dataset):
    rows = files.read_dataset(spark, str(dataset), "mvtec_ad", "carpet").toPandas().set_index("relative_path")
    assert len(rows) == 8
    assert rows.loc["test/tear/t1.png", "mask_path"] == "ground_truth/tear/t1_mask.png"
    assert rows.loc["test/good/g0.PNG", ["split", "label", "defect_type"]].tolist() == ["test", "normal", "good"]
    train = rows.loc["train/good/002.png"]
    assert (train.split, train.label, train.source_image_id, train.width) == ("train", "normal", "002", 80)
    assert set(rows.dataset_id) == {"mvtec_ad_carpet"}
    with pytest.raises(ValueError):
        files.read_dataset(spark, str(dataset), "mystery", "carpet")
    png(dataset / "carpet/test/tear/extra.png", picture(99))
    with pytest.raises(ValueError, match="mask"):
        files.read_dataset(spark, str(dataset), "fixture", "carpet")


def test_manifest_detects_tampering(spark, dataset, tmp_path):
    rows = files.read_dataset(spark, str(dataset), "mvtec_ad", "carpet").cache()
    path = str(tmp_path / "manifest")
    files.write_manifest(rows, path)
    schema = T.StructType([*rows.schema.fields, T.StructField("manifest_sha256", T.StringType())])
    back = files.read_manifest(spark, path, schema)
    assert back.count() == 8
    other = str(tmp_path / "tampered")
    back.withColumn("split", F.when(F.col("relative_path") == "test/good/g0.PNG", "train").otherwise(
        F.col("split"))).write.json(other)
    with pytest.raises(ValueError):
        files.read_manifest(spark, other, schema)
    with pytest.raises(ValueError):
        files.write_manifest(rows, str(tmp_path / "x"), fingerprint="0" * 64)


def test_folder_batch_isolates_broken_and_copied_files(spark, tmp_path):
    root = tmp_path / "inbox"
    png(root / "a.png", picture(1))
    png(root / "b.png", picture(2))
    png(root / "sub/c.png", picture(1))
    (root / "z.png").write_bytes(b"no picture")
    decoded = files.scan_images(spark, str(root))
    broken = decoded.where("error_code is not null").select("path", "error_code")
    rows = files.to_rgb(decoded).withColumnRenamed("image_id", "path").join(
        files.hash_files(spark, str(root)).select("path", "sha256"), "path").withColumn("image_id", F.col("path"))
    first, copies = images.unique_images(rows)
    done = images.analyze_images(first, scoring.residual_scorer(), 0.08, 0.08)
    batch = done.select("path", "decision").unionByName(
        copies.select("path", "error_code"), allowMissingColumns=True).unionByName(
        broken, allowMissingColumns=True)
    got = {r.path.rsplit("/", 1)[1]: (r.decision, r.error_code) for r in batch.collect()}
    assert got == {"a.png": ("ANOMALY", None), "b.png": ("ANOMALY", None),
                   "c.png": (None, "DUPLICATE_INPUT"), "z.png": (None, "IMAGE_INVALID")}
    late = images.analyze_batch(done.select("path", "sha256", "decision"), broken)
    assert late.where("error_code = 'IMAGE_INVALID'").count() == 1


def test_integrity_check_on_files(spark, dataset):
    actual = files.hash_files(spark, str(dataset / "carpet/train"))
    good = actual.select(F.col("path").alias("artifact_path"), F.col("sha256").alias("artifact_sha256"))
    name = F.substring_index("artifact_path", "/", -1)
    registry = good.withColumn("artifact_sha256", F.when(name == "000.png", "0").otherwise(
        F.col("artifact_sha256"))).unionByName(spark.createDataFrame(
            [("/gone", "1")], "artifact_path string, artifact_sha256 string"))
    out = {r.artifact_path.rsplit("/", 1)[1]: r.integrity
           for r in governance.integrity_check(registry, actual).collect()}
    assert out == {"000.png": "MISMATCH", "001.png": "OK", "002.png": "OK", "003.png": "OK", "gone": "MISSING"}


def test_run_artifacts_and_append(spark, tmp_path):
    for i in range(3):
        folder = tmp_path / "runs" / f"run{i}"
        folder.mkdir(parents=True)
        (folder / "thresholds.json").write_text(f'{{"threshold": 0.{i}}}')
    schema = T.StructType([T.StructField("threshold", T.DoubleType())])
    out = files.read_run_artifacts(spark, str(tmp_path / "runs/*/thresholds*.json"), schema)
    assert {r.run_id: r.threshold for r in out.collect()} == {"run0": 0.0, "run1": 0.1, "run2": 0.2}
    path = str(tmp_path / "log")
    assert sinks.append(spark.range(2), path, "test", 0) and sinks.append(spark.range(3), path, "test", 1)
    assert not sinks.append(spark.range(3), path, "test", 1)  # a replay changes nothing
    assert VersionedTable(spark, path).read().count() == 5
