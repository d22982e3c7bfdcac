"""Image folders, dataset layouts and manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.rules import file_stem
from plumbline.operators.audit import pair_masks, set_fingerprint
from plumbline.sources.versions import VersionedTable

# fixed values: image file suffixes that are read
SUFFIXES = ["bmp", "jpeg", "jpg", "png", "tif", "tiff", "webp"]

# fixed values: provenance of the folder layouts that share one reader
PROVENANCE = {
    "mvtec_ad": ("MVTec Anomaly Detection Dataset", False),
    "visa": ("MVTec Anomaly Detection Dataset", False),
    "aitex": ("MVTec Anomaly Detection Dataset", False),
    "company": ("MVTec Anomaly Detection Dataset", False),
    "fixture": ("Programmatic fixture", True),
}

FILE_COLUMNS = ["relative_path", "sha256", "width", "height", "label", "split", "defect_type",
                "mask_path", "source_image_id"]


def _any_case(suffix: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in suffix)


def image_glob() -> str:
    """Glob for the allowed suffixes in any case; other files are not even opened."""
    return "*.{" + ",".join(_any_case(s) for s in SUFFIXES) + "}"


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def is_image_path(path: Column) -> Column:
    return suffix(path).isin(*SUFFIXES)


def scan_files(spark: SparkSession, root: str) -> DataFrame:
    """Image files below a folder: path, length, modificationTime, content."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
            .option("pathGlobFilter", image_glob()).load(root))


def plain_path(path: Column) -> Column:
    return F.regexp_replace(path, r"^file:/+", "/")


def hash_files(spark: SparkSession, root: str) -> DataFrame:
    """Path, size and SHA-256 of every image file."""
    return scan_files(spark, root).select(plain_path(F.col("path")).alias("path"), "length",
                                          F.sha2("content", 256).alias("sha256"))


def scan_images(spark: SparkSession, root: str) -> DataFrame:
    """Decoded images: path, height, width, channels, data (BGR bytes), error_code.

    A file that cannot be decoded keeps its row, with NULL pixels and an error code.
    """
    raw = (spark.read.format("image").option("recursiveFileLookup", "true")
           .option("pathGlobFilter", image_glob()).load(root))
    i = F.col("image")
    good = i["height"] > 0
    return raw.select(
        plain_path(i["origin"]).alias("path"), F.when(good, i["height"]).alias("height"),
        F.when(good, i["width"]).alias("width"), F.when(good, i["nChannels"]).alias("channels"),
        F.when(good, i["data"]).alias("data"),
        F.when(~good, "IMAGE_INVALID").alias("error_code"))


def to_rgb(images: DataFrame) -> DataFrame:
    """Image rows (image_id, height, width, pixels) from decoded files; one or three channels."""
    from collections.abc import Iterator

    import numpy as np
    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for h, w, c, data in zip(pdf["height"], pdf["width"], pdf["channels"], pdf["data"]):
                px = np.frombuffer(data, np.uint8).reshape(h, w, c)
                rgb = np.repeat(px, 3, axis=2) if c == 1 else px[:, :, 2::-1]
                out.append(np.ascontiguousarray(rgb).tobytes())
            yield pd.DataFrame({"image_id": pdf["path"], "height": pdf["height"],
                                "width": pdf["width"], "pixels": out})

    return images.where(F.col("error_code").isNull()).select(
        "path", "height", "width", "channels", "data").mapInPandas(
        run, "image_id string, height int, width int, pixels binary")


def inventory(paths: DataFrame, path: str) -> DataFrame:
    """Image files per suffix."""
    return paths.where(is_image_path(F.col(path))).groupBy(suffix(F.col(path)).alias("suffix")).agg(
        F.count(F.lit(1)).alias("images"))


def layout_columns(relative: Column) -> dict[str, Column]:
    """Split, label, defect type and source id from train/good/x.png or test/<defect>/x.png."""
    parts = F.split(relative, "/")
    top, folder = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    is_train = (top == "train") & (folder == "good")
    is_test = top == "test"
    return {
        "split": F.when(is_train, "train").when(is_test, "test"),
        "label": F.when(is_train | (is_test & (folder == "good")), "normal").when(
            is_test, "anomaly"),
        "defect_type": F.when(is_test, folder),
        "source_image_id": file_stem(relative),
    }


def manifest_rows(files: DataFrame) -> DataFrame:
    """Manifest rows out of (relative_path, sha256, width, height) of a dataset folder.

    Anomalies find their mask at ground_truth/<defect>/<stem>_mask with their own suffix or png.
    """
    path = F.col("relative_path")
    marked = files.withColumns(layout_columns(path))
    images = marked.where(F.col("split").isNotNull())
    masks = files.where(path.startswith("ground_truth/")).select("relative_path")
    stem = F.concat(F.lit("ground_truth/"), F.col("defect_type"), F.lit("/"),
                    F.col("source_image_id"), F.lit("_mask"))
    anomaly = F.col("label") == "anomaly"
    own = F.when(anomaly, F.concat(stem, F.regexp_extract(path, r"(\.[^./]+)$", 1)))
    png = F.when(anomaly, F.concat(stem, F.lit(".png")))
    return pair_masks(images, masks, "relative_path", own, png).select(*FILE_COLUMNS)


def require_masks(rows: DataFrame) -> DataFrame:
    if rows.where((F.col("label") == "anomaly") & F.col("mask_path").isNull()).limit(1).count():
        raise ValueError("an anomaly image has no mask")
    return rows


def with_provenance(rows: DataFrame, adapter: str, category: str | Column) -> DataFrame:
    """Dataset columns of an allow-listed layout; the category may differ by row."""
    if adapter not in PROVENANCE:
        raise ValueError(f"unknown dataset layout {adapter!r}")
    name, commercial = PROVENANCE[adapter]
    kind = F.lit(category) if isinstance(category, str) else category
    dataset = F.lit("fixture") if adapter == "fixture" else F.concat(F.lit("mvtec_ad_"), kind)
    return rows.select(dataset.alias("dataset_id"), F.lit(name).alias("source_name"),
                       kind.alias("category"), F.lit(commercial).alias("commercial_use"), "*")


def read_dataset(spark: SparkSession, root: str, adapter: str, category: str) -> DataFrame:
    """Manifest rows of a dataset folder, with provenance; files that do not decode raise."""
    base = f"{root.rstrip('/')}/{category}"
    sizes = scan_images(spark, base)
    if sizes.where("error_code is not null").limit(1).count():
        raise ValueError("a file of the dataset cannot be decoded")
    files = hash_files(spark, base).join(sizes.select("path", "height", "width"), "path")
    # a literal prefix cut: everything up to the dataset folder
    relative = F.substring_index(F.col("path"), f"{base}/", -1)
    rows = manifest_rows(files.withColumn("relative_path", relative))
    return with_provenance(require_masks(rows), adapter, category)


def manifest_fingerprint(rows: DataFrame) -> DataFrame:
    return set_fingerprint(rows, ["dataset_id"], FILE_COLUMNS, ["dataset_id"])


def write_manifest(rows: DataFrame, path: str, fingerprint: str | None = None) -> None:
    """Write manifest rows with their fingerprint; refuse when a given fingerprint differs.

    The rows become a new version of the folder's table, so a manifest that is there stays readable
    until the new one is complete.
    """
    found = manifest_fingerprint(rows)
    if fingerprint is not None and found.where(F.col("fingerprint") != fingerprint).limit(1).count():
        raise ValueError("the manifest does not match its fingerprint")
    VersionedTable(rows.sparkSession, path, layout="json").overwrite(rows.join(found.select(
        "dataset_id", F.col("fingerprint").alias("manifest_sha256")), "dataset_id"))


def read_manifest(spark: SparkSession, path: str, schema) -> DataFrame:
    """Read manifest rows and verify the fingerprint they carry; a plain folder of JSON is read too."""
    table = VersionedTable(spark, path, layout="json")
    rows = table.read().select(*[f.name for f in schema]) if table.latest() else spark.read.schema(
        schema).option("mode", "FAILFAST").json(path)
    if mismatched_manifests(rows).limit(1).count():
        raise ValueError("a manifest does not match its fingerprint")
    return rows


def mismatched_manifests(rows: DataFrame) -> DataFrame:
    """Dataset ids whose rows do not give the recorded fingerprint."""
    recorded = rows.select("dataset_id", "manifest_sha256").distinct()
    return recorded.join(manifest_fingerprint(rows), "dataset_id").where(
        ~F.col("fingerprint").eqNullSafe(F.col("manifest_sha256")))


def read_run_artifacts(spark: SparkSession, pattern: str, schema) -> DataFrame:
    """JSON records of many runs; the run id is the folder a file lies in."""
    return spark.read.schema(schema).json(pattern).withColumn(
        "run_id", F.element_at(F.split(F.input_file_name(), "/"), -2))
