"""Image jobs. An image is a row: image_id, height, width, pixels (row-major)."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import kernels, maps, rules
from plumbline.policy import DEFAULT_GATE, GatePolicy
from plumbline.session import materialize

REGION = T.StructType([
    T.StructField("region_id", T.IntegerType()),
    *[T.StructField(c, T.IntegerType()) for c in ("x0", "y0", "x1", "y1", "area_pixels")],
    *[T.StructField(c, T.DoubleType()) for c in (
        "area_ratio", "mean_score", "max_score", "centroid_x", "centroid_y")],
])

QUALITY_FIELDS = [
    T.StructField("aspect_ratio", T.DoubleType()), T.StructField("luminance_mean", T.DoubleType()),
    T.StructField("luminance_std", T.DoubleType()), T.StructField("blur_variance", T.DoubleType()),
]


def tiles(images: DataFrame, tile_height: int, tile_width: int, overlap: float,
          keep: Sequence[str] = ("image_id",)) -> DataFrame:
    """One row per tile with its pixels; grey and colour images alike."""
    images = pixel_arrays(images)
    grid = maps.tile_grid(F.col("height"), F.col("width"), tile_height, tile_width, overlap)
    channels = (F.size("pixels") / (F.col("height") * F.col("width"))).cast("int")
    out = images.select(*keep, "width", "pixels", channels.alias("_n"), F.explode(grid).alias("_t"))
    return out.select(*keep, "_t.*", maps.cut_tile(
        F.col("pixels"), F.col("width"), F.col("_t"), F.col("_n")).alias("tile_pixels"))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _unpacked(pixels: pd.Series) -> pd.Series:
    return pixels.map(lambda b: None if b is None else np.frombuffer(b, np.uint8).astype(np.int32))


def pixel_arrays(images: DataFrame) -> DataFrame:
    """Byte strings, as decoders give them, as arrays of numbers; arrays stay."""
    if isinstance(images.schema["pixels"].dataType, T.BinaryType):
        return images.withColumn("pixels", _unpacked("pixels"))
    return images


def merge_maps(tile_maps: DataFrame, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Weighted mean of overlapping tile maps: one row per image (keys, height, width, pixels).

    A tile moves as one row, and an image, which fits in a row by definition, is put together as its
    tiles stream by. Pixels that no tile covers are NULL.
    """
    keys = list(keys)
    kinds = [f"`{k}` {tile_maps.schema[k].dataType.simpleString()}" for k in keys]
    rows = tile_maps.select(*keys, *[F.col(c).cast("int").alias(c) for c in ("y0", "x0", "y1", "x1")],
                            F.col("tile_pixels").cast("array<double>").alias("_v"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, types = None, [], {}

        def whole() -> pa.RecordBatch:
            height, width = (max(p[i] for p in parts) for i in (2, 3))
            weight, total = np.zeros((height, width)), np.zeros((height, width))
            for y0, x0, y1, x1, values in parts:
                w = kernels.tile_weights(y1 - y0, x1 - x0)
                weight[y0:y1, x0:x1] += w
                total[y0:y1, x0:x1] += w * values.reshape(y1 - y0, x1 - x0)
            flat = (total / np.where(weight > 0, weight, 1)).ravel()
            pixels = pa.array(flat, mask=(weight == 0).ravel())
            return pa.RecordBatch.from_arrays(
                [*[pa.array([v], types[k]) for k, v in zip(keys, now)], pa.array([height], pa.int32()),
                 pa.array([width], pa.int32()), pa.ListArray.from_arrays([0, len(flat)], pixels)],
                [*keys, "height", "width", "pixels"])

        for batch in batches:
            types.update({k: batch.schema.field(k).type for k in keys})
            names = list(zip(*[batch[k].to_pylist() for k in keys]))
            places = np.column_stack([batch[c].to_numpy() for c in ("y0", "x0", "y1", "x1")]).tolist()
            for i, (name, place) in enumerate(zip(names, places)):
                if name != now:
                    if parts:
                        yield whole()
                    now, parts = name, []
                parts.append((*place, batch["_v"][i].values.to_numpy(zero_copy_only=False)))
        if parts:
            yield whole()

    return rows.repartition(*keys).sortWithinPartitions(*keys, "y0", "x0").mapInArrow(merge, ", ".join(
        [*kinds, "height int", "width int", "pixels array<double>"]))


def merge_tiles(tile_maps: DataFrame, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """`merge_maps` as one row per covered pixel (keys, y, x, value)."""
    rows = merge_maps(tile_maps, keys).select(*keys, "width", F.posexplode("pixels").alias("_i", "value"))
    return rows.where(F.col("value").isNotNull()).select(
        *keys, F.floor(F.col("_i") / F.col("width")).cast("int").alias("y"),
        (F.col("_i") % F.col("width")).cast("int").alias("x"), "value")


def require_covered(images: DataFrame, merged: DataFrame) -> None:
    """Raise where merged pixels do not cover an image."""
    counts = merged.groupBy("image_id").agg(F.count(F.lit(1)).alias("_n"))
    bad = images.select("image_id", "height", "width").join(counts, "image_id", "left").where(
        F.coalesce("_n", F.lit(0)) != F.col("height") * F.col("width")).limit(1).count()
    if bad:
        raise ValueError("the tiles do not cover every pixel")


def assemble_maps(merged: DataFrame, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Pixel rows back to one array per image; an image fits in one row by definition."""
    points = F.sort_array(F.collect_list(F.struct("y", "x", "value")))
    return merged.groupBy(*keys).agg(F.transform(points, lambda p: p["value"]).alias("pixels"))


def image_score(tile_scores: DataFrame, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    return tile_scores.groupBy(*keys).agg(F.max("tile_score").alias("score"))


def _plane(height: int, width: int, pixels) -> np.ndarray:
    """2-D array of a grey image or H x W x 3 of a colour one, from an array or bytes."""
    flat = np.frombuffer(pixels, np.uint8) if isinstance(pixels, (bytes, bytearray)) else (
        np.asarray(pixels, dtype=np.float64))
    shape = (height, width) if flat.size == height * width else (height, width, 3)
    return flat.reshape(shape)


def quality_metrics(images: DataFrame) -> DataFrame:
    """Add aspect ratio, grey mean, grey deviation and Laplacian variance."""
    schema = T.StructType(images.schema.fields + QUALITY_FIELDS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            values = []
            for h, w, px in zip(pdf["height"], pdf["width"], pdf["pixels"]):
                image = _plane(h, w, px)
                gray = kernels.luminance(image) if image.ndim == 3 else image
                values.append((w / h, float(gray.mean()), float(gray.std()),
                               kernels.laplacian_variance(gray)))
            extra = pd.DataFrame(values, columns=[f.name for f in QUALITY_FIELDS], index=pdf.index)
            yield pd.concat([pdf, extra], axis=1)

    return images.mapInPandas(run, schema)


def image_hashes(images: DataFrame, keep: Sequence[str] = ("image_id",), size: int = 8) -> DataFrame:
    """Perceptual hash of grey and colour images, each of its own size.

    One bit per cell of a size x size grid, whose area mean reaches the mean of all cells, as hex
    digits. Colours become luma first.
    """
    if (size * size) % 4:
        raise ValueError("the number of bits must be a multiple of four")
    schema = T.StructType([*[images.schema[c] for c in keep], T.StructField("hash", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for h, w, px in zip(pdf["height"], pdf["width"], pdf["pixels"]):
                image = _plane(h, w, px)
                grey = kernels.luminance(image) if image.ndim == 3 else image
                cells = kernels.resize_area(grey.astype(np.float64), size, size).ravel().round(9)
                text = "".join("1" if v >= cells.mean() else "0" for v in cells)
                found.append(f"{int(text, 2):0{len(text) // 4}x}")
            yield pdf[list(keep)].assign(hash=found)

    needed = list(dict.fromkeys([*keep, "height", "width", "pixels"]))
    return images.select(*needed).mapInPandas(run, schema)


def with_gate(images: DataFrame, gate: GatePolicy = DEFAULT_GATE) -> DataFrame:
    """Add quality_status and quality_reasons from the quality metrics."""
    result = rules.quality_gate(F.col("width"), F.col("height"), F.col("luminance_std"),
                                F.col("blur_variance"), F.col("luminance_mean"), gate)
    return images.withColumn("_g", result).withColumn("quality_status", F.col("_g.status")).withColumn(
        "quality_reasons", F.col("_g.reasons")).drop("_g")


def extract_regions(images: DataFrame, threshold: float, min_area: int = 16,
                    keep: Sequence[str] = ("image_id",)) -> DataFrame:
    """Per image the regions of its map at the threshold and the filled area ratio; an image without
    a map has none."""
    fields = [images.schema[c] for c in keep]
    schema = T.StructType([*fields, T.StructField("regions", T.ArrayType(REGION)),
                           T.StructField("area_ratio", T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [([], 0.0) if px is None else kernels.regions(_plane(h, w, px), threshold, min_area)
                     for h, w, px in zip(pdf["height"], pdf["width"], pdf["pixels"])]
            out = pdf[list(keep)].copy()
            out["regions"] = [f[0] for f in found]
            out["area_ratio"] = [f[1] for f in found]
            yield out

    needed = list(dict.fromkeys([*keep, "height", "width", "pixels"]))
    return images.select(*needed).mapInPandas(run, schema)


def region_overlap(images: DataFrame, threshold: float, keep: Sequence[str] = ("image_id",)
                   ) -> DataFrame:
    """Regions of each mask and the mean share of a region that the map reaches.

    ``pixels`` is the map and ``mask`` has 1 inside. An image without a region has no overlap.
    """
    schema = T.StructType([*[images.schema[c] for c in keep],
                           T.StructField("region_count", T.IntegerType()),
                           T.StructField("region_overlap", T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            counts, shares = [], []
            for h, w, px, mask in zip(pdf["height"], pdf["width"], pdf["pixels"], pdf["mask"]):
                labels = kernels.components(_plane(h, w, mask) == 1).ravel()
                hit = np.asarray(px, np.float64) >= threshold
                _, which, area = np.unique(labels[labels >= 0], return_inverse=True,
                                           return_counts=True)
                counts.append(len(area))
                shares.append(float(np.mean(np.bincount(which, hit[labels >= 0]) / area))
                              if len(area) else None)
            out = pdf[list(keep)].copy()
            out["region_count"], out["region_overlap"] = counts, shares
            yield out

    needed = list(dict.fromkeys([*keep, "height", "width", "pixels", "mask"]))
    return images.select(*needed).mapInPandas(run, schema)


def region_rows(found: DataFrame, keep: Sequence[str] = ("image_id",)) -> DataFrame:
    return found.select(*keep, F.inline("regions"))


_AS_COLUMNS = ("brightness", "contrast", "occlusion")
_AS_KERNELS = ("gaussian_noise", "blur", "downsample")


def _check_case(kind: str, value: float) -> None:
    if kind not in _AS_COLUMNS + _AS_KERNELS:
        raise ValueError(f"unknown perturbation {kind!r}")
    if kind == "blur" and (int(value) < 1 or int(value) % 2 == 0):
        raise ValueError("blur needs a positive odd kernel size")
    if kind == "occlusion" and not 0.0 < value < 1.0:
        raise ValueError("occlusion needs a fraction in (0, 1)")
    if kind == "downsample" and not 0.0 < value <= 1.0:
        raise ValueError("downsampling needs a fraction in (0, 1]")


def perturb_sweep(images: DataFrame, cases: Sequence[tuple[str, float]], seed: int = 42
                  ) -> DataFrame:
    """Every image, grey or colour, under every case. The case list is expanded in place.

    Brightness, contrast and occlusion are column expressions; noise, blur and resampling run on
    Arrow batches.
    """
    for kind, value in cases:
        _check_case(kind, value)  # a bad case fails here, before the job
    images = pixel_arrays(images).select("image_id", "height", "width", "pixels")

    def under(kinds: tuple[str, ...]) -> DataFrame | None:
        own = [F.struct(F.lit(k).alias("kind"), F.lit(float(v)).alias("value"))
               for k, v in cases if k in kinds]
        return images.withColumn("_c", F.explode(F.array(*own))).select(
            "image_id", "height", "width", "pixels", "_c.*") if own else None

    parts = []
    rows = under(_AS_COLUMNS)
    if rows is not None:
        px, value, kind = F.col("pixels"), F.col("value"), F.col("kind")
        parts.append(rows.withColumn("pixels", F.when(
            kind == "brightness", maps.brightened(px, value)).when(
            kind == "contrast", maps.contrasted(px, value)).otherwise(
            maps.occluded(px, F.col("height"), F.col("width"), value))))
    rows = under(_AS_KERNELS)
    if rows is not None:
        schema = T.StructType([f if f.name != "pixels" else T.StructField(
            "pixels", T.ArrayType(T.IntegerType())) for f in rows.schema])

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            change = {
                "gaussian_noise": lambda image, v: image + kernels.noise(image.shape, v, seed),
                "blur": lambda image, v: kernels.blurred(image, int(v)),
                "downsample": kernels.coarse}
            for pdf in batches:
                done = [change[k](_plane(h, w, px), v) for h, w, px, k, v in zip(
                    pdf["height"], pdf["width"], pdf["pixels"], pdf["kind"], pdf["value"])]
                yield pdf.assign(pixels=[np.clip(d, 0, 255).ravel().astype(np.int32)
                                         for d in done])[schema.names]

        parts.append(rows.mapInPandas(run, schema))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def analyze_images(images: DataFrame, scorer: Callable, image_threshold: float,
                   pixel_threshold: float, min_area: int = 16, gate: GatePolicy = DEFAULT_GATE,
                   tile: tuple[int, int] | None = None, overlap: float = 0.25) -> DataFrame:
    """Gate, score, cut regions and decide, one result row per image.

    Images the gate rejects never reach the scorer and get score 0. With ``tile`` an image is cut
    by :func:`tiles`, scored tile by tile and its map merged by :func:`merge_tiles`; ``image_id``
    must then be unique. Other columns of ``images`` pass through, the pixels do not.
    """
    from plumbline.operators.scoring import score_images

    gated = with_gate(quality_metrics(images), gate)
    keep = [c for c in gated.columns if c != "pixels"]
    abstains = F.col("quality_status") == "ABSTAIN"
    if tile is None:
        # one pass: rejected images have no pixels left, and what has none is neither scored nor cut
        blank = gated.withColumn("pixels", F.when(~abstains, F.col("pixels")))
        scored = score_images(blank, scorer, keep).withColumn("score", F.coalesce("score", F.lit(0.0)))
    else:
        # stored, so that the gate is worked out once for the tiles and for the result
        gated = materialize(images.sparkSession, gated, "gated-images")
        passed = gated.where(~abstains)
        cut = tiles(passed, *tile, overlap).select(
            "image_id", "x0", "y0", "x1", "y1", (F.col("y1") - F.col("y0")).alias("height"),
            (F.col("x1") - F.col("x0")).alias("width"), F.col("tile_pixels").alias("pixels"))
        parts = materialize(images.sparkSession, score_images(
            cut, scorer, ["image_id", "x0", "y0", "x1", "y1"]), "scored-tiles")
        whole = merge_maps(parts.withColumnRenamed("anomaly_map", "tile_pixels")).select(
            "image_id", F.col("pixels").alias("anomaly_map"))
        best = image_score(parts.withColumnRenamed("score", "tile_score"))
        scored = gated.select(*keep).join(best, "image_id", "left").join(
            whole, "image_id", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    result = extract_regions(scored.withColumnRenamed("anomaly_map", "pixels"), pixel_threshold,
                             min_area, [*keep, "score"])
    thr = F.lit(float(image_threshold))
    decision = rules.decide(F.col("score"), thr, F.col("quality_status"))
    return (result.withColumn("decision", decision)
            .withColumn("review_priority", rules.review_priority(
                F.col("decision"), F.col("score"), thr, F.col("area_ratio")))
            .withColumn("region_count", F.size("regions")))


def analyze_batch(results: DataFrame, broken: DataFrame, digest: str = "sha256",
                  path: str = "path") -> DataFrame:
    """Join results with the files that failed: broken ones and later copies of the same bytes.

    ``broken`` holds path, error_code. Broken files fail before copies are looked for.
    """
    from plumbline.operators.audit import batch_result, dedupe_first

    return batch_result(dedupe_first(results, digest, path), broken)


def unique_images(images: DataFrame, digest: str = "sha256", path: str = "path"
                  ) -> tuple[DataFrame, DataFrame]:
    """First file of every content hash, and the copies, so that no copy is scored twice."""
    from plumbline.operators.audit import dedupe_first

    marked = dedupe_first(images.select(path, digest), digest, path)
    copies = marked.where(F.col("error_code").isNotNull())
    return images.join(copies.select(path), path, "left_anti"), copies


def grey_images(df: DataFrame, image_id: str, vector: str, height: int, width: int) -> DataFrame:
    """Vectors of height x width numbers as grey byte images."""
    return df.select(F.col(image_id).alias("image_id"), F.lit(height).alias("height"),
                     F.lit(width).alias("width"), maps.normalize(F.col(vector)).alias("pixels"))


