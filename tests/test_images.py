from collections import deque

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.functions import kernels, maps
from plumbline.operators import images, scoring
from plumbline.policy import GatePolicy


def flood(mask, diagonal):
    h, w = mask.shape
    out, steps = np.full((h, w), -1), [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)
                                       if (dy or dx) and (diagonal or not (dy and dx))]
    for y in range(h):
        for x in range(w):
            if mask[y, x] and out[y, x] < 0:
                todo, out[y, x] = deque([(y, x)]), y * w + x
                while todo:
                    a, b = todo.popleft()
                    for dy, dx in steps:
                        p, q = a + dy, b + dx
                        if 0 <= p < h and 0 <= q < w and mask[p, q] and out[p, q] < 0:
                            out[p, q] = y * w + x
                            todo.append((p, q))
    return out


@pytest.mark.parametrize("diagonal", [True, False])
@pytest.mark.parametrize("shape,density", [((40, 31), 0.5), ((25, 60), 0.35), ((1, 30), 0.6),
                                           ((30, 1), 0.6), ((12, 12), 1.0), ((9, 9), 0.0)])
def test_components_equal_flood_fill(diagonal, shape, density):
    mask = np.random.default_rng(7).random(shape) < density
    assert (kernels.components(mask, diagonal) == flood(mask, diagonal)).all()


def test_components_of_a_spiral():
    mask = np.zeros((41, 41), bool)
    y, x, n, d = 0, 0, 40, 0
    for length in [40, 40, 40, 38, 38, 36, 36, 34, 34, 32, 32]:
        for _ in range(length):
            mask[y, x] = True
            y, x = (y, x + 1) if d == 0 else (y + 1, x) if d == 1 else (y, x - 1) if d == 2 else (y - 1, x)
        d = (d + 1) % 4
    assert len(np.unique(kernels.components(mask)[mask])) == 1


def test_regions_of_a_bright_block_and_a_ring():
    amap = np.zeros((96, 128))
    amap[20:40, 30:60] = 1.0
    found, ratio = kernels.regions(amap, 0.5, 16)
    assert len(found) == 1 and (found[0]["x0"], found[0]["y0"], found[0]["x1"], found[0]["y1"]) == (30, 20, 60, 40)
    assert ratio == found[0]["area_pixels"] / amap.size
    ring = np.zeros((40, 40))
    ring[5:25, 5:25] = 1.0
    ring[10:20, 10:20] = 0.0
    found, ratio = kernels.regions(ring, 0.5, 16)
    assert len(found) == 1 and ratio > found[0]["area_ratio"] + 0.04
    assert kernels.regions(amap, 2.0) == ([], 0.0)
    assert kernels.regions(amap * (np.arange(128) == 30), 0.9, 16)[0] == []


def test_gaussian_and_laplacian():
    flat = np.full((9, 7), 3.5)
    for size in (3, 5, 7, 15):
        np.testing.assert_allclose(kernels.gaussian(flat, size), flat)
    assert kernels.laplacian_variance(flat) == 0.0
    a = np.arange(12.0).reshape(3, 4) ** 2
    p = np.pad(a, 1, mode="reflect")
    lap = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * a
    assert kernels.laplacian_variance(a) == pytest.approx(lap.var())
    assert kernels.laplacian_variance(np.arange(5.0).reshape(1, 5)) >= 0


CASES = [("brightness", 0.7), ("contrast", 1.3), ("gaussian_noise", 10), ("blur", 5),
         ("downsample", 0.5), ("occlusion", 0.2)]


@pytest.mark.parametrize("shape", [(24, 36), (24, 36, 3)])
def test_perturbations(spark, shape):
    img = np.random.default_rng(1).integers(0, 256, shape).astype(np.uint8)
    df = spark.createDataFrame([("a", 24, 36, bytearray(img.tobytes()))],
                               "image_id string, height int, width int, pixels binary")
    got = {r.kind: np.array(r.pixels).reshape(shape) for r in images.perturb_sweep(df, CASES).collect()}
    x = img.astype(float)
    box = x.copy()
    box[10:14, 14:21] = np.median(x.reshape(-1, *shape[2:]), axis=0)  # 4 x 7 pixels in the middle
    want = {"brightness": x * 0.7, "contrast": (x - 127.5) * 1.3 + 127.5, "occlusion": box,
            "gaussian_noise": x + np.random.default_rng(42).normal(0, 10, shape)}
    for kind, value in want.items():
        np.testing.assert_array_equal(got[kind], np.clip(value, 0, 255).astype(int), kind)
    assert set(got) == {k for k, _ in CASES} and all((g != img).any() for g in got.values())
    flat = df.withColumn("pixels", F.lit(bytes([9] * img.size)))
    assert set(images.perturb_sweep(flat, [("downsample", 0.5)]).head().pixels) == {9}
    for kind, value in [("blur", 4), ("blur", -1), ("occlusion", 0.0), ("occlusion", 1.0), ("mood", 1)]:
        with pytest.raises(ValueError):
            images.perturb_sweep(df, [(kind, value)])


def test_colour_tiles(spark):
    img = np.random.default_rng(5).integers(0, 256, (7, 9, 3)).astype(np.uint8)
    df = spark.createDataFrame([("a", 7, 9, bytearray(img.tobytes()))],
                               "image_id string, height int, width int, pixels binary")
    for t in images.tiles(df, 4, 5, 0.25).collect():
        np.testing.assert_array_equal(np.array(t.tile_pixels), img[t.y0:t.y1, t.x0:t.x1].ravel())


def python_grid(h, w, th, tw, overlap):
    th, tw = min(th, h), min(tw, w)
    def starts(n, t):
        s = list(range(0, n - t + 1, max(1, round(t * (1 - overlap)))))
        return s if s[-1] == n - t else s + [n - t]
    return [(x, y, x + tw, y + th) for y in starts(h, th) for x in starts(w, tw)]


def frame(spark, arrays):
    return spark.createDataFrame(pd.DataFrame({
        "image_id": range(len(arrays)), "height": [a.shape[0] for a in arrays],
        "width": [a.shape[1] for a in arrays], "pixels": [a.ravel().astype(float).tolist() for a in arrays]}
    )).withColumns({"height": F.col("height").cast("int"), "width": F.col("width").cast("int")})


@pytest.mark.parametrize("shape,tile,overlap", [((130, 150), (64, 64), 0.25), ((8, 8), (5, 5), 0.25),
                                                ((10, 33), (64, 4), 0.0), ((17, 9), (6, 9), 0.9)])
def test_tiles_cover_and_merge(spark, shape, tile, overlap):
    rng = np.random.default_rng(2)
    arrays = [np.full(shape, 7.0), rng.random(shape)]
    df = frame(spark, arrays)
    grid = df.select(maps.tile_grid(F.col("height"), F.col("width"), *tile, overlap).alias("g")).head().g
    want = python_grid(*shape, *tile, overlap)
    assert [(t.x0, t.y0, t.x1, t.y1) for t in grid] == want
    assert [t.tile_id for t in grid] == list(range(len(want)))
    cut = images.tiles(df, *tile, overlap)
    first = cut.where("image_id = 1 and tile_id = 0").head()
    x0, y0, x1, y1 = want[0]
    np.testing.assert_allclose(first.tile_pixels, arrays[1][y0:y1, x0:x1].ravel())
    merged = images.merge_tiles(cut)
    images.require_covered(df, merged)
    back = images.assemble_maps(merged).orderBy("image_id").collect()
    for row, a in zip(back, arrays):
        np.testing.assert_allclose(np.array(row.pixels).reshape(shape), a, rtol=1e-9)
    with pytest.raises(ValueError):
        images.require_covered(df, images.merge_tiles(cut.where("tile_id > 0")))


def test_tile_arguments():
    with pytest.raises(ValueError):
        maps.tile_grid(F.lit(8), F.lit(8), 0, 4, 0.1)
    with pytest.raises(ValueError):
        maps.tile_grid(F.lit(8), F.lit(8), 4, 4, 1.0)


def test_stretch_and_normalize(spark):
    rng = np.random.default_rng(5)
    a = rng.integers(0, 60000, (16, 16)).astype(float)
    df = frame(spark, [a, np.full((4, 4), 5.0)])
    out = df.select("image_id", maps.stretch(F.col("pixels")).alias("s"),
                    maps.normalize(F.col("pixels")).alias("n")).orderBy("image_id").collect()
    lo, hi = np.percentile(a, (0.5, 99.5))
    want = np.clip((a - lo) * 255 / (hi - lo), 0, 255).astype(int).ravel()
    assert (np.array(out[0].s) == want).mean() > 0.99 and abs(np.array(out[0].s) - want).max() <= 1
    assert out[0].n == ((a - a.min()) * 255 / (a.max() - a.min())).astype(int).ravel().tolist()
    assert set(out[1].s) == {0} and set(out[1].n) == {0}


def test_analysis_skips_the_scorer_for_rejected_images(spark):
    rng = np.random.default_rng(3)
    good = rng.integers(0, 256, (64, 80)).astype(float)
    df = frame(spark, [good, np.full((64, 64), 9.0), rng.integers(0, 256, (16, 16)).astype(float)])

    def strict():
        def model(image):
            if image.std() < 2 or min(image.shape) < 32:
                raise RuntimeError("a rejected image reached the scorer")
            return float(image.mean()), image / 255.0
        return model

    out = {r.image_id: r for r in images.analyze_images(df, strict, 100.0, 0.9).collect()}
    assert out[1].decision == out[2].decision == "ABSTAIN" and out[1].score == 0.0
    assert out[1].quality_reasons == ["near_uniform_image"]
    assert out[2].quality_reasons == ["image_too_small"]
    assert out[0].decision == "ANOMALY" and out[0].region_count == len(out[0].regions)
    tiled = images.analyze_images(df.where("image_id = 0"), strict, 100.0, 0.9, tile=(40, 40)).head()
    parts = [good[y:y + 40, x:x + 40].mean() for x, y, _, _ in python_grid(64, 80, 40, 40, 0.25)]
    assert tiled.score == pytest.approx(max(parts))
    assert tiled.regions == out[0].regions  # a map that does not depend on the tile merges to itself


def test_quality_gate_on_colour_bytes(spark):
    rgb = np.random.default_rng(8).integers(0, 256, (70, 90, 3)).astype(np.uint8)
    df = spark.createDataFrame([("a", 70, 90, bytearray(rgb.tobytes()))],
                               "image_id string, height int, width int, pixels binary")
    row = images.with_gate(images.quality_metrics(df), GatePolicy()).head()
    grey = rgb @ np.array([0.299, 0.587, 0.114])
    assert row.luminance_mean == pytest.approx(grey.mean(), abs=0.5)
    assert row.quality_status == "PASS" and row.aspect_ratio == 90 / 70
    score = scoring.score_images(df, scoring.residual_scorer(), ["image_id"]).head()
    red = rgb[..., 0].astype(float)
    want = np.abs(red - kernels.gaussian(red, 15)) / 255
    assert score.score == pytest.approx(np.quantile(want, 0.995))


def test_hashes_of_any_size_and_colour(spark):
    rng = np.random.default_rng(6)
    rows = []
    for i, shape in enumerate([(8, 8), (13, 21), (40, 30, 3)]):
        img = rng.integers(0, 256, shape).astype(np.uint8)
        rows.append((i, shape[0], shape[1], bytearray(img.tobytes()), img))
    df = spark.createDataFrame([r[:4] for r in rows], "image_id int, height int, width int, pixels binary")
    got = {r.image_id: r.hash for r in images.image_hashes(df).collect()}
    for i, h, w, _, img in rows:
        grey = (img @ np.array([0.299, 0.587, 0.114])).round() if img.ndim == 3 else img.astype(float)
        fine = np.kron(grey, np.ones((8, 8)))  # every cell is whole pixels now
        cells = fine.reshape(8, h, 8, w).mean(axis=(1, 3)).ravel()
        same = [a == b for a, b in zip(f"{int(got[i], 16):064b}", (
            "1" if v >= cells.mean() else "0" for v in cells))]
        assert sum(same) >= 63  # luma is rounded in fixed point
    with pytest.raises(ValueError):
        images.image_hashes(df, size=3)
