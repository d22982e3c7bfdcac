"""Image, scoring and robustness queries on 8 x 8 maps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from plumbline.functions import kernels, maps
from plumbline.operators import audit, compare, images, scoring
from plumbline.plans import bindings as b
from plumbline.plans.registry import Tables, query, rounded
from plumbline.policy import GatePolicy

SMALL_GATE = GatePolicy(min_width=8, min_height=8, min_std=55.0, blur_review=15000.0,
                        dark_review=95.0, bright_review=160.0)


def _joined(column: str):
    return F.array_join(F.transform(F.col(column), lambda v: v.cast("int").cast("string")), ",")


# --- SQL pieces ------------------------------------------------------------------------------

# mirrored neighbour offsets: index -1 reads 1, index 8 reads 6
def blur3_sql(source: str, target: str, value: str) -> str:
    """3 x 3 Gaussian of an 8 x 8 map with mirrored borders."""
    return f"""{target} AS (
  SELECT a.image_id, a.y, a.x, sum(ky.w * kx.w * n.{value})::FLOAT AS s
  FROM {source} a, (VALUES (-1, 25e-2), (0, 5e-1), (1, 25e-2)) AS ky(d, w),
    (VALUES (-1, 25e-2), (0, 5e-1), (1, 25e-2)) AS kx(d, w), {source} n
  WHERE n.image_id = a.image_id AND n.y = 7 - abs(7 - abs(a.y + ky.d))
    AND n.x = 7 - abs(7 - abs(a.x + kx.d))
  GROUP BY 1, 2, 3)"""


def regions_sql(smooth: str, threshold: str, min_area: int) -> str:
    """Connected regions by reachability, and filled area by flooding from the border."""
    return f"""on_px AS (SELECT image_id, y, x, s FROM {smooth} WHERE s >= {threshold}::FLOAT),
reach(image_id, sy, sx, y, x) AS (
  SELECT image_id, y, x, y, x FROM on_px
  UNION SELECT r.image_id, r.sy, r.sx, n.y, n.x FROM reach r JOIN on_px n
    ON n.image_id = r.image_id AND abs(n.y - r.y) <= 1 AND abs(n.x - r.x) <= 1),
comp AS (SELECT image_id, sy AS y, sx AS x, min(y * 8 + x) AS root FROM reach GROUP BY 1, 2, 3),
region AS (
  SELECT c.image_id, root, count(*) AS area_pixels, min(c.x) AS x0, min(c.y) AS y0,
    max(c.x) + 1 AS x1, max(c.y) + 1 AS y1, avg(s::DOUBLE) AS mean_score,
    max(s)::DOUBLE AS max_score, avg(c.x) AS centroid_x, avg(c.y) AS centroid_y
  FROM comp c JOIN on_px p USING (image_id, y, x) GROUP BY 1, 2 HAVING count(*) >= {min_area}),
kept AS (SELECT c.image_id, y, x FROM comp c JOIN region USING (image_id, root)),
ground AS (SELECT image_id, y, x FROM {smooth} ANTI JOIN kept USING (image_id, y, x)),
flood(image_id, y, x) AS (
  SELECT image_id, y, x FROM ground WHERE y IN (0, 7) OR x IN (0, 7)
  UNION SELECT g.image_id, g.y, g.x FROM flood f JOIN ground g
    ON g.image_id = f.image_id AND abs(g.y - f.y) + abs(g.x - f.x) = 1),
filled AS (SELECT i.image_id, 1 - count(f.y) / 64e0 AS area_ratio
  FROM (SELECT DISTINCT image_id FROM {smooth}) i LEFT JOIN flood f USING (image_id) GROUP BY 1)"""


_QUALITY = """lap AS (
  SELECT a.image_id, a.label, a.p, sum(n.p) - 4 * a.p AS l
  FROM img a, (VALUES (-1, 0), (1, 0), (0, -1), (0, 1)) AS d(dy, dx), img n
  WHERE n.image_id = a.image_id AND n.y = 7 - abs(7 - abs(a.y + dy))
    AND n.x = 7 - abs(7 - abs(a.x + dx))
  GROUP BY a.image_id, a.label, a.p, a.y, a.x),
quality AS (SELECT image_id, avg(p) AS luminance_mean, stddev_pop(p) AS luminance_std,
  var_pop(l) AS blur_variance FROM lap GROUP BY 1),
gate AS (SELECT *, CASE WHEN luminance_std < 55 THEN 'ABSTAIN' WHEN blur_variance < 15000
    OR luminance_mean < 95 OR luminance_mean > 160 THEN 'REVIEW' ELSE 'PASS' END AS quality_status
  FROM quality)"""

# distance from a 15-tap Gaussian mean, mirrored at the borders
_RESIDUAL = """tap AS (SELECT t, exp(-(t * t) / (2 * 26e-1 * 26e-1)) AS g FROM range(-7, 8) AS r(t)),
line AS (SELECT i, 7 - abs(7 - abs(i + t)) AS j, g / (SELECT sum(g) FROM tap) AS w
  FROM range(0, 8) AS r(i), tap),
w8 AS (SELECT i, j, sum(w) AS w FROM line GROUP BY 1, 2),
vert AS (SELECT a.image_id, i AS y, a.x, sum(w * a.p) AS q FROM img a JOIN w8 ON w8.j = a.y
  GROUP BY 1, 2, 3),
soft AS (SELECT v.image_id, v.y, i AS x, sum(w * v.q) AS q FROM vert v JOIN w8 ON w8.j = v.x
  GROUP BY 1, 2, 3),
resid AS (SELECT image_id, y, x, abs(p - q) / 255 AS r FROM img JOIN soft USING (image_id, y, x)),
rscore AS (SELECT image_id, quantile_cont(r, 995e-3) AS score FROM resid GROUP BY 1)"""


# --- queries ---------------------------------------------------------------------------------

@query(f"""WITH {b.IMAGES}
SELECT image_id, string_agg(p, ',' ORDER BY y, x) AS pixels FROM img GROUP BY 1""")
def map_normalize(t: Tables):
    return b.images(t).select("image_id", _joined("pixels").alias("pixels"))


@query(f"""WITH {b.IMAGES},
q AS (SELECT image_id, quantile_cont(p::DOUBLE, 5e-3) AS lo, quantile_cont(p::DOUBLE, 995e-3) AS hi
  FROM img GROUP BY 1)
SELECT image_id, string_agg(CASE WHEN hi > lo THEN floor(least(greatest((p - lo) * 255e0 / (hi - lo),
  0e0), 255e0))::INT ELSE 0 END, ',' ORDER BY y, x) AS pixels
FROM img JOIN q USING (image_id) GROUP BY 1""")
def percentile_stretch(t: Tables):
    return b.images(t).select("image_id", maps.stretch(F.col("pixels")).alias("pixels")).select(
        "image_id", _joined("pixels").alias("pixels"))


@query(f"""WITH {b.IMAGES}, {_QUALITY}
SELECT image_id, round(luminance_mean, 6) AS luminance_mean, round(luminance_std, 6)
  AS luminance_std, round(blur_variance, 6) AS blur_variance, 1e0 AS aspect_ratio, quality_status
FROM gate""")
def quality_metrics(t: Tables):
    out = images.with_gate(images.quality_metrics(b.images(t)), SMALL_GATE)
    return rounded(out.select("image_id", "luminance_mean", "luminance_std", "blur_variance",
                              "aspect_ratio", "quality_status"),
                   "luminance_mean", "luminance_std", "blur_variance")


@query("""WITH s AS (SELECT o_orderkey, 1 + CAST(floor(o_totalprice / 2000) AS INT) AS h,
  1 + CAST(floor(o_totalprice / 3000) AS INT) AS w FROM orders),
a AS (SELECT *, least(h, 64) AS th, least(w, 48) AS tw FROM s),
c AS (SELECT *, greatest(1, round_even(th * 75e-2, 0))::INT AS sy,
  greatest(1, round_even(tw * 75e-2, 0))::INT AS sx FROM a),
ys AS (SELECT o_orderkey, list_sort(list_distinct(list_concat(range(0, h - th + 1, sy), [h - th])))
  AS ys, list_sort(list_distinct(list_concat(range(0, w - tw + 1, sx), [w - tw]))) AS xs, th, tw
  FROM c),
e AS (SELECT o_orderkey, th, tw, len(xs) AS nx, unnest(range(1, len(ys) + 1)) AS iy, xs, ys FROM ys),
f AS (SELECT o_orderkey, th, tw, nx, iy, unnest(range(1, nx + 1)) AS ix, xs, ys FROM e)
SELECT o_orderkey, count(*) AS tiles,
  CAST(sum(((iy - 1) * nx + ix - 1) * (xs[ix] + 3 * ys[iy] + 5 * (xs[ix] + tw) + 7 * (ys[iy] + th)))
    AS BIGINT) AS checksum FROM f GROUP BY 1""")
def tile_grid(t: Tables):
    price = F.col("o_totalprice")
    grid = maps.tile_grid((1 + F.floor(price / 2000)).cast("int"),
                          (1 + F.floor(price / 3000)).cast("int"), 64, 48, 0.25)
    check = F.aggregate("g", F.lit(0).cast("long"), lambda a, s: a + s["tile_id"].cast("long") * (
        s["x0"] + 3 * s["y0"] + 5 * s["x1"] + 7 * s["y1"]))
    return t.orders.select("o_orderkey", grid.alias("g")).select(
        "o_orderkey", F.size("g").cast("long").alias("tiles"), check.alias("checksum"))


_TILES = """tile(tile_id, x0, y0, x1, y1) AS (VALUES (0, 0, 0, 5, 5), (1, 3, 0, 8, 5),
  (2, 0, 3, 5, 8), (3, 3, 3, 8, 8)),
tpx AS (SELECT image_id, tile_id, x0, y0, x1, y1, y, x, p FROM img JOIN tile
  ON y >= y0 AND y < y1 AND x >= x0 AND x < x1)"""


@query(f"""WITH {b.IMAGES}, {_TILES}
SELECT image_id, tile_id, x0, y0, x1, y1, string_agg(p, ',' ORDER BY y, x) AS pixels
FROM tpx GROUP BY ALL""")
def extract_tiles(t: Tables):
    return images.tiles(b.images(t), 5, 5, 0.25).select(
        "image_id", "tile_id", "x0", "y0", "x1", "y1", _joined("tile_pixels").alias("pixels"))


@query(f"""WITH {b.IMAGES}, {_TILES},
g AS (SELECT *, greatest((5e-1 - 5e-1 * cos(2 * pi() * (y - y0) / 4))
  * (5e-1 - 5e-1 * cos(2 * pi() * (x - x0) / 4)), 1e-3) AS w FROM tpx)
SELECT image_id, y::INT AS y, x::INT AS x, round(sum(w * p * (1 + tile_id)) / sum(w), 6) AS value
FROM g GROUP BY ALL""")
def merge_tiles(t: Tables):
    cut = images.tiles(b.images(t), 5, 5, 0.25)
    scored = cut.withColumn("tile_pixels", F.transform(
        "tile_pixels", lambda v: (v * (1 + F.col("tile_id"))).cast("double")))
    return rounded(images.merge_tiles(scored), "value")


@query(f"""WITH {b.IMAGES}, {_TILES},
s AS (SELECT image_id, tile_id, avg(p) AS tile_score FROM tpx GROUP BY 1, 2)
SELECT image_id, round(max(tile_score), 6) AS score FROM s GROUP BY 1""")
def image_score(t: Tables):
    scores = images.tiles(b.images(t), 5, 5, 0.25).select(
        "image_id", maps.map_mean(F.col("tile_pixels")).alias("tile_score"))
    return rounded(images.image_score(scores), "score")


_REGIONS = f"""WITH RECURSIVE {b.IMAGES}, {blur3_sql("img", "smooth", "p")},
{regions_sql("smooth", "135", 3)}"""


def _regions(t: Tables):
    return images.extract_regions(b.images(t), 135.0, 3)


@query(f"""{_REGIONS}
SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY root)::INT AS region_id,
  x0::INT AS x0, y0::INT AS y0, x1::INT AS x1, y1::INT AS y1, area_pixels::INT AS area_pixels,
  round(area_pixels / 64e0, 6) AS area_ratio, round(mean_score, 6) AS mean_score,
  round(max_score, 6) AS max_score, round(centroid_x, 6) AS centroid_x,
  round(centroid_y, 6) AS centroid_y FROM region""")
def regions(t: Tables):
    return rounded(images.region_rows(_regions(t)), "area_ratio", "mean_score", "max_score",
                   "centroid_x", "centroid_y")


@query(f"{_REGIONS} SELECT image_id, round(area_ratio, 6) AS area_ratio FROM filled")
def filled_area(t: Tables):
    return rounded(_regions(t).select("image_id", "area_ratio"), "area_ratio")


_CASES = [*(("brightness", v) for v in (0.7, 0.85, 1.15, 1.3)),
          *(("contrast", v) for v in (0.7, 0.85, 1.15, 1.3)), ("blur", 3.0), ("occlusion", 0.3)]

_PERTURB = f"""{blur3_sql("img", "smooth", "p")},
med AS (SELECT image_id, floor(quantile_cont(p::DOUBLE, 5e-1)) AS m FROM img GROUP BY 1),
cases(kind, value) AS (VALUES {", ".join(f"('{k}', {v}::DOUBLE)" for k, v in _CASES)}),
bent AS (
  SELECT image_id, kind, value, y, x, floor(least(255e0, greatest(0e0, CASE kind
    WHEN 'brightness' THEN p * value WHEN 'contrast' THEN (p - 1275e-1) * value + 1275e-1
    WHEN 'blur' THEN floor(s + 5e-1)
    ELSE CASE WHEN y IN (3, 4) AND x IN (3, 4) THEN m ELSE p END END)))::INT AS p
  FROM img JOIN smooth USING (image_id, y, x) JOIN med USING (image_id), cases)"""


@query(f"""WITH {b.IMAGES}, {_PERTURB}
SELECT image_id, kind, value, string_agg(p, ',' ORDER BY y, x) AS pixels FROM bent
GROUP BY 1, 2, 3""")
def perturb_sweep(t: Tables):
    return images.perturb_sweep(b.images(t), _CASES).select(
        "image_id", "kind", "value", _joined("pixels").alias("pixels"))


def _matrix_sql(name: str, matrix: np.ndarray) -> str:
    """A matrix as rows (i, j, w)."""
    cells = ", ".join(f"({i}, {j}, {float(w)!r}::DOUBLE)" for (i, j), w in np.ndenumerate(matrix)
                      if w)
    return f"{name}(i, j, w) AS (VALUES {cells})"


def _linear_sql(name: str, source: str, value: str, matrix: str, rounding: str) -> str:
    """A separable linear map of square images: rows and columns by one matrix."""
    return f"""{name} AS (SELECT image_id, a.i AS y, c.i AS x,
    {rounding.format(f"sum(a.w * c.w * s.{value})")} AS v FROM {source} s
  JOIN {matrix} a ON a.j = s.y JOIN {matrix} c ON c.j = s.x GROUP BY 1, 2, 3)"""


_UNIT = np.eye(8)
_NOISE, _BLURS, _SHRINKS = (5.0, 10.0, 20.0), (5, 7), (0.75, 0.5)
_SEEDED = ", ".join(
    [_matrix_sql(f"noise{k}", kernels.noise((8, 8), s, 42)) for k, s in enumerate(_NOISE)]
    + [f"""n{k} AS (SELECT image_id, 'gaussian_noise' AS kind, {s}::DOUBLE AS value, y, x, p + w AS v
  FROM img JOIN noise{k} ON i = y AND j = x)""" for k, s in enumerate(_NOISE)]
    # the blur of unit rows gives its taps with mirrored borders
    + [_matrix_sql(f"taps{n}", np.stack([kernels.gaussian(np.tile(_UNIT[i], (8, 1)), n)[0]
                                         for i in range(8)]).T) for n in _BLURS]
    + [_linear_sql(f"b{n}", "img", "p", f"taps{n}", "floor({} + 5e-1)") for n in _BLURS]
    + [x for k, s in enumerate(_SHRINKS) for x in (
        _matrix_sql(f"down{k}", kernels.resize_area(_UNIT, round(8 * s), 8)),
        _matrix_sql(f"up{k}", kernels.resize_linear(np.eye(round(8 * s)), 8, round(8 * s))),
        _linear_sql(f"small{k}", "img", "p", f"down{k}", "round_even(round({}, 9), 0)"),
        _linear_sql(f"back{k}", f"small{k}", "v", f"up{k}", "round_even(round({}, 9), 0)"))]
    + ["every AS (" + " UNION ALL ".join(
        [f"SELECT * FROM n{k}" for k in range(len(_NOISE))]
        + [f"SELECT image_id, 'blur', {n}::DOUBLE, y, x, v FROM b{n}" for n in _BLURS]
        + [f"SELECT image_id, 'downsample', {s}::DOUBLE, y, x, v FROM back{k}"
           for k, s in enumerate(_SHRINKS)]) + ")"])


@query(f"""WITH {b.IMAGES}, {_SEEDED}
SELECT image_id, kind, value, string_agg(floor(least(255, greatest(0, v)))::INT, ',' ORDER BY y, x)
  AS pixels FROM every GROUP BY 1, 2, 3""")
def perturb_seeded(t: Tables):
    """Noise, blur and resampling; seeded draws and weights stand in the SQL as constants."""
    cases = [*(("gaussian_noise", s) for s in _NOISE), *(("blur", float(n)) for n in _BLURS),
             *(("downsample", s) for s in _SHRINKS)]
    return images.perturb_sweep(b.images(t), cases).select(
        "image_id", "kind", "value", _joined("pixels").alias("pixels"))


def _perturbation_pairs(t: Tables):
    def mean_score(df, *keep):
        return df.select(*keep, (maps.map_mean(F.col("pixels")) / 255.0).alias("score"))

    base = b.images(t)
    return compare.paired_perturbation(
        mean_score(base, "image_id"),
        mean_score(images.perturb_sweep(base, _CASES), "image_id", "kind", "value"), "image_id")


_PAIRED = """sc AS (SELECT image_id, kind, value, avg(p) / 255 AS score FROM bent GROUP BY 1, 2, 3),
bs AS (SELECT image_id, avg(p) / 255 AS baseline_score FROM img GROUP BY 1),
pp AS (SELECT * FROM sc JOIN bs USING (image_id))"""


@query(f"""WITH {b.IMAGES}, {_PERTURB}, {_PAIRED}
SELECT image_id, kind, value, round(score, 6) AS score, round(baseline_score, 6) AS baseline_score
FROM pp""")
def paired_perturbation(t: Tables):
    return rounded(_perturbation_pairs(t), "score", "baseline_score")


@query(f"""WITH {b.IMAGES}, {_PERTURB}, {_PAIRED}
SELECT kind, value, round(avg(score), 6) AS mean_score,
  round(avg(abs(score - baseline_score)), 6) AS mean_absolute_delta,
  round(max(abs(score - baseline_score)), 6) AS max_absolute_delta,
  count(*) FILTER ((score >= 5e-1) <> (baseline_score >= 5e-1)) AS decision_flips
FROM pp GROUP BY 1, 2""")
def robustness_delta(t: Tables):
    out = compare.robustness_delta(_perturbation_pairs(t), F.lit(0.5))
    return rounded(out, "mean_score", "mean_absolute_delta", "max_absolute_delta")


@query(f"""WITH {b.IMAGES}, {_RESIDUAL}
SELECT image_id, round(score, 6) AS score FROM rscore""")
def residual_score(t: Tables):
    out = scoring.score_images(b.images(t), scoring.residual_scorer(), ["image_id"])
    return rounded(out.select("image_id", "score"), "score")


_ANALYZE = f"""{b.IMAGES}, {_QUALITY}, {_RESIDUAL}, {blur3_sql("resid", "smooth", "r")},
{regions_sql("smooth", "22e-2", 3)},
found AS (SELECT image_id, count(*) AS region_count FROM region GROUP BY 1),
raw AS (SELECT g.image_id, quality_status,
    CASE WHEN quality_status = 'ABSTAIN' THEN 0 ELSE score END AS score,
    CASE WHEN quality_status = 'ABSTAIN' THEN 0 ELSE area_ratio END AS area_ratio,
    CASE WHEN quality_status = 'ABSTAIN' THEN 0 ELSE coalesce(region_count, 0) END AS region_count
  FROM gate g JOIN rscore USING (image_id) JOIN filled USING (image_id)
  LEFT JOIN found USING (image_id)),
dec AS (SELECT *, CASE WHEN quality_status <> 'PASS' THEN quality_status
  WHEN score >= 52e-2 THEN 'ANOMALY' ELSE 'NORMAL' END AS decision FROM raw),
result AS (SELECT *, CASE decision WHEN 'ABSTAIN' THEN 'ABSTAIN' WHEN 'NORMAL' THEN 'P0'
  ELSE CASE WHEN score / 52e-2 >= 2 OR area_ratio >= 1e-1 THEN 'P3'
    WHEN score / 52e-2 >= 125e-2 OR area_ratio >= 3e-2 THEN 'P2' ELSE 'P1' END END
  AS review_priority FROM dec)"""


def _analyze(rows):
    return images.analyze_images(rows, scoring.residual_scorer(), 0.52, 0.22, 3, SMALL_GATE)


@query(f"""WITH RECURSIVE {_ANALYZE}
SELECT image_id, quality_status, round(score, 6) AS score, round(area_ratio, 6) AS area_ratio,
  region_count::INT AS region_count, decision, review_priority FROM result""")
def analyze_images(t: Tables):
    out = _analyze(b.images(t)).select("image_id", "quality_status", "score", "area_ratio",
                                       "region_count", "decision", "review_priority")
    return rounded(out, "score", "area_ratio")


@query(f"""WITH RECURSIVE {_ANALYZE},
quarter AS (SELECT image_id, label, (y // 4) * 2 + x // 4 AS k, avg(p) AS m FROM img GROUP BY 1, 2, 3),
qbit AS (SELECT *, CASE WHEN m >= avg(m) OVER (PARTITION BY image_id) THEN 1 ELSE 0 END AS bit
  FROM quarter),
dig AS (SELECT image_id, label, string_agg(bit, '' ORDER BY k) AS digest FROM qbit GROUP BY 1, 2),
ok AS (SELECT image_id, row_number() OVER (PARTITION BY digest ORDER BY
  lpad(CAST(image_id AS VARCHAR), 9, '0')) AS r FROM dig WHERE label <> 9)
SELECT o.image_id, CASE WHEN r > 1 THEN 'DUPLICATE_INPUT' END AS error_code,
  CASE WHEN r = 1 THEN decision END AS decision FROM ok o JOIN result USING (image_id)
UNION ALL SELECT image_id, 'IMAGE_INVALID', NULL FROM dig WHERE label = 9""")
def analyze_batch(t: Tables):
    """Label 9 stands for broken files; images with the same 2 x 2 average hash count as copies."""
    rows = b.images(t).join(t.embeddings.select(F.col("vec_id").alias("image_id"), "label"),
                            "image_id")
    rows = rows.withColumns({
        "sha256": audit.average_hash(F.col("pixels"), 8, 8, size=2), "path": F.lpad(F.col("image_id").cast("string"), 9, "0")})
    broken = rows.where("label = 9").select("image_id", F.lit("IMAGE_INVALID").alias(
        "error_code"))
    first, copies = images.unique_images(rows.where("label <> 9"))
    done = _analyze(first.select("image_id", "height", "width", "pixels")).select(
        "image_id", "decision")
    copies = copies.select(F.col("path").cast("long").alias("image_id"), "error_code")
    return audit.batch_result(audit.batch_result(done, copies), broken).select(
        "image_id", "error_code", "decision")


@query(f"""WITH RECURSIVE {b.IMAGES}, marked AS (SELECT image_id, y, x, p AS s FROM img),
{regions_sql("marked", "150", 1)},
shares AS (SELECT c.image_id, root, avg(CASE WHEN p >= 170 THEN 1e0 ELSE 0e0 END) AS share
  FROM comp c JOIN img USING (image_id, y, x) GROUP BY 1, 2)
SELECT i.image_id, count(root)::INT AS region_count, round(avg(share), 6) AS region_overlap
FROM (SELECT DISTINCT image_id FROM img) i LEFT JOIN shares USING (image_id) GROUP BY 1""")
def region_overlap(t: Tables):
    """Masks are the pixels from 150 on; the map reaches them from 170 on."""
    rows = b.images(t).withColumn("mask", F.transform(
        "pixels", lambda v: F.when(v >= 150, 1).otherwise(0)))
    return rounded(images.region_overlap(rows, 170.0), "region_overlap")


@query(f"""WITH {b.IMAGES},
cells AS (SELECT image_id, (y // 2) * 4 + x // 2 AS k, avg(p) AS v FROM img GROUP BY 1, 2),
bits AS (SELECT image_id, k, CASE WHEN v >= avg(v) OVER (PARTITION BY image_id) THEN 1 ELSE 0 END
  AS bit FROM cells)
SELECT image_id, string_agg(d, '' ORDER BY g) AS hash FROM (
  SELECT image_id, k // 4 AS g, substr('0123456789abcdef',
    1 + sum(bit * CAST(pow(2, 3 - k % 4) AS INT))::INT, 1) AS d FROM bits GROUP BY 1, 2)
GROUP BY 1""")
def image_hashes(t: Tables):
    return images.image_hashes(b.images(t), size=4)
