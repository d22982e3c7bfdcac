"""Queries of the region curve and of defect areas on 8 x 8 maps, one model per label."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import region_curve
from plumbline.plans import bindings as b
from plumbline.plans.registry import Tables, query, rounded


def _maps(t: Tables):
    return b.maps_and_masks(t).select(
        "model", F.lit(8).alias("height"), F.lit(8).alias("width"), F.transform(
            "scores", lambda v: v.cast("double")).alias("pixels"), "mask")


# regions by reachability, their pixels weighed by area, and the curve by plain windows
_CURVE = """px AS (
  SELECT vec_id, label AS model, (i - 1) // 8 AS y, (i - 1) % 8 AS x, embedding[i]::DOUBLE AS v,
    CASE WHEN embedding[i]::DOUBLE + embedding[65 - i]::DOUBLE >= 2e-1 THEN 1 ELSE 0 END AS m
  FROM embeddings, unnest(range(1, 65)) AS r(i)),
on_px AS (SELECT vec_id, y, x FROM px WHERE m = 1),
reach(vec_id, sy, sx, y, x) AS (
  SELECT vec_id, y, x, y, x FROM on_px
  UNION SELECT r.vec_id, r.sy, r.sx, n.y, n.x FROM reach r JOIN on_px n
    ON n.vec_id = r.vec_id AND abs(n.y - r.y) <= 1 AND abs(n.x - r.x) <= 1),
root AS (SELECT vec_id, sy AS y, sx AS x, min(y * 8 + x) AS root, count(*) AS area
  FROM reach GROUP BY 1, 2, 3),
weighed AS (SELECT model, v, coalesce(1 / area::DOUBLE, 0) AS w, CASE WHEN m = 1 THEN 0 ELSE 1 END AS o,
  CASE WHEN root = y * 8 + x THEN 1 ELSE 0 END AS r FROM px LEFT JOIN root USING (vec_id, y, x)),
total AS (SELECT model, sum(r) AS regions, sum(o) AS outside FROM weighed GROUP BY 1),
step AS (SELECT model, v, sum(w) AS w, sum(o) AS o FROM weighed GROUP BY 1, 2),
cum AS (SELECT model, v, w / regions AS dw, o / outside AS dx,
    sum(w) OVER down / regions AS y1, sum(o) OVER down / outside AS x1
  FROM step JOIN total USING (model) WINDOW down AS (PARTITION BY model ORDER BY v DESC)),
cut AS (SELECT *, x1 - dx AS x0, y1 - dw AS y0, least(x1, 3e-1) AS e FROM cum),
area AS (SELECT model, sum(CASE WHEN x0 < 3e-1 THEN (e - x0) * (2 * y0
    + CASE WHEN x1 > x0 THEN (y1 - y0) * (e - x0) / (x1 - x0) ELSE 0 END) / 2 ELSE 0 END) / 3e-1 AS a
  FROM cut GROUP BY 1)"""


@query(f"""WITH RECURSIVE {_CURVE}
SELECT model, regions::BIGINT AS region_count, round(a, 6) AS region_curve_area
FROM area JOIN total USING (model)""")
def pro_curve_area(t: Tables):
    """Mean region overlap over the false-positive rate, up to a rate of 0.3."""
    return rounded(region_curve.region_curve_area(_maps(t), ["model"]), "region_curve_area")


_AREAS = """n AS (SELECT model, vec_id, count(*) FILTER (v >= 15e-2) AS p, count(*) FILTER (m = 1) AS t
  FROM px GROUP BY 1, 2),
g AS (SELECT *, (p - t) / 64e0 AS gap FROM n),
err AS (SELECT model, count(*) AS images, avg(gap) AS mean_area_error,
    avg(abs(gap)) AS mean_absolute_area_error, max(abs(gap)) AS max_absolute_area_error,
    CASE WHEN sum(t) > 0 THEN (sum(p) - sum(t)) / sum(t)::DOUBLE END AS relative_error
  FROM g GROUP BY 1)"""
_AREA_COLUMNS = ("mean_area_error", "mean_absolute_area_error", "max_absolute_area_error",
                 "relative_error")


@query(f"""WITH RECURSIVE {_CURVE}, {_AREAS}
SELECT model, images, {", ".join(f"round({c}, 6) AS {c}" for c in _AREA_COLUMNS)} FROM err""")
def defect_area_error(t: Tables):
    """Marked shares at 0.15 against the masks."""
    return rounded(region_curve.defect_area_error(_maps(t), ["model"], F.lit(0.15)), *_AREA_COLUMNS)


@query(f"""WITH RECURSIVE {_CURVE}, {_AREAS},
o AS (SELECT model, count(*) FILTER (v >= 15e-2 AND m = 1) AS i, count(*) FILTER (v >= 15e-2) AS p,
  count(*) FILTER (m = 1) AS t FROM px GROUP BY 1),
c AS (SELECT model, v, count(*) FILTER (m = 1) AS p, count(*) FILTER (m = 0) AS n FROM px GROUP BY 1, 2),
k AS (SELECT *, sum(p) OVER d AS pc, sum(n) OVER d AS nc FROM c
  WINDOW d AS (PARTITION BY model ORDER BY v DESC)),
r AS (SELECT model, sum(n * (pc - p + p / 2e0)) / (sum(p) * sum(n)) AS auroc,
  sum(p * (pc / (pc + nc)::DOUBLE)) / sum(p) AS ap FROM k GROUP BY 1)
SELECT model, round(i / (p + t - i)::DOUBLE, 6) AS pixel_iou, round(2 * i / (p + t)::DOUBLE, 6)
    AS pixel_dice, round(auroc, 6) AS pixel_auroc, round(ap, 6) AS pixel_average_precision,
  regions::BIGINT AS region_count, round(a, 6) AS region_curve_area, images,
  {", ".join(f"round({c}, 6) AS {c}" for c in _AREA_COLUMNS)}
FROM o JOIN r USING (model) JOIN total USING (model) JOIN area USING (model) JOIN err USING (model)""")
def pixel_report(t: Tables):
    """All pixel measures of a model in one row."""
    out = region_curve.pixel_report(_maps(t), ["model"], F.lit(0.15))
    return rounded(out, "pixel_iou", "pixel_dice", "pixel_auroc", "pixel_average_precision",
                   "region_curve_area", *_AREA_COLUMNS)
