"""Image maps held as row-major arrays: column expressions without Python."""

from __future__ import annotations


from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body) -> Column:
    """``body`` of a value that is computed once per row.

    A lambda variable is a value, while a column used several times may be inlined by the
    optimizer and then computed anew inside every loop.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _starts(length: Column, tile: Column, overlap: float) -> Column:
    """Tile starts along one axis, with a last tile anchored at the border."""
    size = F.least(length, tile)
    stride = F.greatest(F.lit(1), F.bround(size * F.lit(1.0 - overlap)).cast("int"))
    last = (length - size).cast("int")
    return F.array_union(F.sequence(F.lit(0), last, stride), F.array(last))


def tile_grid(height: Column, width: Column, tile_height: int, tile_width: int,
              overlap: float) -> Column:
    """Array of struct(tile_id, x0, y0, x1, y1) covering the image, row by row."""
    if min(tile_height, tile_width) <= 0:
        raise ValueError("tile sides must be positive")
    if not 0.0 <= overlap < 1.0:
        raise ValueError("overlap must lie in [0, 1)")
    th, tw = F.least(height, F.lit(tile_height)), F.least(width, F.lit(tile_width))
    ys = _starts(height, F.lit(tile_height), overlap)
    xs = _starts(width, F.lit(tile_width), overlap)
    corners = F.flatten(F.transform(ys, lambda y: F.transform(
        xs, lambda x: F.struct(x.alias("x"), y.alias("y")))))
    return F.transform(corners, lambda c, i: F.struct(
        i.cast("int").alias("tile_id"), c["x"].cast("int").alias("x0"),
        c["y"].cast("int").alias("y0"), (c["x"] + tw).cast("int").alias("x1"),
        (c["y"] + th).cast("int").alias("y1")))


def cut_tile(pixels: Column, width: Column, tile: Column, channels: Column | int = 1) -> Column:
    """Pixels of one tile, row-major; the channels of a pixel stand together."""
    n = F.lit(channels) if isinstance(channels, int) else channels
    return F.flatten(F.transform(
        F.sequence(tile["y0"], tile["y1"] - 1),
        lambda y: F.slice(pixels, (y * width + tile["x0"]) * n + 1, (tile["x1"] - tile["x0"]) * n)))


def clipped(value: Column) -> Column:
    """A byte: cut to 0..255, then the whole part."""
    return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), value))).cast("int")


def brightened(pixels: Column, factor: Column) -> Column:
    return F.transform(pixels, lambda v: clipped(v.cast("double") * factor))


def contrasted(pixels: Column, factor: Column) -> Column:
    """Distance from the middle grey times a factor."""
    return F.transform(pixels, lambda v: clipped(127.5 + factor * (v.cast("double") - 127.5)))


def occluded(pixels: Column, height: Column, width: Column, share: Column) -> Column:
    """A centred box, with that share of both sides, filled with each channel's median."""
    channels = (F.size(pixels) / (height * width)).cast("int")

    def median(channel: Column, n: Column) -> Column:
        own = F.sort_array(F.filter(pixels, lambda _, i: i % n == channel))
        return bind(own, lambda o: (F.get(o, ((F.size(o) - 1) / 2).cast("int")).cast(
            "double") + F.get(o, (F.size(o) / 2).cast("int"))) / 2.0)

    side_y = F.greatest(F.lit(1), F.floor(height * share).cast("int"))
    side_x = F.greatest(F.lit(1), F.floor(width * share).cast("int"))
    box = F.struct(channels.alias("n"), side_y.alias("h"), side_x.alias("w"),
                   F.floor((height - side_y) / 2).cast("int").alias("y"),
                   F.floor((width - side_x) / 2).cast("int").alias("x"),
                   F.transform(F.sequence(F.lit(0), channels - 1),
                               lambda c: median(c, channels)).alias("fill"))

    def paint(b: Column) -> Column:
        def at(v: Column, i: Column) -> Column:
            y, x = F.floor(i / (width * b["n"])), F.floor(i / b["n"]) % width
            inside = (y >= b["y"]) & (y < b["y"] + b["h"]) & (x >= b["x"]) & (x < b["x"] + b["w"])
            return clipped(F.when(inside, F.get(b["fill"], i % b["n"])).otherwise(v.cast("double")))
        return F.transform(pixels, at)

    return bind(box, paint)


def map_mean(pixels: Column) -> Column:
    total = F.aggregate(pixels, F.lit(0.0), lambda a, v: a + v.cast("double"))
    return total / F.size(pixels)


def normalize(pixels: Column) -> Column:
    """Min-max to whole numbers 0..255; all zero for a flat map."""
    def scale(px: Column) -> Column:
        span = F.struct(F.array_min(px).cast("double").alias("lo"),
                        F.array_max(px).cast("double").alias("hi"))
        return bind(span, lambda s: F.transform(px, lambda v: F.when(s["hi"] > s["lo"], F.floor(
            (v.cast("double") - s["lo"]) * 255.0 / (s["hi"] - s["lo"]))).otherwise(0).cast("int")))

    return bind(pixels, scale)


def array_quantile(ordered: Column, p: float) -> Column:
    """Linear quantile of a sorted array."""
    at = F.lit(p) * (F.size(ordered) - 1)
    lo = F.element_at(ordered, F.floor(at).cast("int") + 1).cast("double")
    hi = F.element_at(ordered, F.ceil(at).cast("int") + 1).cast("double")
    return lo + (hi - lo) * (at - F.floor(at))


def stretch(pixels: Column, low: float = 0.005, high: float = 0.995) -> Column:
    """Percentile stretch to whole numbers 0..255; all zero for a flat image."""
    def scale(px: Column) -> Column:
        span = bind(F.sort_array(px), lambda o: F.struct(
            array_quantile(o, low).alias("lo"), array_quantile(o, high).alias("hi")))
        return bind(span, lambda s: F.transform(px, lambda v: F.when(s["hi"] > s["lo"], F.floor(
            F.least(F.greatest((v.cast("double") - s["lo"]) * 255.0 / (s["hi"] - s["lo"]),
                               F.lit(0.0)), F.lit(255.0)))).otherwise(0).cast("int")))

    return bind(pixels, scale)
