"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import materialize


def _to_smallest(links: DataFrame, larger_only: bool) -> DataFrame:
    """Hang the neighbours of each node on the smallest of them and the node itself."""
    if larger_only:  # large star: all neighbours decide, the larger ones move
        sides = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:  # small star: only smaller neighbours decide and move
        sides = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = sides.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
    moved = sides.join(least, "a")
    if larger_only:
        moved = moved.filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        moved = moved.select("b", "least").unionByName(least.select(
            F.col("a").alias("b"), "least")).select(F.col("b").alias("a"),
                                                    F.col("least").alias("b"))
    return moved.filter("a <> b").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b", *, rounds: int = 60) -> DataFrame:
    """Node and ``root`` (the smallest node reachable) of every node with a link to another.

    A round hangs larger neighbours and then smaller ones on the smallest node known; it ends when
    the links are stars around their roots and no longer change. Every round is written to shared
    storage. Loops and null ends are no links; an empty table has no component.
    """
    spark = links.sparkSession
    now = materialize(spark, links.select(F.least(a, b).alias("b"), F.greatest(a, b).alias(
        "a")).filter("a <> b and a is not null and b is not null").distinct(), "links")
    mark = None
    for _ in range(rounds):
        now = materialize(spark, _to_smallest(_to_smallest(now, True), False), "links")
        was, mark = mark, now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast(
            "decimal(38,0)"))).first()
        if mark == was:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    raise RuntimeError(f"components did not settle within {rounds} rounds")
