"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import stored


def _star(edges: DataFrame, wide: bool) -> DataFrame:
    """Move the links of each node to its smallest neighbour (or itself)."""
    if wide:
        near = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = near.groupBy("a").agg(F.min("b").alias("m")).select(
        "a", F.least("a", "m").alias("m"))
    moved = near.join(least, "a")
    if wide:
        moved = moved.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            least.select("a", F.col("m").alias("b")))
    return moved.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its smallest node) of every node of the links ``a``, ``b``.

    Alternates wide and narrow stars until the links no longer change; each round is written to
    the shared folder, so no lineage grows and no links pass through the driver.
    """
    def size(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    links = stored(edges.select("a", "b").where("a <> b").distinct(), "links")
    seen = size(links)
    while True:
        links = stored(_star(_star(links, True), False), "links")
        now = size(links)
        if now == seen:
            break
        seen = now
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        links.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
