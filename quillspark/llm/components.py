"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, save


def _stamp(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) of every node with a link to another; component is the smallest id reachable.

    Nulls and self links are ignored, repeated links count once, an empty table gives an empty table. Each
    round rewires a node's links to its smallest neighbour, so hubs keep linear size; the table of a round is
    written to the shared folder and only its count and a checksum come to the driver.
    """
    e = edges.select(F.col(a).cast("long").alias("p"), F.col(b).cast("long").alias("q")).where("p <> q").select(F.greatest("p", "q").alias("u"), F.least("p", "q").alias("v")).distinct()
    e = save(e, "links")
    stamp = _stamp(e)
    while stamp[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = save(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "links")
        now = _stamp(new)
        drop(e)
        e = new
        if now == stamp:
            break
        stamp = now
    star = e.groupBy("u").agg(F.min("v").alias("v"))
    return star.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(star.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
