"""Connected components of a link table by alternating large-star and small-star steps (TRN2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.session import stored, unstored


def _stamp(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def connected(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) of every node with a link to another; component is the smallest id reachable.

    Ids are of any kind that has an order. Nulls and self links are ignored, repeated links count once, an empty
    table gives an empty table. Each round rewires a node's links to its smallest neighbour, so hubs keep linear
    size; a round's table goes as soon as the next one is written, and only its count and a checksum come to the
    driver.
    """
    pairs = links.select(F.col(a).alias("p"), F.col(b).alias("q")).where("p <> q")
    e = stored(pairs.select(F.greatest("p", "q").alias("u"), F.least("p", "q").alias("v")).distinct(), "links")
    stamp = _stamp(e)
    while stamp[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = stored(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "links")
        now = _stamp(new)
        unstored(e)
        e = new
        if now == stamp:
            break
        stamp = now
    star = e.groupBy("u").agg(F.min("v").alias("v"))
    return star.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(star.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def grown(labels: DataFrame, links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) after new links: labels (id, component) of before, each row of them kept or moved.

    A new link is taken as one between the components of its ends; only these few are connected anew, and the rows
    of components that no new link touches keep their label as they are. The result is what `connected` gives for all
    links at once, and ids that only the new links have join it.
    """
    old = labels.select("id", "component")
    sides = links.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("p"), F.col(b).alias("q"))
    named = sides.join(old.select(F.col("id").alias("p"), F.col("component").alias("cp")), "p", "left").join(old.select(F.col("id").alias("q"), F.col("component").alias("cq")), "q", "left")
    named = stored(named.select("p", "q", F.coalesce("cp", "p").alias("cp"), F.coalesce("cq", "q").alias("cq")), "named")
    moved = connected(named, "cp", "cq").select(F.col("id").alias("component"), F.col("component").alias("m"))
    ends = named.where("p <> q").select(F.col("p").alias("id"), F.col("cp").alias("component")).unionByName(named.where("p <> q").select("q", "cq").toDF("id", "component"))
    fresh = ends.distinct().join(old.select("id"), "id", "left_anti")
    return old.unionByName(fresh).join(moved, "component", "left").select("id", F.coalesce("m", "component").alias("component"))
