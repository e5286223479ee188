"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _are_stars(edges: DataFrame) -> bool:
    """True if every node with a smaller neighbour has just one, and that one has none."""
    ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("v").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    seen = ends.groupBy("id").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    return seen.filter("up > 1 or (up > 0 and down > 0)").isEmpty()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) of every id that has an edge; component = smallest id reachable.

    Large-star and small-star steps alternate until all edges are stars around
    the smallest id (about log n rounds; one if the edges are stars that share no node). A
    node of any degree is handled by a partial minimum and a join that adaptive
    execution splits; no neighbour list is gathered. Each round is a checkpoint
    in ``spark.checkpoint.dir``. Nulls, loops and repeated edges are dropped
    first; no edges give no rows.
    """
    e = (edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
         .select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v"))
         .distinct().checkpoint())
    while not _are_stars(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.filter("v > u").join(low, "u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v"))
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low2, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .filter("u <> v").unionByName(low2.select("u", F.col("m").alias("v"))))
        e = small.distinct().checkpoint()
    # every node stands with its centre, and every centre with itself
    return (e.unionByName(e.select(F.col("v").alias("u"), "v")).distinct()
            .select(F.col("u").alias("id"), F.col("v").alias("component")))
