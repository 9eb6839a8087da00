"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm.common import discard, materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (
        both.where("v > u")
        .join(least, "u")
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .where("u <> v")
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _is_star_forest(edges: DataFrame) -> bool:
    """Whether each child has one parent and no parent is itself a child."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("c"), F.lit(0).alias("p")).unionByName(
        edges.select(F.col("v").alias("n"), F.lit(0).alias("c"), F.lit(1).alias("p"))
    )
    odd = ends.groupBy("n").agg(F.sum("c").alias("c"), F.sum("p").alias("p")).where("c > 1 or (c > 0 and p > 0)")
    return odd.limit(1).count() == 0


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_steps: int = 60) -> DataFrame:
    """``(node, component)`` for every node of ``edges`` but the roots.

    ``component`` is the smallest node id reachable.  Nulls, self links,
    repeated and reversed edges are allowed; an empty table gives an empty
    result.  Nodes that are their own component's smallest id are left out,
    so a caller uses ``coalesce(component, node)``.  Each pair of steps is
    written to the shared folder; no links reach the driver.  The number of
    steps grows with the square of the logarithm of a component's size.
    """
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    current = materialize(
        edges.select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v"))
        .where(x.isNotNull() & y.isNotNull() & (x != y))
        .distinct(),
        "edges",
    )
    for _ in range(max_steps):
        if _is_star_forest(current):
            return current.select(F.col("u").alias("node"), F.col("v").alias("component"))
        following = materialize(_small_star(_large_star(current)), "edges")
        discard(current)
        current = following
    raise RuntimeError(f"components did not settle in {max_steps} steps")
