"""Connected components of links, by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenflow.session import materialize


def _smallest_neighbour(links: DataFrame) -> DataFrame:
    return links.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(links: DataFrame) -> DataFrame:
    """Every node's larger neighbours move to its smallest neighbour."""
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _smallest_neighbour(both).select("u", F.least("u", "m").alias("m"))
    return both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours move to the smallest of them; `u` > `v` in every link."""
    moved = links.join(_smallest_neighbour(links), "u")
    return moved.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*")


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """`node`, `root` for every node of a link; the root is the smallest node of the component.

    Links live in the shared checkpoint folder between rounds; rounds grow with the logarithm of
    the longest chain, and every round's links are at most as many as before.
    """
    ordered = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    current = materialize(ordered.distinct())
    state = None
    while True:
        step = _large_star(current).where("u != v").distinct()
        current = materialize(_small_star(step).where("u != v").distinct())
        before, state = state, tuple(current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            return current.select(F.col("u").alias("node"), F.col("v").alias("root"))
