"""Connected components of an edge table, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecspark.llm.shared import Scratch


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component): the smallest id that each end of an edge (a, b) reaches.

    Alternates the large-star and small-star steps of Kiveris et al. (2014) until the edges stay as they are,
    which takes a number of rounds logarithmic in the longest path. Each step groups by node with a map-side
    minimum and joins the minimum back, so no node's neighbours meet in one row.
    """
    scratch = Scratch(edges.sparkSession, "components")
    now = scratch.put(_sorted(edges), "edges")
    before = _state(now)
    if before[0] == 0:
        return now.select(F.col("a").alias("id"), F.col("b").alias("component"))
    for round_ in range(max_rounds):
        last, name = ("edges" if not round_ else f"edges{round_ - 1}"), f"edges{round_}"
        # the least neighbours are written, so that the join's side of a node with very many can be split
        least = scratch.put(_least_neighbours(now), f"least{round_}")
        now = scratch.put(_small_star(_large_star(now, least)), name)
        scratch.drop(last, f"least{round_}")
        after = _state(now)
        if after == before:
            return now.select(F.col("b").alias("id"), F.col("a").alias("component")).union(
                now.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct()
            )
        before = after
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _sorted(edges: DataFrame) -> DataFrame:
    return edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a") % 1_000_003)).first()
    return tuple(row)


def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))


def _least_neighbours(edges: DataFrame) -> DataFrame:
    return _both(edges).groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _large_star(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the smallest of the node and its neighbours."""
    return _both(edges).join(least, "u").where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a < b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are tied to the smallest of them."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    tied = edges.join(least, "b")
    return (
        tied.select(F.col("m").alias("x"), F.col("a").alias("y"))
        .union(tied.select(F.col("m").alias("x"), F.col("b").alias("y")))
        .where("x < y")
        .distinct()
        .select(F.col("x").alias("a"), F.col("y").alias("b"))
    )
