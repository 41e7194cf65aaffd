"""Connected components of links between rows, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallystone.llm.store import written


def _edges(frame: DataFrame) -> DataFrame:
    return frame.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the least node around it."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    tied = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
    return tied.filter("u <> v")  # what repeats here goes with the small star


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    joined = edges.join(least, "u")
    tied = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(
        least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return _edges(tied)


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(
        F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of ``links`` (a, b); a component is its least node.

    Each round is written to the shared folder, so lineage stays short and a lost executor
    costs one round. Rounds grow with the logarithm of the longest path. Links of a node
    with itself and repeated links change nothing; no links give an empty table.
    """
    edges = written(_edges(links), "links")
    state = _state(edges)
    while state[0]:
        following = written(_small_star(_large_star(edges)), "links")
        reached = _state(following)
        edges, done = following, reached == state
        if done:
            break
        state = reached
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
