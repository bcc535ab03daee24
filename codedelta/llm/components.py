"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codedelta.llm.common import write_table


def _step(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: larger neighbours of each node move to its least neighbour (or itself); small star: the smaller
    ones and the node do.  Minima come from a partial aggregation, so a node with very many neighbours
    gathers none of them."""
    both = edges.union(edges.select(F.col("b"), F.col("a"))) if large else edges
    near = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
    moved = both.join(near, F.col("a") == F.col("n"))
    if large:
        out = moved.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).union(near.select(F.col("n").alias("a"), F.col("m").alias("b")))
    out = out.filter(F.col("a") != F.col("b"))
    return out if large else out.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node that each node of ``edges`` (a, b) reaches; nodes without edges are absent.

    Edges are written after each round (repeated ones go then); rounds end when two follow each other with the
    same edges, which are then stars around the least nodes.  The number of rounds grows with the logarithm of
    the longest path."""
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct()
    e = write_table(e, "edges")
    seen = None
    while True:
        e = write_table(_step(_step(e, True), False), "edges")
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == seen:
            break
        seen = tuple(now)
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        e.select(F.col("b"), F.col("b")).distinct())
