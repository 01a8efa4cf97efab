"""Distributed connected components with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, tidy


def _pull(edges: DataFrame, larger_only: bool) -> DataFrame:
    """Points neighbours of each node to the least of the node and its neighbours.

    larger_only: the large-star step, which takes all neighbours and moves the larger ones; else the
    small-star step, which takes the smaller ones. The least neighbour comes from a map-side
    aggregate and returns by a join, so a node with very many neighbours is never one group in memory.
    """
    if larger_only:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        moved = both.where("b > a").join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "n")
        joined = edges.join(least, F.col("a") == F.col("n"))
        moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select(F.col("n").alias("a"), F.col("m").alias("b")))
    return moved.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of one ordered type -> (node, component), the least node that each node reaches.

    Alternates large-star and small-star (Kiveris et al., 2014), each round checkpointed to the
    shared folder; nodes without an edge to another node don't appear, nor do edges with a null end.
    Only two numbers a round come to the driver. Ends when every node points to its component's least.
    """
    e = edges.where("a is not null and b is not null and a <> b")
    e = durable(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        with tidy(e.sparkSession):
            row = e.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("decimal(20,0)")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if row == before or row[0] == 0:
            break
        before = row
        e = durable(_pull(_pull(e, True), False))
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
