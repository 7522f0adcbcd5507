"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.sources.scratch import settle


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step: every node hands its least neighbour (itself included) to the larger neighbours
    (``large``) or to itself and the smaller ones."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    met = both.join(least, "u")
    if large:
        out = met.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = met.select(F.explode(F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
    return out.filter("a > b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(v, c): each node that has an edge, with the least node of its component.

    ``edges`` has columns a and b of one orderable type. Alternating large and small stars: the edge count
    never grows, a round halves the depth, and each round is cut off by a written table. Least neighbours are
    aggregates that combine before the shuffle; a hub's own edges meet one row of the other side, which Spark
    splits when skewed.
    """
    now = settle(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while True:
        now = settle(_star(_star(now, large=True), large=False))
        new = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % 1_000_003), F.sum(F.xxhash64("b", "a") % 1_000_003)).first()
        if new == mark:
            break
        mark = new
    return now.select(F.col("a").alias("v"), F.col("b").alias("c")).union(now.select(F.col("b").alias("v"), F.col("b").alias("c")).distinct())
