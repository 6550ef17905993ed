"""Connected components of a link table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(links: DataFrame, tasks: int | None = None) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b long): root is the smallest node it reaches.

    Each round links every node to the smallest of its neighbours, first for the larger and then
    for the smaller ones, until every node has one link, to its root; rounds grow with the logarithm
    of the nodes. Links stay distributed; each round is written to the shared folder. Links of a node
    with itself and repeated links do nothing; no links give no rows. Given the result for some links
    and further links, it goes on from there: only what the further ones connect takes rounds.
    At most ``tasks`` tasks write a frame, if given; links that are few for the shuffle partitions then take few.
    """
    few = (lambda df: df.coalesce(tasks)) if tasks else (lambda df: df)
    high, low = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    edges = stored(few(links.where("a <> b").select(high, low).distinct()), "links")
    while not _are_stars(edges):
        both = edges.union(edges.select("v", "u"))
        lowest = stored(few(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))), "lowest")
        large = both.join(lowest, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(few(large), "large")  # at most one for each edge; repeats do nothing
        lowest = stored(few(large.groupBy("u").agg(F.min("v").alias("m"))), "lowest")
        small = large.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(few(small.union(lowest).distinct()), "small")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        edges.select(F.col("v"), F.col("v")).distinct()
    )


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node of ``edges`` (u > v, distinct) has one smaller neighbour and no larger one, or only larger ones."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up")).union(edges.select("v", F.lit(0)))
    nodes = ends.groupBy("x").agg(F.sum("up").alias("up"), F.count("*").alias("all"))
    return nodes.where("up > 0 and all > 1").agg(F.count("*")).first()[0] == 0
