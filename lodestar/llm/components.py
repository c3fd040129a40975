"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.session import settle


def downward(links: DataFrame) -> DataFrame:
    """Each link once, from the larger to the smaller end."""
    ends = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    return ends.filter("u <> v").distinct()


def large_star(links: DataFrame) -> DataFrame:
    """Every node's larger neighbours are linked to the least of the node and its neighbours."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("low"))
    return links.join(least, links.v == least.node).select("u", F.col("low").alias("v"))


def small_star(links: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are linked to the least of them."""
    least = links.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("low"))
    moved = links.join(least, links.u == least.node).filter("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return moved.unionByName(least.select(F.col("node").alias("u"), F.col("low").alias("v"))).distinct()


def is_forest_of_stars(links: DataFrame) -> bool:
    """Whether every node has one link down and nothing but leaves links to a centre."""
    ends = links.select(F.col("u").alias("node"), F.lit(1).alias("down")).unionByName(links.select(F.col("v").alias("node"), F.lit(0).alias("down")))
    nodes = ends.groupBy("node").agg(F.sum("down").alias("down"), F.min("down").alias("least"))
    return nodes.filter("down > 1 OR down = 1 AND least = 0").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b): the least node it can reach.

    Rounds repeat until only stars are left, about log2 of the longest chain; each is written
    to the shared folder. Minima are combined before they are shuffled, so no node's
    neighbours are gathered. No links give no rows; a link to itself says nothing.
    """
    links = settle(small_star(large_star(settle(downward(links), "links"))), "links")
    while not is_forest_of_stars(links):
        links = settle(small_star(large_star(links)), "links")
    centres = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(centres)
