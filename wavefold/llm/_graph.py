"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _store


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of links (u, v); root is the smallest node reachable.

    Nodes are longs. Links may be repeated, in either direction, or from a node
    to itself. A step sends every neighbour of a node to the node's smallest
    neighbour, as a grouped minimum and a join, so that no node's neighbours
    are ever gathered in one place. Ends after some O(log^2) steps.
    """
    nodes = links.select(F.col("u").alias("node")).union(links.select("v"))
    edges = _store.save(_tidy(links), "edges")
    before = None
    for _ in range(rounds):
        star = _small(_large(edges))
        now = _store.save(_tidy(star), "edges")
        mark = now.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if before == mark:
            break
        before, edges = mark, now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return nodes.distinct().join(now.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def _tidy(edges: DataFrame) -> DataFrame:
    return edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _large(edges: DataFrame) -> DataFrame:
    """Larger neighbours of a node are linked to its smallest neighbour, itself included."""
    both = edges.union(edges.select("v", "u"))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    """Smaller neighbours of a node, and the node, are linked to the smallest of them."""
    down = _tidy(edges)
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    return down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", "m"))
