"""Connected components of a table of links, by alternating large-star and small-star steps.

Each step points nodes at the least neighbour they know; the links stay a table throughout,
one row for each node in the end, and are written to the shared folder after each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import written


def _star(directed: DataFrame, own: bool) -> DataFrame:
    """From rows (u, v): every v, and with ``own`` u itself, points at the least of u and its v."""
    least = directed.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return directed.join(least, "u"), least


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component): the least node that each node of a link reaches, itself included.

    Nodes are numbers. Links to oneself and repeated links are fine; without links there are no
    rows. A hub's links are joined to one row of its own, so adaptive execution may split them.
    """
    own = links.select(F.col(a).alias("a"), F.col(b).alias("b"))
    nodes = own.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    now = written(own.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    for _ in range(rounds):
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        joined, _ = _star(both, False)
        large = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        joined, least = _star(down, True)
        small = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        now = written(small.where("a <> b").distinct(), "links")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == before:
            break
        before = seen
    else:
        raise RuntimeError("the components did not settle")
    return nodes.join(now, F.col("node") == F.col("a"), "left").select("node", F.coalesce("b", "node").alias("component"))
