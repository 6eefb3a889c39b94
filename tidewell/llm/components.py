"""Connected components of a table of links, as rounds of joins over written tables.

Every round hangs the greater neighbours of a node, then the smaller ones, on the
least of them (large-star and small-star), so long chains and stars both take
few rounds.  The driver sees only two numbers a round.

Defined cases: a link of a node with itself, a repeated one and one that is turned
round add nothing; a node without a link to another isn't in the result; nodes are integers, links with a null
are dropped; no links give an empty table; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import Workspace


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """``edges``: (u, v) with u > v, no repeats."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m")).select("k", F.least("k", "m").alias("m"))
    joined = both.join(least, F.col("u") == F.col("k"))
    if large:  # greater neighbours of u
        found = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        found = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("k").alias("u"), F.col("m").alias("v")))
    return found.filter("u > v").distinct()


def components(links: DataFrame, work: Workspace, name: str) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b: integers): root is the least node that links reach."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct()
    edges, before, i = work.write(edges, f"{name}-0"), None, 0
    while True:
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before, i = now, i + 1
        edges = work.write(_star(work.write(_star(edges, True), f"{name}-large-{i}"), False), f"{name}-{i}")
        work.drop(f"{name}-large-{i}")
        work.drop(f"{name}-{i - 1}")
    # Now every node hangs on its root.
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
