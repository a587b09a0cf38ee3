"""Connected components as alternating star joins on written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from mentionmill.llm.tables import Table

#: Edges to a file of the tables between rounds, at least.
EDGES_PER_FILE = 20_000


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node hangs its larger neighbours on its least one."""
    both = _both_ways(edges.filter("u <> v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node hangs itself and its smaller neighbours on its least one."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    hung = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def _written(edges: DataFrame, files: int | None = None) -> tuple[Table, tuple]:
    """The edges as a table, and their number and sum of hashes, seen in passing."""
    seen = Observation()
    table = Table(edges.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")), files)
    return table, (seen.get["n"] or 0, seen.get["h"])


def components(edges: DataFrame) -> Table:
    """(node, component) for every node of an edge of ``edges`` (columns u, v of one type); component: its least node.

    Each round writes a table and drops the one before it; the rounds are as many as the logarithm of the longest
    chain. Hot nodes are pre-aggregated (least neighbour) and joined, never gathered. Edges to null and loops are
    passed over.
    """
    now, found = _written(edges.select("u", "v"))
    before = None
    while True:
        after, found = _written(_small_star(_large_star(now.df)), 1 + found[0] // EDGES_PER_FILE)
        now.drop()
        now = after
        if found == before or not found[0]:
            break
        before = found
    out = now.df.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = out.select(F.col("component").alias("node"), "component").distinct()
    result = Table(out.union(roots), 1 + found[0] // EDGES_PER_FILE)
    now.drop()
    return result
