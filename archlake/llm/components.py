"""Connected components of a table of edges, by alternating stars: joins and pre-aggregated minima only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archlake.llm.store import cut


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on edges (u, v): a vertex's larger (or smaller) neighbours and itself get its smallest neighbour."""
    if large:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = both.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m")).select("w", F.least("m", "w").alias("m"))
    met = both.join(low, F.col("u") == F.col("w"))
    if large:
        out = met.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select(F.col("w").alias("u"), F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of an edge (u, v). Nodes are bigints, not null.

    Takes a number of rounds that grows with the logarithm of the longest path; each round's edges are a table in the
    shared folder. Loops and repeated edges do no harm; no edges give no rows.
    """
    now = cut(edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    while True:
        row = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if not row["n"] or (row["n"], row["s"]) == mark:
            break
        mark = (row["n"], row["s"])
        now = cut(_stars(_stars(now, True), False))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
