"""Connected components of a link table by alternating stars; nothing but small rows is shuffled."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from basketwise.llm.store import kept


def components(links: DataFrame) -> DataFrame:
    """(a, b) of any orderable type -> (node, component): the smallest node reachable. Nodes without link are absent.

    Each round hands every node's larger neighbours to its smallest one (large star), then its smaller ones and
    itself (small star), until nothing changes; the number of rounds grows with the logarithm of the longest chain. Nulls and links of
    a node with itself are ignored, repeated links count once.
    """
    edges = links.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges = kept(edges.distinct(), "links")
    state = _state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = kept(large.filter(F.col("u") != F.col("v")), "large")  # as many rows as edges at most
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        met = large.join(small, "u").select("u", "v", "m")
        pairs = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(met.select("u", F.col("m").alias("v")))
        edges = kept(pairs.filter(F.col("u") != F.col("v")).distinct(), "small")
        before, state = state, _state(edges)
        if state == before:
            break
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _state(edges: DataFrame) -> tuple:
    """Number of edges and a sum over them; both stay as they are once all components are stars."""
    code = F.xxhash64("u", "v").cast("decimal(20,0)")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(code)).first())
