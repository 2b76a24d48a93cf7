"""Connected components of an edge table by alternating large-star and small-star rounds.

Each round is a grouped minimum and a join; edges stay in Spark and are cut from their lineage by checkpoint().
A hub with many edges is one key of a plain join, which adaptive execution may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_ROUNDS = 60


def _star(edges: DataFrame) -> DataFrame:
    """Large star: every node's larger neighbours point to its smallest neighbour or itself."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
    return (both.filter("v > u").join(low, F.col("u") == F.col("w"))
            .select(F.col("v").alias("u"), F.least("u", "m").alias("v")))


def _contract(edges: DataFrame) -> DataFrame:
    """Small star: a node and its smaller neighbours point to the smallest of them."""
    low = edges.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
    joined = edges.join(low, F.col("u") == F.col("w"))
    return joined.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                                           F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.*")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (bigint columns a, b); component is the smallest node reachable.

    Loops and repeated edges do no harm; rows with a null end are ignored.
    """
    e = (edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()).checkpoint()
    before = None
    for _ in range(MAX_ROUNDS):
        e = _contract(_star(e).distinct()).filter("u <> v").distinct().checkpoint()
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("v").alias("u"), "v").distinct()
    return e.unionByName(roots).select(F.col("u").alias("node"), F.col("v").alias("component"))
