"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable from each node of edges (a, b).

    Each round links every neighbour of a node to the smallest node near it, first
    the larger neighbours, then the smaller ones, until the edges stop changing:
    all point straight at their component's smallest node. Each round's edges are
    written to the shared folder; only a count and a checksum reach the driver.
    Nulls and loops are left out; an empty table gives an empty result.
    """
    now = edges.select("a", "b").where("a is not null and b is not null and a != b")
    now = table(now.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    for _ in range(most):
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        wide = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        wide = table(wide.where("u != v").distinct(), "star")
        least = wide.groupBy("u").agg(F.min("v").alias("m"))
        near = wide.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = table(near.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        roots.select("node", F.col("node").alias("component"))
    )
