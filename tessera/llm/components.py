"""Connected components by alternating large-star and small-star rounds over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.hash("u", "v").cast("long")).alias("h"), F.expr("bit_xor(xxhash64(u, v))").alias("x")).first()
    return row.n, row.h, row.x


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """One round. The minima are written out so that the join back gets exchanges of its own, which AQE may split at a hub."""
    both = edges if small else edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = written(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "star")
    met = both.join(least, "u")
    if small:
        out = met.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    else:
        out = met.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the bigint pairs (u, v); component is the smallest node reachable.

    Nodes without an edge to another node do not appear. Repeated pairs, loops and both directions
    of a pair are allowed; pairs with a null end are ignored; an empty table gives an empty one.
    """
    edges = written(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "edges"
    )
    before = _digest(edges)
    while before[0]:
        edges = written(_star(written(_star(edges, small=False), "edges"), small=True), "edges")
        after = _digest(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
