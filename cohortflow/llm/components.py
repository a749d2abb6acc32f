"""Connected components by alternating large-star and small-star steps on an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortflow.session import materialize


def _state(edges: DataFrame) -> tuple:
    hashed = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    return tuple(edges.agg(F.count("*"), F.coalesce(hashed, F.lit(0))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for all ends of ``edges`` (u, v); the component is the smallest node that is reachable.

    A step sends each neighbour of a node to the smallest one, larger neighbours first, then smaller ones, until
    nothing changes; the edge count never grows, and the number of steps is logarithmic in practice. Each round is a
    written table. The smallest neighbour is a hash aggregate joined back, so a hub is never one task's group.
    """
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = materialize(edges, "edges")
    state = _state(edges)
    while state[0]:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        edges = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # The smallest nodes lose nothing: their larger neighbours point to them.
        edges = materialize(edges.where("u <> v").distinct(), "large-star")
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialize(moved.union(least.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        before, state = state, _state(edges)
        if state == before:
            break
    ends = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return ends.union(edges.select("v", "v")).distinct()
