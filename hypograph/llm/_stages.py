"""Helpers shared by the operators: hidden row columns, small measured sides, connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.sizing import written


def same_rows(df: DataFrame) -> Column:
    """A number that tells whether two tables of longs hold the same rows (order-free)."""
    return F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of links (a, b): one row (node, component) per node, component the least node.

    Alternating large-star and small-star steps: every node hands its neighbours to the least of them. All
    steps are minima per node (combined before the shuffle) and joins that adaptive execution can split, so
    a node with a third of all links does not gather them in one task. Each round is written to the shared
    folder, so no lineage grows and a lost executor costs one round at most. An empty table gives none.
    """
    current = written(
        edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        "links",
    )
    state = None
    while True:
        seen = current.agg(F.count("*"), same_rows(current)).first()
        if seen[0] == 0 or seen == state:
            break
        state = seen
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").unionByName(low.select("u", F.col("m").alias("v")))
        current = written(small.distinct(), "links")
    roots = current.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots).groupBy("node").agg(F.min("component").alias("component"))
