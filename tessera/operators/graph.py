"""Connected components of an edge table."""

from __future__ import annotations

from collections.abc import Callable
from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.storage import stored


#: Rows that a task writes, where the tables have many.
ROWS = 200_000


def connected_components(edges: DataFrame, keep: Callable[[DataFrame], DataFrame] = stored) -> DataFrame:
    """node, component (its smallest reachable node) for the nodes of edges(a, b); nulls link nothing.

    Each round takes the smallest label among a node's neighbours, then follows labels once (pointer jumping), so
    that long chains end in few rounds. keep() cuts the lineage. Sizes per node are never gathered: hot nodes
    are joined by sort-merge joins of plain scans, which adaptive execution can split, and reduced by partial sums.
    A round's tables are written in as many files as their rows need, one for each core at least.
    """
    pairs = edges.select("a", "b").dropna().filter("a <> b")
    both = keep(pairs.union(pairs.select("b", "a")).distinct())
    files = max(edges.sparkSession.sparkContext.defaultParallelism, ceil(both.count() / ROWS))
    labels = keep(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")).coalesce(files))
    while True:
        told = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("component").alias("told"))
        lower = keep(labels.join(told, labels.node == told.a).select("node", F.least("component", "told").alias("component"), F.col("component").alias("was")).coalesce(files))
        over = lower.select(F.col("node").alias("over"), F.col("component").alias("next"))
        jumped = keep(lower.join(over, lower.component == over.over).select("node", F.col("next").alias("component"), (F.col("next") != F.col("was")).alias("moved")).coalesce(files))
        labels = jumped.select("node", "component")
        if not jumped.filter("moved").limit(1).count():
            return labels
