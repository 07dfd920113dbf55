"""Connected components of a graph given by its links, by alternating stars.

Each round hangs every node's larger neighbours, then its smaller ones, under
the smallest node in reach; the number of rounds follows the logarithm of the
longest path. All steps are joins and grouped minimums. Every round and every
grouped minimum is written to the shared folder: lineage ends there, and a hub
meets its minimum in a join of two exchanges, which Spark can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import stored


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)"))).first())


def connected(links: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its smallest node) for every node of ``links``.

    ``links`` has two columns of one orderable type. Links with a null end
    and of a node with itself say nothing; a link may be repeated and given
    in either direction.
    """
    a, b = (F.col(c) for c in links.columns)
    edges = stored(links.where(a != b).select(F.greatest(a, b).alias("high"), F.least(a, b).alias("low")).distinct(), "edges")
    state = _state(edges)
    while True:
        both = edges.select(F.col("high").alias("node"), F.col("low").alias("other")).unionAll(edges.select("low", "high"))
        least = stored(both.groupBy("node").agg(F.min("other").alias("least")).select(
            "node", F.least("node", "least").alias("least")), "least")
        large = stored(both.where(F.col("other") > F.col("node")).join(least, "node").select(
            F.col("other").alias("high"), F.col("least").alias("low")).distinct(), "edges")
        least = stored(large.groupBy("high").agg(F.min("low").alias("least")), "least")
        small = large.join(least, "high")
        edges = stored(small.select(F.col("low").alias("high"), F.col("least").alias("low")).where("high != low")
                       .unionAll(least.select("high", F.col("least").alias("low"))).distinct(), "edges")
        before, state = state, _state(edges)
        if before == state:
            break
    return edges.select(F.col("high").alias("node"), F.col("low").alias("component")).unionAll(
        edges.select("low", "low").distinct())
