"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tollgate.sources.artifacts import materialize

#: Up to so many pairs the smallest neighbours are sent to all tasks, some 4 MB, and ``FEW`` tasks hold the pairs.
SENT, FEW = 100_000, 8


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.sum(F.xxhash64("high", "low").cast("decimal(20,0)"))).first()
    return tuple(row)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component``: the smallest node that each linked node can reach. Nodes without a link are not listed.

    Rounds of two steps until nothing changes: every node's larger neighbours move to its smallest neighbour, then its
    smaller ones do. The number of rounds grows with the logarithm of the number of nodes, each is a few shuffles of
    pairs of ids, and each ends in a table on shared storage. A node with very many links takes part through a minimum
    that combines on the map side and a join whose larger partitions Spark splits. Few pairs are joined without a shuffle and
    kept in few parts, whatever the number of shuffle partitions: the driver holds something for each stage and task.
    """
    pairs = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("high"), F.least(a, b).alias("low")).distinct()
    pairs = materialize(pairs, "links")
    before = _state(pairs)
    while before[0]:
        few = before[0] <= SENT
        sent = lambda minima: F.broadcast(minima.coalesce(FEW)) if few else minima
        ends = F.array(F.struct(F.col("high").alias("u"), F.col("low").alias("v")), F.struct(F.col("low").alias("u"), F.col("high").alias("v")))
        least = pairs.select(F.inline(ends)).groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = pairs.join(sent(least), F.col("low") == F.col("u")).select("high", F.col("m").alias("low"))
        lowest = large.groupBy("high").agg(F.min("low").alias("m"))
        # Each larger node has a row that holds its smallest neighbour; that one keeps the node, the others keep the neighbour.
        node = F.when(F.col("low") == F.col("m"), F.col("high")).otherwise(F.col("low"))
        moved = large.join(sent(lowest), "high").select(node.alias("high"), F.col("m").alias("low")).distinct()
        pairs = materialize(moved.coalesce(FEW) if few else moved, "links")
        now = _state(pairs)
        if now == before:
            break
        before = now
    ends = pairs.select(F.col("high").alias("node"), F.col("low").alias("component"))
    roots = pairs.select(F.col("low").alias("node"), F.col("low").alias("component")).distinct()
    return ends.unionByName(roots.coalesce(FEW) if before[0] <= SENT else roots)
