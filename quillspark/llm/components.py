"""Connected components of a graph given as rows of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quillspark.plans.lineage import cut


def _towards_least(pairs: DataFrame) -> DataFrame:
    """Each (node, other) with the least of the node and all its others.

    The least is a partial aggregate joined back, so a node with very many
    links is neither gathered nor kept in one task.
    """
    least = pairs.groupBy("node").agg(F.min("other").alias("_least")).select(F.col("node").alias("_of"), "_least")
    joined = pairs.join(least, F.col("node") == F.col("_of"))
    return joined.select("node", "other", F.least("node", "_least").alias("least"))


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """``node`` and ``label``, the least node of its component, for every node with a link.

    Alternating large and small stars: links are moved to the least neighbour
    until every component is a star. Each round is written to the checkpoint
    folder; the driver sees a count and a checksum.
    """
    edges = links.select(F.col(left).alias("node"), F.col(right).alias("other")).where("node <> other")
    edges = cut(edges.select(F.greatest("node", "other").alias("node"), F.least("node", "other").alias("other")).distinct())
    mark = None
    while True:
        found = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("node", "other").cast("decimal(38,0)"))).first()
        if tuple(found) == mark:
            return edges.select("node", F.col("other").alias("label")).union(
                edges.select(F.col("other").alias("node"), F.col("other").alias("label")).distinct())
        mark = tuple(found)
        both = edges.union(edges.select(F.col("other").alias("node"), F.col("node").alias("other")))
        large = _towards_least(both).where("other > node").select(F.col("other").alias("node"), F.col("least").alias("other")).distinct()
        small = _towards_least(large)
        small = small.select(F.col("other").alias("node"), F.col("least").alias("other")).union(small.select("node", F.col("least").alias("other")))
        edges = cut(small.where("node <> other").distinct())
