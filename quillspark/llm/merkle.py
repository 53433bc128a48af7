"""Merkle fixity audit of two replicas of a WARC collection.

Records are hashed where they are read; only hashes move on. A leaf stands for
the records that start in one span of offsets of a volume, in offset order.
``FANOUT`` neighbouring ranges form a node, twice over, up to the root of the
volume; volumes are gathered by ``VOLUMES`` up to the root of the collection.
The audit compares the roots and goes down only below nodes that differ, with
one small join per level, until the differing records are reached.

Every node has a bounded number of children: a span of offsets, a fan-out, a
group of volumes. Levels are written to the checkpoint folder once because the
descent reads each of them twice.

Defined results: null volumes and offsets count as -1; records that share a
volume and an offset form one entry of sorted distinct hashes with their counts;
a null payload is an empty record; a volume or record that only one replica has
is ``missing`` or ``extra``; empty replicas agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillspark.plans.lineage import cut

SPAN = 64 << 10
FANOUT = 16
VOLUMES = 64
# Heights: 0 a span, 1 and 2 groups of them, 3 the volume, 4 and 5 groups of volumes, 6 the collection.
TOP = 6


def record(url: Column, body: Column) -> Column:
    """A response record as it stands in a WARC file."""
    return F.concat(F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Length: "),
                    F.octet_length(F.coalesce(body, F.lit(""))).cast("string"), F.lit("\r\n\r\n"), F.coalesce(body, F.lit("")), F.lit("\r\n\r\n"))


def digest(payload: Column) -> Column:
    return F.sha2(F.coalesce(payload, F.lit("")).cast("binary"), 256)


def entries(records: DataFrame, volume: str = "volume", start: str = "start", hashed: str = "hash") -> DataFrame:
    """One row per volume and offset with the hash of what starts there; records come with their ``digest``."""
    hashed = records.select(F.coalesce(F.col(volume).cast("long"), F.lit(-1)).alias("volume"), F.coalesce(F.col(start).cast("long"), F.lit(-1)).alias("start"),
                            F.col(hashed).alias("hash"))
    counted = hashed.groupBy("volume", "start", "hash").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("volume", "start").agg(
        F.array_join(F.sort_array(F.collect_list(F.concat_ws("x", "hash", F.col("n").cast("string")))), ",").alias("hash"))


def above(height: int, volume: Column, place: Column) -> tuple[Column, Column]:
    """The key of the parent of a node of the given height (-1: an entry)."""
    if height == -1:
        return volume, F.floor(place / SPAN)
    if height < 2:
        return volume, F.floor(place / FANOUT)
    if height == 2:
        return volume, F.lit(0).cast("long")
    return (F.floor(volume / VOLUMES) if height < TOP - 1 else F.lit(0).cast("long")), F.lit(0).cast("long")


def levels(found: DataFrame) -> list[DataFrame]:
    """Entries and the nodes of each height: ``volume``, ``place`` and ``hash``."""
    out = [cut(found.select("volume", F.col("start").alias("place"), "hash"))]
    for height in range(-1, TOP):
        up_volume, up_place = above(height, F.col("volume"), F.col("place"))
        child = F.struct("volume", "place", "hash")
        grouped = out[-1].select(up_volume.alias("v"), up_place.alias("p"), child.alias("child")).groupBy("v", "p").agg(
            F.sort_array(F.collect_list("child")).alias("children"))
        joined = F.array_join(F.transform("children", lambda c: F.concat_ws(":", c["volume"].cast("string"), c["place"].cast("string"), c["hash"])), ",")
        out.append(cut(grouped.select(F.col("v").alias("volume"), F.col("p").alias("place"), F.sha2(joined, 256).alias("hash"))))
    return out


def differing(left: DataFrame, right: DataFrame, height: int, parents: DataFrame | None) -> DataFrame:
    """Nodes of one height below differing parents whose hashes differ or that one side lacks."""

    def side(df: DataFrame, name: str) -> DataFrame:
        if parents is not None:
            up_volume, up_place = above(height, F.col("volume"), F.col("place"))
            up = parents.select(F.col("volume").alias("_v"), F.col("place").alias("_p"))
            df = df.join(up, (up_volume == F.col("_v")) & (up_place == F.col("_p")), "left_semi")
        return df.select("volume", "place", F.col("hash").alias(name))

    both = side(left, "left_hash").join(side(right, "right_hash"), ["volume", "place"], "full_outer")
    return cut(both.where(~F.col("left_hash").eqNullSafe(F.col("right_hash"))))


def audit(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Differing entries (``volume``, ``start``, ``state``) and the roots of every volume.

    Both inputs are results of ``entries``.
    """
    trees = levels(left), levels(right)
    found = None
    for height in range(TOP, -2, -1):
        found = differing(trees[0][height + 1], trees[1][height + 1], height, found)
    state = F.when(F.col("right_hash").isNull(), "missing").when(F.col("left_hash").isNull(), "extra").otherwise("changed")
    roots = [t[4].select("volume", F.col("hash").alias(n)) for t, n in zip(trees, ("left_root", "right_root"))]
    return found.select("volume", F.col("place").alias("start"), state.alias("state")), roots[0].join(roots[1], ["volume"], "full_outer")


def offsets(records: DataFrame, volume: str, order: list[str], size: str) -> DataFrame:
    """Adds ``start``: the bytes before each record of its volume, which is one file and bounded."""
    before = Window.partitionBy(volume).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return records.withColumn("start", F.coalesce(F.sum(size).over(before), F.lit(0)))
