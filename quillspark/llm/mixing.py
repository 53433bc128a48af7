"""Mixing sources to target weights with a Pfair schedule.

Documents of a source are taken in hash order and cut into blocks of about
``block_chars`` characters. Block ``i`` of a source of weight ``w`` is released
at slot ``floor(i / w)`` and due at ``ceil((i + 1) / w)``; each slot goes to the
released block with the earliest deadline. Deadlines are always met because the
weights add up to one, so before every slot a source is less than one block away
from its share. A source that runs out leaves its slots empty; none is dropped,
cut short or repeated.

Weights are whole units of ``1 / slots``, so the schedule repeats after ``slots``
slots: one period is computed and every block finds its slot from its number.
The driver holds the period and one row per source, whatever the corpus holds.
Running sums work in hash slices of a source, so a source with a third of all
rows is spread over the slices.

Defined results: a null source is a source of its own; a null text has no
characters and stays in the block where it stands; rows that agree in id and
text are interchangeable; a document longer than a block takes one slot and the
slots of the blocks that it spans stay empty; an empty table stays empty.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window, functions as F

BLOCK_CHARS = 1 << 20
SLOTS = 1000
SLICES = 1024
EXPONENT = 0.7


def tempered_units(sizes: dict[str | None, int], exponent: float = EXPONENT, slots: int = SLOTS) -> dict[str | None, int]:
    """Whole units per source in proportion to size ** exponent; see ``units``."""
    return units({name: size ** exponent for name, size in sizes.items()}, slots)


def units(weights: dict[str | None, float], slots: int = SLOTS) -> dict[str | None, int]:
    """Whole units that add up to ``slots``, by largest remainder; every source has one at least.

    With more sources than half the slots the period grows to twice their number.
    """
    slots = max(slots, 2 * len(weights))
    names = sorted(weights, key=lambda n: (n is not None, n or ""))
    total = sum(weights[n] for n in names)
    spare = slots - len(names)
    exact = {n: spare * weights[n] / total if total else spare / len(names) for n in names}
    out = {n: 1 + int(exact[n]) for n in names}
    for n in sorted(names, key=lambda n: int(exact[n]) - exact[n])[:slots - sum(out.values())]:
        out[n] += 1
    return out


def schedule(shares: dict[str | None, int]) -> list[str | None]:
    """The source of each slot of one period, earliest deadline first."""
    period = sum(shares.values())
    names = sorted(shares, key=lambda n: (n is not None, n or ""))
    coming: list[list[tuple[int, int, int]]] = [[] for _ in range(period)]

    def release(place: int, block: int) -> None:
        share = shares[names[place]]
        if block < share:
            coming[block * period // share].append((-(-(block + 1) * period // share), place, block))

    for place in range(len(names)):
        release(place, 0)
    ready: list[tuple[int, int, int]] = []
    out: list[str | None] = []
    for slot in range(period):
        for job in coming[slot]:
            heapq.heappush(ready, job)
        _, place, block = heapq.heappop(ready)
        out.append(names[place])
        following = (block + 1) * period // shares[names[place]]
        if following <= slot and block + 1 < shares[names[place]]:
            heapq.heappush(ready, (-(-(block + 2) * period // shares[names[place]]), place, block + 1))
        else:
            release(place, block + 1)
    return out


def sizes(docs: DataFrame, source: str = "source", text: str = "text") -> dict[str | None, int]:
    """Characters per source, one row each."""
    rows = docs.groupBy(F.col(source).alias("_source")).agg(F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("_chars")).collect()
    return {r["_source"]: r["_chars"] for r in rows}


def place(docs: DataFrame, shares: dict[str | None, int], chars: str = "chars", source: str = "source", doc_id: str = "doc_id",
          block_chars: int = BLOCK_CHARS, slices: int = SLICES) -> DataFrame:
    """Rows with their block, its release, deadline and slot, and the order inside the block.

    The result has the columns ``row`` (the input row), ``block``, ``release``,
    ``deadline``, ``slot`` and ``turn``; ``chars`` names a column of lengths.
    """
    rows = docs.select(F.struct("*").alias("row"), F.col(source).alias("_source"), F.col(doc_id).alias("_id"),
                       F.coalesce(F.col(chars), F.lit(0)).alias("_chars"), F.xxhash64(doc_id).alias("turn"))
    rows = rows.withColumn("_slice", F.pmod(F.shiftrightunsigned("turn", 40), F.lit(slices)))
    inside = Window.partitionBy("_source", "_slice").orderBy("turn", "_id", "_chars").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_before", F.coalesce(F.sum("_chars").over(inside), F.lit(0)))
    totals = docs.select(F.col(source).alias("_source"), F.pmod(F.shiftrightunsigned(F.xxhash64(doc_id), 40), F.lit(slices)).alias("_slice"),
                         F.coalesce(F.col(chars), F.lit(0)).alias("_chars")).groupBy("_source", "_slice").agg(F.sum("_chars").alias("_sum"))
    earlier = Window.partitionBy("_source").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(F.col("_source").alias("_of"), F.col("_slice").alias("_part"), F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start"))
    rows = rows.join(starts, F.col("_source").eqNullSafe(F.col("_of")) & (F.col("_slice") == F.col("_part")))
    rows = rows.withColumn("block", F.floor((F.col("_start") + F.col("_before")) / block_chars))

    spark, period, seen, slots = docs.sparkSession, sum(shares.values()), {}, []
    for slot, name in enumerate(schedule(shares)):
        slots.append((name, seen.setdefault(name, 0), slot, shares[name]))
        seen[name] += 1
    table = spark.createDataFrame(slots, "_name string, _turn long, _slot long, _units long")
    # One period of the schedule: a fixed number of rows.
    rows = rows.join(F.broadcast(table.where("_turn = 0").select(F.col("_name").alias("_known"), F.col("_units").alias("_share"))),
                     F.col("_source").eqNullSafe(F.col("_known")))
    rows = rows.withColumn("_turn_of", F.col("block") % F.col("_share"))
    rows = rows.join(F.broadcast(table), F.col("_source").eqNullSafe(F.col("_name")) & (F.col("_turn_of") == F.col("_turn")))
    at = F.floor(F.col("block") / F.col("_share")) * period
    return rows.select("row", "block", F.expr(f"block * {period} div _share").alias("release"),
                       F.expr(f"((block + 1) * {period} + _share - 1) div _share").alias("deadline"),
                       (at + F.col("_slot")).alias("slot"), "turn")


def mix(docs: DataFrame, shares: dict[str | None, int], source: str = "source", text: str = "text", doc_id: str = "doc_id",
        block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents in the order of the schedule: range partitions of slots, sorted inside."""
    rows = docs.select(F.struct("*").alias("doc"), F.col(source).alias("_s"), F.col(doc_id).alias("_d"), F.length(text).alias("_c"))
    placed = place(rows, shares, "_c", "_s", "_d", block_chars)
    ordered = placed.repartitionByRange("slot", "turn").sortWithinPartitions("slot", "turn", "row._d")
    return ordered.select("row.doc.*")
