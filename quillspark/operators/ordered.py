"""Ordered operators that stay parallel inside one hot key.

A plain window sends every row of a key to one task. Where a key may hold a
large share of the table, the helpers here cut it into slices by a column that
never decreases along the wanted order (an hour of a timestamp, a block of turn
numbers), work inside the slices, and carry one small summary row per slice
across. The summary window sees slices, not rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def join_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on keys that may be null: null meets null. The keys come from the left side."""
    other = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    return left.join(other, same, how).drop(*[f"_right_{k}" for k in keys])


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """Best ``k`` rows per key; Spark limits each task's rows before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def last_before(df: DataFrame, keys: Sequence[str], order: Sequence[str], slice_by: Column,
                values: dict[str, Column], when: Column | None = None) -> DataFrame:
    """Values of the latest earlier row of the key (for which ``when`` holds).

    Adds one column per entry of ``values``; null where there is no such row.
    """
    names = list(values)
    picked = F.struct(*[values[n].alias(n) for n in names])
    held = picked if when is None else F.when(when, picked)
    base = df.withColumn("_slice", slice_by).withColumn("_held", held)
    inner = Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    near = base.withColumn("_near", F.last("_held", ignorenulls=True).over(inner))
    summary = base.groupBy(*keys, "_slice").agg(
        F.max_by("_held", F.when(F.col("_held").isNotNull(), F.struct(*order))).alias("_tail")
    )
    outer = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = summary.select(*keys, "_slice", F.last("_tail", ignorenulls=True).over(outer).alias("_carry"))
    joined = join_keys(near, carried, [*keys, "_slice"], "left")
    value = F.coalesce("_near", "_carry")
    return joined.select(*df.columns, *[value[n].alias(n) for n in names])


def order_statistics(df: DataFrame, keys: Sequence[str], value: str, slice_by: Column,
                     positions: dict[str, Column]) -> DataFrame:
    """Exact values at sorted positions, without collecting a key's values.

    ``positions`` maps an output name to a zero-based index given as an
    expression of the column ``n`` (rows of the key). Equal values are counted
    before they are sorted, slices are totalled before values are.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"))
    counts = counts.withColumn("_slice", slice_by)
    slices = counts.groupBy(*keys, "_slice").agg(F.sum("_c").alias("_s"))
    by_slice = Window.partitionBy(*keys).orderBy("_slice")
    slices = slices.withColumn("n", F.sum("_s").over(Window.partitionBy(*keys))).withColumn(
        "_before", F.sum("_s").over(by_slice.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_s")
    )
    wanted = slices.select(
        *keys, "_slice", "n", "_before",
        *[((F.col("_before") <= p) & (p < F.col("_before") + F.col("_s"))).alias(f"_in_{o}")
          for o, p in positions.items()],
        *[p.alias(f"_at_{o}") for o, p in positions.items()],
    )
    any_in = F.lit(False)
    for o in positions:
        any_in = any_in | F.col(f"_in_{o}")
    inside = join_keys(counts, wanted.where(any_in), [*keys, "_slice"])
    by_value = Window.partitionBy(*keys, "_slice").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = inside.withColumn("_hi", F.col("_before") + F.sum("_c").over(by_value))
    upto = upto.withColumn("_lo", F.col("_hi") - F.col("_c"))
    return upto.groupBy(*keys).agg(
        F.max("n").alias("n"),
        *[F.max(F.when((F.col("_lo") <= F.col(f"_at_{o}")) & (F.col(f"_at_{o}") < F.col("_hi")), F.col(value))).alias(o)
          for o in positions],
    )


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], slice_by: Column, sums: dict[str, Column],
            totals: dict[str, Column] | None = None) -> DataFrame:
    """Running sums per key, current row included, and whole-key sums.

    Only a slice is ever sorted in one task; the sums of earlier slices arrive
    by a join with the per-slice totals.
    """
    totals = totals or {}
    values = {**sums, **totals}
    base = df.withColumn("_slice", slice_by).withColumns({f"_v_{n}": v for n, v in values.items()})
    inner = Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = base.withColumns({f"_r_{n}": F.sum(f"_v_{n}").over(inner) for n in sums})
    per_slice = base.groupBy(*keys, "_slice").agg(*[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in values])
    whole = Window.partitionBy(*keys)
    earlier = whole.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = per_slice.select(
        *keys, "_slice",
        *[F.coalesce(F.sum(f"_s_{n}").over(earlier), F.lit(0)).alias(f"_c_{n}") for n in sums],
        *[F.sum(f"_s_{n}").over(whole).alias(n) for n in totals])
    joined = join_keys(near, carried, [*keys, "_slice"])
    return joined.select(*df.columns, *[(F.col(f"_c_{n}") + F.col(f"_r_{n}")).alias(n) for n in sums], *totals)
