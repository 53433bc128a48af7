"""Redundancy removal and context budgets over ranked hits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from quillspark.functions import text as tx
from quillspark.functions.similarity import mmr_order, ratio_at_least
from quillspark.functions.vectors import matrix_of, unit_rows


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of every key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def mmr(candidates: DataFrame, keys: list[str], limit: int = 10, lam: float = 0.7, ceiling: float = 0.85,
        relevance: str = "rrf_score", pool: int | None = None) -> DataFrame:
    """Diverse selection among the ranked hits of every group.

    ``candidates`` has ``rank``, ``embedding`` and the relevance column; a group
    is a top-k list (its first ``pool`` rows, if given) and becomes one row of
    arrays, so an Arrow batch decides many groups at once; returns the kept
    rows with ``mmr_rank``.
    """
    @F.arrow_udf("array<int>")
    def choose(scores: pa.Array, vectors: pa.Array) -> pa.Array:
        out = []
        for i in range(len(scores)):
            block = unit_rows(matrix_of(vectors[i].values))
            out.append(mmr_order(np.asarray(scores[i].values, dtype=np.float64), block, lam, ceiling, limit))
        return pa.array(out, pa.list_(pa.int32()))

    row = F.struct("rank", *[c for c in candidates.columns if c not in ("rank", *keys)])
    packed = (candidates if pool is None else candidates.where(F.col("rank") <= pool)).groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("_c"))
    picked = packed.withColumn("_o", choose(F.col(f"_c.{relevance}"), F.col("_c.embedding")))
    taken = picked.select(*keys, "_c", F.posexplode("_o").alias("_p", "_i"))
    rows = taken.select(*keys, F.element_at("_c", F.col("_i") + 1).alias("_r"), (F.col("_p") + 1).alias("mmr_rank"))
    names = ["rank", *[c for c in candidates.columns if c not in ("rank", "embedding", *keys)]]
    return rows.select(*keys, *[F.col("_r")[n].alias(n) for n in names], "mmr_rank")


def drop_near_copies(df: DataFrame, key: str, score: str, threshold: float = 0.9, keep: int = 20) -> DataFrame:
    """Greedy keep-first removal of near-equal texts, best score first.

    Exact copies of a key collapse first, limited to one a task before the
    shuffle. The rest streams through the sorted partition: a task remembers only the at
    most ``keep`` texts kept for the key it is reading, and stops comparing
    once they are full. Adds ``pool_rank``.
    """
    order = [F.desc(F.round(score, 8)), F.asc("scope"), F.asc("chunk_id")]
    w = Window.partitionBy(key, "_h").orderBy(*order)
    unique = (
        df.withColumn("_t", tx.strip(F.coalesce(F.col("text"), F.lit("")))).where("_t <> ''")
        .withColumn("_h", F.sha2("_t", 256))
        .withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_h")
    )
    ordered = unique.repartition(F.col(key)).sortWithinPartitions(F.asc(key), *order)
    schema = T.StructType([*df.schema.fields, T.StructField("pool_rank", T.IntegerType())])
    columns = schema.names

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, kept = object(), []
        for batch in batches:
            ranks = np.zeros(len(batch), dtype=np.int32)
            for i, (k, t) in enumerate(zip(batch[key].array, batch["_t"].array)):
                if k != current:
                    current, kept = k, []
                if len(kept) >= keep or any(ratio_at_least(t, other, threshold) for other in kept):
                    continue
                kept.append(t)
                ranks[i] = len(kept)
            batch["pool_rank"] = ranks
            yield batch.loc[ranks > 0, columns]

    return ordered.mapInPandas(stream, schema)


def spread_over_scopes(df: DataFrame, key: str, rank: str, total: int = 3, per_scope: int = 3) -> DataFrame:
    """At most ``per_scope`` hits a scope and ``total`` a query, back-filled to ``total``.

    The input is a bounded pool per key (after MMR). Adds ``spread_rank``.
    """
    in_scope = F.row_number().over(Window.partitionBy(key, "scope").orderBy(rank))
    order = Window.partitionBy(key).orderBy(F.col("_over"), rank)
    first = df.withColumn("_over", (in_scope > per_scope).cast("int"))
    ranked = first.withColumn("spread_rank", F.row_number().over(order))
    own = F.sum(1 - F.col("_over")).over(Window.partitionBy(key))
    # Back-filling happens only while fewer than three hits were taken.
    return ranked.withColumn("_own", own).where(
        (F.col("spread_rank") <= total) & ((F.col("_over") == 0) | (F.col("_own") < min(3, total)))
    ).drop("_over", "_own")


def context_budget(df: DataFrame, keys: list[str], max_tokens: int = 1500, score: str = "rrf_score",
                   prefer_child: bool = True, rank: str = "rank") -> DataFrame:
    """Keep the best hits that fit the token budget, cutting the first overflow.

    Text and table chunks come before parents. The first chunk past the budget
    is shortened if more than 100 tokens are left; later chunks are dropped.
    Adds ``context_rank``, ``truncated`` and ``used_tokens`` and rewrites ``text``.
    """
    order = [F.asc(F.when(F.col("type").isin("text", "table"), 0).otherwise(1)), F.desc(F.round(score, 8)), F.asc(rank)] \
        if prefer_child else [F.asc(rank)]
    w = Window.partitionBy(*keys).orderBy(*order)
    tokens = tx.model_tokens(F.col("text"))
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sized = df.withColumn("_n", tokens).withColumns({
        "context_rank": F.row_number().over(w), "_sum": F.sum("_n").over(upto)})
    sized = sized.withColumn("_left", F.lit(max_tokens) - (F.col("_sum") - F.col("_n")))
    overflow = (F.col("_sum") > max_tokens)
    first_overflow = overflow & (F.sum(F.when(overflow, 1).otherwise(0)).over(upto) == 1)
    cut_words = F.floor(F.col("_left") / 1.5).cast("int")
    cut = F.concat(F.array_join(F.slice(tx.words(F.col("text")), 1, F.greatest(cut_words, F.lit(1))), " "), F.lit("..."))
    marked = sized.withColumn("truncated", first_overflow & (F.col("_left") > 100)).where(
        ~overflow | F.col("truncated"))
    shortened = marked.withColumn("text", F.when(F.col("truncated"), cut).otherwise(F.col("text")))
    return shortened.withColumn("used_tokens", tx.model_tokens(F.col("text"))).drop("_n", "_sum", "_left")


def assemble_context(df: DataFrame, keys: list[str], rank: str = "context_rank", headers: bool = False) -> DataFrame:
    """Join a group's chunk texts in rank order, blank line between them."""
    piece = F.col("text")
    if headers:
        piece = F.concat(F.lit("[doc="), F.col("scope").cast("string"), F.lit(" chunk="),
                         F.col("chunk_id").cast("string"), F.lit("]\n"), F.col("text"))
    rows = F.array_sort(F.collect_list(F.struct(F.col(rank).alias("_r"), piece.alias("_t"))))
    return df.groupBy(*keys).agg(F.array_join(F.transform(rows, lambda r: r["_t"]), "\n\n").alias("context"))
