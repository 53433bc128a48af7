"""Chunk quality checks."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from quillspark.functions import text as tx
from quillspark.functions.similarity import earlier_duplicates
from quillspark.functions.vectors import hashing_embedder, matrix_of
from quillspark.operators.ordered import top_k


def near_duplicates(chunks: DataFrame, threshold: float = 0.85, compared: int | None = None, chars: int | None = None,
                    embedder=None) -> DataFrame:
    """``doc_id, chunk_id`` of chunks close to an earlier one of their document.

    ``chunks(doc_id, position, chunk_id, text)``. The chunks of a document
    become one row of vectors, smaller than its text, so an Arrow batch handles
    many documents. ``compared`` and ``chars`` limit the chunks of a document
    and the characters of a chunk.
    """
    embed = embedder or hashing_embedder()
    head = chunks.withColumn("_rank", F.col("position")) if compared is None else top_k(
        chunks, ["doc_id"], [F.asc("position")], compared, "_rank")
    head = head.where(tx.word_count(F.col("text")) >= 20)
    vectors = head.withColumn("_v", embed(tx.tokenize(tx.head(F.col("text"), chars))))
    packed = vectors.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("_rank", "chunk_id", "_v"))).alias("_c"))

    @F.arrow_udf("array<boolean>")
    def flags(groups: pa.Array) -> pa.Array:
        return pa.array([earlier_duplicates(matrix_of(g.values), threshold) for g in groups], pa.list_(pa.bool_()))

    flagged = packed.select("doc_id", F.explode(F.arrays_zip(
        F.col("_c.chunk_id").alias("chunk_id"), flags(F.col("_c._v")).alias("dup"))).alias("_z"))
    return flagged.where("_z.dup").select("doc_id", F.col("_z.chunk_id").alias("chunk_id"))


def checks(chunks: DataFrame, threshold: float = 0.85, embedder=None) -> DataFrame:
    """The five checks of every text chunk; valid when at least three hold."""
    text = F.col("text")
    dups = near_duplicates(chunks, threshold, embedder=embedder).withColumn("_dup", F.lit(True))
    ending = F.regexp_like(tx.strip(text), F.lit("[.!?]$"))
    n = tx.word_count(text)
    rows = chunks.join(dups, ["doc_id", "chunk_id"], "left").withColumns({
        "long_enough": n >= 50,
        "ends_sentence": ending,
        "answerable": tx.has_complete_idea(text),
        "complete_end": (n > 0) & ~F.coalesce(tx.last_word(text), F.lit("")).isin(tx.QUALITY_DANGLING_WORDS),
        "distinct": F.col("_dup").isNull(),
    })
    names = ["long_enough", "ends_sentence", "answerable", "complete_end", "distinct"]
    passed = sum((F.col(n).cast("int") for n in names[1:]), F.col(names[0]).cast("int"))
    return rows.withColumn("passed", passed).withColumn("valid", F.col("passed") >= 3).drop("_dup")


def report(checked: DataFrame, keys: list[str]) -> DataFrame:
    """Counts and percentages of the checks per group."""
    total = F.greatest(F.count("*"), F.lit(1))

    def share(n: str):
        return F.round(F.count_if(n) / total * 100, 1)

    return checked.groupBy(*keys).agg(
        F.count("*").alias("total_text_chunks"), F.count_if("valid").alias("valid_chunks"),
        F.round(F.count_if("valid") / total, 4).alias("quality_score"),
        F.count_if(~F.col("distinct")).alias("duplicate_chunks"),
        F.round(F.count_if(~F.col("distinct")) / total * 100, 1).alias("duplicate_pct"),
        share("long_enough").alias("word_count_pct"), share("ends_sentence").alias("sentence_end_pct"),
        share("answerable").alias("answerable_pct"), share("complete_end").alias("no_trailing_conj_pct"))
