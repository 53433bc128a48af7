"""Writers of chunks, indexes, hierarchies and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quillspark.operators import lexical
from quillspark.sources.readers import BUCKETS, bucket_of

DYNAMIC = "dynamic"


def write_documents(df: DataFrame, path: str, buckets: int = BUCKETS, files_per_bucket: int = 1) -> None:
    """Replace the buckets present in ``df``; other buckets stay.

    Rows spread over ``files_per_bucket`` tasks a bucket by a hash of the whole
    row, so a hot document does not make one writer slow. The frame has to hold
    every document of the buckets it writes.
    """
    placed = df.withColumn("bucket", bucket_of(F.col("doc_id"), buckets))
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(files_per_bucket))
    placed.repartition(F.col("bucket"), salt).write.mode("overwrite").option(
        "partitionOverwriteMode", DYNAMIC).partitionBy("bucket").parquet(path)


def upsert_documents(df: DataFrame, stored: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Replace the documents in ``df`` and keep the others of their buckets.

    ``stored`` is the present table; the result goes to ``path``, another
    folder, because a table cannot be read and replaced in one job.
    """
    kept = stored.drop("bucket").join(df.select("doc_id").distinct(), "doc_id", "left_anti")
    write_documents(kept.unionByName(df, allowMissingColumns=True), path, buckets)


def purge_documents(stored: DataFrame, doomed: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    write_documents(stored.drop("bucket").join(doomed.select("doc_id"), "doc_id", "left_anti"), path, buckets)


def write_keyword_index(chunks: DataFrame, path: str) -> None:
    """Postings, term statistics and chunk lengths of ``chunks(scope, chunk_id, text)``.

    Statistics are taken from the written postings, so texts are tokenised
    twice only: once for the postings and once for the lengths.
    """
    spark = chunks.sparkSession
    lexical.postings(chunks).write.mode("overwrite").parquet(f"{path}/postings")
    lexical.chunk_stats(chunks).write.mode("overwrite").parquet(f"{path}/chunk_stats")
    lexical.term_stats(spark.read.parquet(f"{path}/postings")).write.mode("overwrite").parquet(f"{path}/term_stats")


def search_index(queries: DataFrame, index: tuple[DataFrame, DataFrame, DataFrame], k: int = 10) -> DataFrame:
    """BM25 over a stored index; only the postings of the asked terms leave the scan."""
    posts, dfs, lengths = index
    terms = lexical.query_terms(queries)
    asked = terms.select("term").distinct()
    scored = lexical.bm25_scores(terms, posts.join(asked, "term", "left_semi"), dfs.join(asked, "term", "left_semi"),
                                 lexical.scope_stats(lengths))
    order = [F.desc(F.round("score", lexical.SCORE_PLACES)), F.asc("chunk_id")]
    return lexical.top_k(scored, ["query_id", "scope"], order, k)


def append_report(report: DataFrame, path: str) -> None:
    report.write.mode("append").option("mergeSchema", "true").parquet(path)


def export_report(report: DataFrame, path: str, kind: str = "csv") -> None:
    writer = report.write.mode("overwrite")
    writer.option("header", "true").csv(path) if kind == "csv" else writer.json(path)
