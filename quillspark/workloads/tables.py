"""Views of the driver's tables in the shapes the operators expect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Give every core a share of an input that has fewer splits than cores.

    Large inputs have more splits than cores and pass through untouched.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def chunks_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as the chunks of their source."""
    return spread(read(spark, sf_dir, "documents"), "doc_id").select(
        F.col("source").alias("scope"), F.col("doc_id").alias("chunk_id"), "text", "lang")


def chunks_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as the chunks of one corpus."""
    return spread(read(spark, sf_dir, "documents"), "doc_id").select(
        F.lit("all").alias("scope"), F.col("doc_id").alias("chunk_id"), "text", "lang")


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


CHUNKS_BY_SOURCE_SQL = "chunks as (select source as scope, doc_id as chunk_id, text from documents)"
CHUNKS_WHOLE_SQL = "chunks as (select 'all' as scope, doc_id as chunk_id, text from documents)"
QUERIES_SQL = "queries as (select item_id as query_id, text as query from benchmark)"
