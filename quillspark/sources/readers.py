"""Readers of documents, datasets and stored indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillspark import schemas
from quillspark.operators import catalog

BUCKETS = 256


def bucket_of(doc_id, buckets: int = BUCKETS):
    """Storage bucket of a document, the partition column of its tables."""
    return F.pmod(F.xxhash64(doc_id.cast("string")), F.lit(buckets)).cast("int")


def eval_dataset(spark: SparkSession, path: str) -> DataFrame:
    """JSON array of evaluation items; both spellings of the question field."""
    raw = spark.read.schema(schemas.EVAL_DATASET).json(path, multiLine=True)
    return raw.withColumn("query", F.coalesce("query", "question")).drop("question")


def uploads(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Files under ``path`` as accepted rows with their hash, and rejected rows with a reason.

    Name and size decide before the content column is read for the rejected.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    judged = files.withColumn("reason", catalog.upload_reason(F.col("path"), F.col("length")))
    accepted = judged.where("reason is null").select("path", "length", F.md5("content").alias("file_hash"))
    return accepted, judged.where("reason is not null").select("path", "length", "reason")


def document_rows(spark: SparkSession, path: str, doc_ids: DataFrame | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Rows of a bucketed table, of the wanted documents if given.

    The join carries the partition column, so only the buckets of the wanted
    documents are read.
    """
    table = spark.read.parquet(path)
    if doc_ids is None:
        return table
    wanted = doc_ids.select("doc_id", bucket_of(F.col("doc_id"), buckets).alias("bucket")).distinct()
    return table.join(wanted, ["bucket", "doc_id"], "left_semi")


def keyword_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stored postings, term statistics and chunk lengths."""
    return tuple(spark.read.parquet(f"{path}/{name}") for name in ("postings", "term_stats", "chunk_stats"))


def latest_report(spark: SparkSession, path: str) -> DataFrame:
    from quillspark.operators.evaluation import latest

    return latest(spark.read.parquet(path), "doc_id", "ts")
