"""Exact dense search.

Vectors are compared block by block inside Arrow batches and only the best ``k``
of a batch leave it, so neither the pairs nor their scores are ever rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quillspark.functions.vectors import embedded, matrix_of, unit_rows
from quillspark.operators.blocks import SCORE_PLACES, Floors, scope_codes, scoped_cells
from quillspark.operators.ordered import top_k

# Up to this many cells (8 bytes each) the query matrix is sent to every task.
BROADCAST_CELLS = 4_000_000
# Scores (8 bytes each) that a worker holds at once; queries go in slices of so many.
SCORE_CELLS = 8_000_000
BLOCK_QUERIES = 4096
BLOCK_ROWS = 50_000


def embed_texts(df: DataFrame, text: str = "text", embedder=None) -> DataFrame:
    return df.withColumn("embedding", embedded(F.col(text), embedder))


def _block_hits(queries: np.ndarray, query_ids: pa.Array, scope: pa.Array, ids: pa.Array,
                vectors: np.ndarray, k: int, floors: Floors | None = None) -> Iterator[pa.RecordBatch]:
    """Best ``k`` rows of every scope for every query, a slice of queries at a time."""
    order, units = np.asarray(pa.compute.sort_indices(ids)), unit_rows(vectors)
    floors = floors or Floors(len(query_ids), k)
    codes, names = scope_codes(scope)
    step = max(1, SCORE_CELLS // max(1, len(order)))
    for start in range(0, len(query_ids), step):
        scores = np.round(units[order] @ queries[start:start + step].T, SCORE_PLACES)
        row, col = scoped_cells(scores, codes[order], names, floors, start)
        picked = pa.array(order[row])
        yield pa.RecordBatch.from_arrays(
            [query_ids.slice(start, step).take(pa.array(col)), scope.take(picked), ids.take(picked), pa.array(scores[row, col])],
            names=["query_id", "scope", "chunk_id", "score"])


def _flat(column):
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _hit_schema(queries: DataFrame, corpus: DataFrame) -> str:
    q, s, c = (df.schema[n].dataType.simpleString() for df, n in
               ((queries, "query_id"), (corpus, "scope"), (corpus, "chunk_id")))
    return f"query_id {q}, scope {s}, chunk_id {c}, score double"


def dense_top(queries: DataFrame, corpus: DataFrame, k: int = 5, dims: int | None = None) -> DataFrame:
    """Best ``k`` vectors of every scope for every query by cosine similarity.

    ``queries(query_id, embedding)``, ``corpus(scope, chunk_id, embedding)``.
    A query set of checked size is broadcast and the corpus is scanned in
    place; a larger one goes through ``_block_join``, which bounds both sides
    of every group.
    """
    # A null vector is near nothing; the scan drops those of the corpus, as a filter would compute the vectors twice.
    wanted = queries.select("query_id", "embedding").where("embedding is not null")
    corpus = corpus.select("scope", "chunk_id", "embedding")
    first = wanted.select(F.size("embedding")).head()
    width = dims or max(1, first[0] if first else 1)
    limit = BROADCAST_CELLS // width
    head = wanted.limit(limit + 1).toArrow()
    if head.num_rows > limit:
        hits = _block_join(wanted, corpus, k)
    else:
        hits = _broadcast_scan(head, corpus, k, _hit_schema(wanted, corpus))
    order = [F.desc("score"), F.asc("chunk_id")]
    return top_k(hits, ["query_id", "scope"], order, k)


def _broadcast_scan(head: pa.Table, corpus: DataFrame, k: int, schema: str) -> DataFrame:
    ids = _flat(head.column("query_id"))
    matrix = unit_rows(matrix_of(head.column("embedding")))
    shared = corpus.sparkSession.sparkContext.broadcast((ids, matrix))

    def scan(batches):
        query_ids, block = shared.value
        floors = Floors(len(query_ids), k)
        for batch in batches:
            batch = batch.filter(batch.column("embedding").is_valid())
            if batch.num_rows and len(query_ids):
                yield from _block_hits(block, query_ids, batch.column("scope"), batch.column("chunk_id"),
                                       matrix_of(batch.column("embedding")), k, floors)

    return corpus.mapInArrow(scan, schema)


def _block_join(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """Two-way blocked product for query sets too large to broadcast.

    Each side is hashed into blocks and copied once per block of the other, so
    every group holds one bounded block of each; a hot scope is spread over the
    corpus blocks by the id hash.
    """
    corpus = corpus.where("embedding is not null")
    n_q, n_c = queries.count(), corpus.count()
    qb, cb = max(1, -(-n_q // BLOCK_QUERIES)), max(1, -(-n_c // BLOCK_ROWS))
    left = queries.select("query_id", F.col("embedding").alias("q_embedding"),
                          F.pmod(F.xxhash64("query_id"), F.lit(qb)).alias("_qb"),
                          F.explode(F.sequence(F.lit(0), F.lit(cb - 1))).alias("_cb"))
    right = corpus.select("scope", "chunk_id", "embedding",
                          F.pmod(F.xxhash64("chunk_id"), F.lit(cb)).cast("int").alias("_cb"),
                          F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(qb - 1).cast("bigint"))).alias("_qb"))
    schema = _hit_schema(queries, corpus)
    names = ["query_id", "scope", "chunk_id", "score"]

    def multiply(q: pa.Table, c: pa.Table) -> pa.Table:
        if not q.num_rows or not c.num_rows:
            return pa.table({
                "query_id": pa.array([], q.schema.field("query_id").type),
                "scope": pa.array([], c.schema.field("scope").type),
                "chunk_id": pa.array([], c.schema.field("chunk_id").type),
                "score": pa.array([], pa.float64()),
            })
        hits = _block_hits(unit_rows(matrix_of(q.column("q_embedding"))), _flat(q.column("query_id")),
                           _flat(c.column("scope")), _flat(c.column("chunk_id")),
                           matrix_of(c.column("embedding")), k)
        return pa.Table.from_batches(list(hits)).select(names)

    return left.groupBy("_qb", "_cb").cogroup(right.groupBy("_qb", "_cb")).applyInArrow(multiply, schema)
