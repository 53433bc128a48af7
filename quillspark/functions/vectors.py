"""Vector expressions and the default text embedder."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

from quillspark.functions import text as tx
from quillspark.functions.terms import index_terms

DIMS = 64


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, 0 when either side has no length."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


def _bucket_and_sign(term: str, dims: int) -> tuple[int, float]:
    digest = hashlib.md5(term.encode("utf-8")).digest()
    return digest[0] % dims, 1.0 if digest[1] < 128 else -1.0


def hashed_matrix(tokens: pa.ListArray, dims: int) -> np.ndarray:
    """Signed hashed term counts, one L2-normalised row per token list.

    Works on the flattened Arrow buffers: each distinct term of the batch is
    hashed once, whatever its frequency.
    """
    n = len(tokens)
    flat = tokens.flatten().dictionary_encode()
    if isinstance(flat, pa.ChunkedArray):
        flat = flat.combine_chunks()
    hashed = [_bucket_and_sign(t, dims) for t in flat.dictionary.to_pylist()]
    buckets = np.array([b for b, _ in hashed], dtype=np.int64)
    signs = np.array([s for _, s in hashed], dtype=np.float64)
    lengths = np.asarray(tokens.value_lengths().fill_null(0), dtype=np.int64)
    rows = np.repeat(np.arange(n), lengths)
    if len(rows) == 0:
        return np.zeros((n, dims))
    codes = np.asarray(flat.indices, dtype=np.int64)
    cells = rows * dims + buckets[codes]
    matrix = np.bincount(cells, weights=signs[codes], minlength=n * dims).reshape(n, dims)
    lengths2 = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    return np.divide(matrix, lengths2, out=np.zeros_like(matrix), where=lengths2 > 0)


def to_list_array(matrix: np.ndarray) -> pa.ListArray:
    n, d = matrix.shape
    offsets = np.arange(0, (n + 1) * d, d, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(matrix).reshape(-1)))


def hashing_embedder(dims: int = DIMS):
    """The default embedder: an Arrow UDF from index terms, or from the text that has them, to a unit vector.

    A trained model plugs in here: any function from a text or term column to
    an ``array<double>`` column can be handed to the dense operators instead.
    """

    @F.arrow_udf("array<double>")
    def embed(tokens: pa.Array) -> pa.Array:
        return to_list_array(hashed_matrix(index_terms(tokens) if pa.types.is_string(tokens.type) or pa.types.is_large_string(tokens.type) else tokens, dims))

    return embed


def embedded(text: Column, embedder=None) -> Column:
    """Vector of a text: by the default embedder, or by one that takes index terms."""
    return embedder(tx.tokenize(text)) if embedder else hashing_embedder()(text)


def matrix_of(column: pa.Array) -> np.ndarray:
    """Rows of equal-length lists as a 2-D float64 array; a null list is a row of zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n, valid = len(column), column.is_valid().to_numpy(zero_copy_only=False)
    if not valid.any():
        return np.zeros((n, 0))
    held = np.asarray(column.drop_null().flatten(), dtype=np.float64).reshape(int(valid.sum()), -1)
    if valid.all():
        return held
    out = np.zeros((n, held.shape[1]))
    out[valid] = held
    return out


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    lengths = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    return np.divide(matrix, lengths, out=np.zeros_like(matrix), where=lengths > 0)
