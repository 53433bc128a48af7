"""Best hits of blocks of scores, for searches that scan Arrow batches.

Scores of a block are a matrix of rows and queries; only the best ``k`` rows of
every scope leave it, and of later blocks of a task only those that reach the
``k``-th best score seen before.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

# Scores are compared after rounding, so equal texts tie whatever order their
# terms were summed in, and the id decides.
SCORE_PLACES = 8
# Kept k-th best scores (8 bytes each) of one task; scopes beyond are ranked block by block.
FLOOR_CELLS = 4_000_000


def best_cells(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column indices of the k best rows of each column, ties by row."""
    m = scores.shape[0]
    if m <= k:
        return np.nonzero(np.ones_like(scores, dtype=bool))
    edge = np.partition(scores, m - k, axis=0)[m - k]
    above = scores > edge
    level = scores == edge
    room = k - above.sum(axis=0)
    return np.nonzero(above | (level & (np.cumsum(level, axis=0) <= room)))


class Floors:
    """Per scope the k-th best score of every query in the blocks seen so far: what is below it is in no answer."""

    def __init__(self, queries: int, k: int):
        self.k, self.queries, self.held = k, queries, {}

    def cells(self, scope, scores: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
        """The best cells of one scope's rows (by id) for the queries from ``start`` on."""
        stop = start + scores.shape[1]
        floor = self.held.get(scope)
        if floor is None and (len(self.held) + 1) * self.queries <= FLOOR_CELLS:
            floor = self.held[scope] = np.full(self.queries, -np.inf)
        row, col = best_cells(scores, self.k)
        if floor is None:
            return row, col
        kept = scores[row, col] >= floor[start:stop][col]
        if scores.shape[0] >= self.k:
            worst = np.full(stop - start, np.inf)
            np.minimum.at(worst, col, scores[row, col])
            floor[start:stop] = np.maximum(floor[start:stop], worst)
        return row[kept], col[kept]


def scoped_cells(rounded: np.ndarray, codes: np.ndarray, names: list, floors: Floors, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Best cells of every scope of a block; ``codes`` are the rows' places in ``names``."""
    rows, cols = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for code in np.unique(codes):
        members = np.nonzero(codes == code)[0]
        r, c = floors.cells(None if code < 0 else names[code], rounded[members], start)
        rows.append(members[r])
        cols.append(c)
    return np.concatenate(rows), np.concatenate(cols)


def scope_codes(scope: pa.Array) -> tuple[np.ndarray, list]:
    """Rows' scopes as places in a list, -1 for null."""
    coded = scope.dictionary_encode()
    return np.asarray(coded.indices.fill_null(-1)), coded.dictionary.to_pylist()
