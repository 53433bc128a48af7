"""Sequence similarity for short candidate lists, as Arrow UDFs."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F


def ratio_at_least(a: str, b: str, floor: float) -> float:
    """The matching ratio, or 0 once an upper bound shows it is below ``floor``."""
    matcher = SequenceMatcher(None, a, b)
    if matcher.real_quick_ratio() < floor or matcher.quick_ratio() < floor:
        return 0.0
    found = matcher.ratio()
    return found if found >= floor else 0.0


#: Product of two lengths up to which blocks are looked up as substrings, which for short texts is several times faster than ``SequenceMatcher``.
SHORT = 400


def matched(a: str, b: str) -> int:
    """Characters in the matching blocks of ``SequenceMatcher`` for texts below its junk length: the longest block, first in ``a``, then in ``b``, and so on at its sides."""
    for k in range(min(len(a), len(b)), 0, -1):
        for i in range(len(a) - k + 1):
            j = b.find(a[i:i + k])
            if j >= 0:
                return k + (matched(a[:i], b[:j]) if i and j else 0) + (matched(a[i + k:], b[j + k:]) if i + k < len(a) and j + k < len(b) else 0)
    return 0


def sequence_ratio(floor: float = 0.0):
    """Arrow UDF: ratio of two string columns, 0 below ``floor``."""

    @F.arrow_udf("double")
    def ratio(a: pa.Array, b: pa.Array) -> pa.Array:
        firsts, seconds = a.to_pylist(), b.to_pylist()
        out = np.zeros(len(firsts))
        matcher = SequenceMatcher()
        # The matcher indexes its second text, so pairs are taken by it.
        for i in sorted(range(len(seconds)), key=lambda j: seconds[j] or ""):
            n, m = len(firsts[i] or ""), len(seconds[i] or "")
            if 0 < n * m <= SHORT and m < 200:
                found = 2.0 * matched(firsts[i], seconds[i]) / (n + m)
                out[i] = found if found >= floor else 0.0
                continue
            if matcher.b != (seconds[i] or ""):
                matcher.set_seq2(seconds[i] or "")
            matcher.set_seq1(firsts[i] or "")
            if matcher.real_quick_ratio() >= floor and matcher.quick_ratio() >= floor:
                found = matcher.ratio()
                out[i] = found if found >= floor else 0.0
        return pa.array(out)

    return ratio


def mmr_order(relevance: np.ndarray, vectors: np.ndarray, lam: float, ceiling: float, limit: int) -> list[int]:
    """Greedy maximal-marginal-relevance order of candidates given best first.

    A candidate closer than ``ceiling`` to a chosen one is out for good.
    """
    n = len(relevance)
    if n <= 1:
        return list(range(n))
    sims = vectors @ vectors.T
    chosen = [0]
    closest = np.maximum(sims[0], 0.0)
    open_ = np.ones(n, dtype=bool)
    open_[0] = False
    while len(chosen) < limit:
        open_ &= closest <= ceiling
        if not open_.any():
            break
        gain = np.where(open_, np.round(lam * relevance - (1 - lam) * closest, 12), -np.inf)
        best = int(np.argmax(gain))
        chosen.append(best)
        open_[best] = False
        closest = np.maximum(closest, sims[best])
    return chosen


def earlier_duplicates(vectors: np.ndarray, threshold: float) -> list[bool]:
    """Whether each row is closer than ``threshold`` to an earlier one."""
    if not len(vectors):
        return []
    near = np.round(vectors @ vectors.T, 9) > threshold
    return np.any(np.tril(near, -1), axis=1).tolist()
