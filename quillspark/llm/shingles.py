"""Sets of word shingles of many texts at once."""

from __future__ import annotations

import numpy as np

from quillspark.llm.rolling import Rolling, blocks, mixed

WIDTH = 4
_WORD = Rolling(3)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def sets(texts: list[str | None], width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text.

    A-Z count as a-z; words are runs without blanks and controls 9 to 13. A text
    with fewer words has its whole sequence as one shingle, without words none.
    """
    parts = [(t or "").encode("utf-8").lower() for t in texts]
    return [found for a, b in blocks([len(p) for p in parts]) for found in _sets(parts[a:b], width)]


def _sets(parts: list[bytes], width: int) -> list[np.ndarray]:
    data = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    space = _SPACE[data]
    starts = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    ends = np.flatnonzero(space & np.concatenate(([False], ~space[:-1])))
    words = mixed(_WORD.spans(_WORD.sums(data), starts, ends) + (ends - starts).astype(np.uint64))
    limits = np.searchsorted(starts, np.cumsum([len(p) + 1 for p in parts]))
    joined = np.zeros(0, np.uint64)
    if len(words) >= width:
        n = len(words) - width + 1
        joined = words[:n].copy()
        for i in range(1, width):
            joined = joined * _STEP + words[i:n + i]
        joined = mixed(joined)
    out, first = [], 0
    for last in limits.tolist():
        if last - first >= width:
            out.append(np.unique(joined[first:last - width + 1]))
        elif last > first:
            whole = np.uint64(last - first)
            with np.errstate(over="ignore"):
                for w in words[first:last]:
                    whole = whole * _STEP + w
            out.append(mixed(np.array([whole])))
        else:
            out.append(np.zeros(0, np.uint64))
        first = last
    return out
