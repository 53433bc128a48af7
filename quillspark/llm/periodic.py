"""Maximal periodic runs of words, by suffix trees and Lyndon roots.

A run is a stretch of words with smallest period ``q`` and at least ``MIN_WORDS``
words and ``MIN_TURNS`` periods that no neighbouring word extends. Its first ``q``
words are the original, the others repetition.

In a stretch, Ukkonen's algorithm builds the suffix trees of the words and of their
reversal. Euler tours with a table of range minima give the lowest common ancestor
of two leaves, hence the longest common extension of two places to the right or to
the left, in constant time. The order of the leaves, once with words ascending and
once descending, gives the next smaller suffix and with it the longest Lyndon word
at every place. Each such word is a candidate root: it is extended in both
directions by its length, and every run shows up from one of its Lyndon roots.

Trees are built where runs can lie only. Inside a run each word but the first ``q``
equals one at most ``q`` words before, so a run of period up to ``Q`` lies in an
unbroken stretch of words that have an equal one within ``Q``, and the ``Q`` words
before it. Such stretches are found for all powers of two ``Q`` at once for a batch
of texts, and overlapping ones are merged; no run is lost or cut.

Defined results: words are separated by blanks and the controls 9 to 13; a null or
empty text has no words, no runs and an empty collapsed text; equal rows give equal
results; other columns may have any name. Memory is about 1.5 KB per word of a
repetitive stretch and under 100 bytes per other word, one batch of texts at a time.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from quillspark.llm.batches import map_texts

MIN_WORDS = 24
MIN_TURNS = 3
RUN = StructType([StructField(n, LongType(), False) for n in ("start", "length", "period")])
_RUNS = pa.list_(pa.struct([pa.field(n, pa.int64(), False) for n in ("start", "length", "period")]))


class SuffixTree:
    """Suffix tree of a list of numbers from 0 on; the end counts as -1, the least."""

    def __init__(self, words: list[int]):
        self.words = [*words, -1]
        self._build()
        self._tour()

    def _build(self) -> None:
        words, size = self.words, len(self.words)
        start, end, link, child, suffix = [0], [0], [0], [{}], [-1]

        def node(a: int, b: int, of: int) -> int:
            start.append(a)
            end.append(b)
            link.append(0)
            child.append({} if of < 0 else None)
            suffix.append(of)
            return len(start) - 1

        at, edge, length, pending = 0, 0, 0, 0
        for i, word in enumerate(words):
            pending += 1
            last = 0
            while pending:
                if not length:
                    edge = i
                below = child[at].get(words[edge])
                if below is None:
                    child[at][words[edge]] = node(i, size, i - pending + 1)
                    if last:
                        link[last] = at
                    last = at
                else:
                    span = end[below] - start[below]
                    if length >= span and child[below] is not None:
                        at, edge, length = below, edge + span, length - span
                        continue
                    if words[start[below] + length] == word:
                        length += 1
                        if last:
                            link[last] = at
                        break
                    split = node(start[below], start[below] + length, -1)
                    child[at][words[edge]] = split
                    child[split][word] = node(i, size, i - pending + 1)
                    start[below] += length
                    child[split][words[start[below]]] = below
                    if last:
                        link[last] = split
                    last = split
                pending -= 1
                if at:
                    at = link[at]
                elif length:
                    length -= 1
                    edge = i - pending + 1
        self.start, self.end, self.child, self.suffix = start, end, child, suffix

    def _tour(self) -> None:
        """Euler tour with words ascending: string depths, the first visit of each leaf, and a table of range minima."""
        start, end, child, suffix = self.start, self.end, self.child, self.suffix
        depths, first = [], [0] * len(self.words)
        stack = [(0, 0, None)]
        while stack:
            node, depth, rest = stack.pop()
            depths.append(depth)
            if child[node] is None:
                first[suffix[node]] = len(depths) - 1
                continue
            rest = iter(sorted(child[node])) if rest is None else rest
            word = next(rest, None)
            if word is not None:
                below = child[node][word]
                stack.append((node, depth, rest))
                stack.append((below, depth + end[below] - start[below], None))
        self.first = np.array(first, np.int64)
        level = np.array(depths, np.int32)
        self.table = [level]
        width = 1
        while 2 * width <= len(depths):
            level = np.minimum(level[:-width], level[width:])
            self.table.append(level)
            width *= 2

    def ranks(self, descending: bool) -> list[int]:
        """Rank of each suffix, with words ascending or descending; the end comes first either way."""
        rank, count, stack = [0] * len(self.words), 0, [0]
        while stack:
            node = stack.pop()
            below = self.child[node]
            if below is None:
                rank[self.suffix[node]] = count
                count += 1
                continue
            order = sorted((w for w in below if w >= 0), reverse=not descending)
            stack.extend(below[w] for w in order)
            if -1 in below:
                stack.append(below[-1])
        return rank

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of the suffixes at different places ``a`` and ``b``."""
        x, y = self.first[a], self.first[b]
        low, high = np.minimum(x, y), np.maximum(x, y)
        found, level = np.zeros(len(a), np.int64), np.frexp(high - low + 1)[1] - 1
        for k in np.unique(level).tolist():
            here = level == k
            table = self.table[k]
            found[here] = np.minimum(table[low[here]], table[high[here] - (1 << k) + 1])
        return found


def next_smaller(rank: list[int]) -> np.ndarray:
    """For each place but the last, the next place with a smaller rank; the last rank is the least."""
    after, stack = [0] * (len(rank) - 1), []
    for i, r in enumerate(rank):
        while stack and rank[stack[-1]] > r:
            after[stack.pop()] = i
        stack.append(i)
    return np.array(after, np.int64)


def runs_of(words: list[int]) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of a list of numbers from 0 on, by start and period."""
    n = len(words)
    if n < MIN_WORDS:
        return []
    ahead, behind = SuffixTree(words), SuffixTree(words[::-1])
    places, found = np.arange(n), []
    for descending in (False, True):
        period = next_smaller(ahead.ranks(descending)) - places
        right = ahead.extension(places, places + period)
        # The reversal's suffix n - i ends just before place i.
        left = np.where(places > 0, behind.extension(n - places, n - places - period), 0)
        length = left + period + right
        good = length >= np.maximum(MIN_WORDS, MIN_TURNS * period)
        found.append(np.stack([places - left, length, period], 1)[good])
    rows = np.unique(np.concatenate(found), axis=0)
    return sorted(map(tuple, rows.tolist()), key=lambda r: (r[0], r[2]))


def stretches(back: np.ndarray, begin: np.ndarray) -> list[tuple[int, int]]:
    """Merged ranges of words that runs can lie in.

    ``back`` is the distance to the last equal word of the text, beyond the table for none; ``begin`` the place where the word's text begins.
    """
    found, reach, longest = [], 1, len(back)
    while reach < longest:
        near = np.concatenate(([False], back <= reach, [False]))
        edges = np.flatnonzero(near[1:] != near[:-1])
        a, b = edges[::2], edges[1::2]
        long = b - a >= max(MIN_WORDS - reach, (MIN_TURNS - 1) * (reach // 2 + 1))
        a, b = a[long], b[long]
        found.append(np.stack([np.maximum(a - reach, begin[a] if len(a) else a), b], 1))
        reach *= 2
    out: list[tuple[int, int]] = []
    for a, b in sorted(map(tuple, np.concatenate(found).tolist())) if found else []:
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def collapse(texts: list[str | None]) -> tuple[list[int], list[list[tuple[int, int, int]]], list[str]]:
    """Word counts, runs and collapsed texts."""
    split = [(t or "").encode("utf-8").split() for t in texts]
    counts = [len(words) for words in split]
    total = sum(counts)
    back, offset, offsets = [], 0, []
    for words in split:
        offsets.append(offset)
        seen: dict[bytes, int] = {}
        last = seen.get
        for i, word in enumerate(words):
            back.append(i - last(word, i - total - 1))
            seen[word] = i
        offset += len(words)
    begin = np.repeat(np.array(offsets, np.int64), counts)
    runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    kept = list(split)
    which = np.repeat(np.arange(len(texts)), counts)
    for a, b in stretches(np.array(back, np.int64), begin):
        text = int(which[a])
        shift = a - offsets[text]
        words = split[text][shift:shift + b - a]
        numbers = {word: i for i, word in enumerate(dict.fromkeys(words))}
        runs[text] += [(start + shift, length, period) for start, length, period in runs_of([numbers[w] for w in words])]
    for text, found in enumerate(runs):
        if found:
            gone = np.zeros(counts[text] + 1, np.int64)
            for start, length, period in found:
                gone[start + period] += 1
                gone[start + length] -= 1
            stays = (np.cumsum(gone)[:-1] == 0).tolist()
            kept[text] = [w for w, s in zip(split[text], stays) if s]
    return counts, runs, [b" ".join(words).decode("utf-8") for words in kept]


def find(docs: DataFrame, keep: Sequence[str], text: str = "text", names: tuple[str, str, str] = ("n_words", "runs", "collapsed")) -> DataFrame:
    """The kept columns, the number of words, the runs by start and period, and the text without repetitions, words joined by blanks."""

    def work(texts):
        counts, runs, kept = collapse(texts)
        listed = [[dict(zip(RUN.names, r)) for r in found] for found in runs]
        return pa.array(counts, pa.int64()), pa.array(listed, _RUNS), pa.array(kept, pa.string())

    fields = list(zip(names, (LongType(), ArrayType(RUN, False), StringType())))
    return map_texts(docs, keep, lambda: work, fields, text)
