"""Packing tokenised documents into sequences by bin completion.

Documents longer than a sequence are cut into full pieces, the first one shorter where
the length asks for it; all others stay whole. Which lengths share a sequence depends
on the number of pieces of each length only, so the search works on at most
``capacity`` counts, whatever the number of documents: it takes the longest length
left, enumerates undominated fillings of the rest of its sequence, the fullest first,
and uses a filling as often as the counts allow. A branch ends when its waste passes
what an improvement of the best solution so far may waste; the first best solution is
that of best fit with decreasing lengths, and the search stops at the lower bound or
after ``NODES`` steps. Pieces then take places by their rank among those of their length.

Ranks need no sort: a task counts the pieces of each length as it writes them, and a
window over (length, task) gives where a task's ranks begin. So a length that a third
of all pieces have is spread like any other. The driver sees one count per length.

Ids are those of the ``tokenizers`` library without special tokens (their strings are
ordinary text). Texts of characters below U+0250 get the same ids from tiktoken, by
the ranks of the same vocabulary, which takes a quarter of the time.

Defined results: a null text is an empty one and gives one piece with the end id alone;
equal rows are packed as separate documents; an empty table gives no pieces. Columns
that are not kept may have any name, kept ones any but those of the new columns.
"""

from __future__ import annotations

import base64
import re
import zlib
from array import array
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType
from tokenizers import Tokenizer

from quillspark.llm.batches import fresh, map_texts
from quillspark.plans.lineage import stored

CAPACITY = 1024
NODES = 4000
BRANCHES = 4
NARROW = 0x250

Pattern = tuple[int, ...]


def encoder(vocabulary: str, ranks: str, pattern: str) -> Callable[[str], bytes]:
    """A function from a text to its ids as unsigned 32-bit integers; lives in one task."""
    tokenizer = Tokenizer.from_file(vocabulary)
    tokenizer.encode_special_tokens = True
    with open(ranks, "rb") as lines:
        table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    plain = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={}).encode_ordinary
    beyond = re.compile(f"[^\0-{chr(NARROW - 1)}]").search

    def encode(text: str) -> bytes:
        ids = tokenizer.encode(text, add_special_tokens=False).ids if beyond(text) else plain(text)
        return array("I", ids).tobytes()

    return encode


def bounds(length: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """Pieces (start, end) of a document: whole if it fits, else full pieces after a first one with the rest."""
    if length <= capacity:
        return [(0, length)]
    cuts = [*([0] if length % capacity else []), *range(length % capacity, length + 1, capacity)]
    return list(zip(cuts, cuts[1:]))


# -- the search over counts ---------------------------------------------------------------

def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """No packing has fewer sequences: lengths over half a sequence stand apart, and the rest fills what they leave."""
    order = sorted(counts)
    best = -(-sum(n * c for n, c in counts.items()) // capacity)
    for small in [0, *(n for n in order if 2 * n <= capacity)]:
        large = sum(c for n, c in counts.items() if n > capacity - small)
        middle = [(n, c) for n, c in counts.items() if capacity - small >= n and 2 * n > capacity]
        room = sum((capacity - n) * c for n, c in middle)
        rest = sum(n * c for n, c in counts.items() if 2 * n <= capacity and n >= small)
        best = max(best, large + sum(c for _, c in middle) + max(0, -(-(rest - room) // capacity)))
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, Pattern]]:
    """Best fit with decreasing lengths, many equal sequences at a time: (times, lengths)."""
    open_: dict[int, list[tuple[int, Pattern]]] = {}
    for length in sorted(counts, reverse=True):
        left, moved = counts[length], []
        while left:
            room = min((r for r in open_ if r >= length), default=None)
            times, pattern = open_[room].pop() if room is not None else (left, ())
            if room is not None and not open_[room]:
                del open_[room]
            room = capacity if room is None else room
            each = room // length
            used = min(times, max(1, left // each))
            take = min(each, left)
            if used < times and room < capacity:
                open_.setdefault(room, []).append((times - used, pattern))
            moved.append((room - take * length, (used, (*pattern, *[length] * take))))
            left -= used * take
        for room, entry in moved:
            open_.setdefault(room, []).append(entry)
    return [entry for entries in open_.values() for entry in entries]


def fillings(lengths: list[int], counts: dict[int, int], room: int, waste: int, limit: int) -> Iterator[tuple[int, Pattern]]:
    """Undominated fillings of a room with lengths (decreasing), at most ``waste`` short of it: (wasted, lengths), fuller ones first."""
    mask = (1 << (room + 1)) - 1
    reach = [1]
    for n in reversed(lengths):
        sums = reach[-1]
        for _ in range(min(counts[n], room // n)):
            more = (sums | sums << n) & mask
            if more == sums:
                break
            sums = more
        reach.append(sums)
    reach.reverse()
    best = reach[0].bit_length() - 1

    def walk(i: int, left: int, short: int, taken: list[int]) -> Iterator[list[int]]:
        if left == short:
            yield taken
            return
        while i < len(lengths) and lengths[i] > left:
            i += 1
        for j in range(i, len(lengths)):
            # Some sum of lengths from here on must leave exactly the wanted rest.
            if not reach[j] >> (left - short) & 1:
                return
            n = lengths[j]
            for k in range(min(counts[n], (left - short) // n), 0, -1):
                yield from walk(j + 1, left - k * n, short, [*taken, *[n] * k])

    found = 0
    for short in range(room - best, min(room, waste) + 1):
        for taken in walk(0, room, short, []):
            if short == 0 or not dominated(taken, short, lengths, counts):
                yield short, tuple(taken)
                found += 1
                if found == limit:
                    return


def dominated(taken: list[int], short: int, lengths: list[int], counts: dict[int, int]) -> bool:
    """Whether one longer length could stand for some of the taken ones, or a further one fit."""
    sums = {0}
    for n in taken[:12]:
        sums |= {s + n for s in sums}
    free = [n for n in lengths if counts[n] > taken.count(n)]
    return any(s <= n <= s + short and n not in taken for s in sums for n in free)


def complete(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES) -> list[tuple[int, Pattern]]:
    """Sequences (times, lengths) that use up the counts: bin completion from the longest length down."""
    counts = {n: c for n, c in counts.items() if c}
    best = best_fit(counts, capacity)
    fewest, least, total = sum(t for t, _ in best), lower_bound(counts, capacity), sum(n * c for n, c in counts.items())
    if fewest == least:
        return best

    left, path = dict(counts), []
    stack: list[tuple[Iterator[tuple[int, Pattern]], int, int, int]] = []
    wasted = used = 0

    def options() -> Iterator[tuple[int, Pattern]]:
        longest = max(left)
        free = dict(left)
        free[longest] -= 1
        lengths = sorted((n for n, c in free.items() if c and n <= capacity - longest), reverse=True)
        allowed = (fewest - 1) * capacity - total - wasted
        return ((w, (longest, *f)) for w, f in fillings(lengths, free, capacity - longest, allowed, BRANCHES))

    def undo(times: int, pattern: Pattern) -> None:
        for n in pattern:
            left[n] = left.get(n, 0) + times

    stack.append((options(), wasted, used, 0))
    for _ in range(nodes):
        if not stack or fewest == least:
            break
        choices, wasted, used, depth = stack[-1]
        while len(path) > depth:
            undo(*path.pop())
        choice = next(choices, None)
        if choice is None:
            stack.pop()
            continue
        short, pattern = choice
        times = min(left[n] // pattern.count(n) for n in set(pattern))
        # Waste counts against an improvement of the best so far.
        most = (fewest - 1) * capacity - total - wasted
        if short:
            times = min(times, most // short)
        if times <= 0:
            continue
        for n in pattern:
            left[n] -= times
            if not left[n]:
                del left[n]
        path.append((times, pattern))
        wasted, used = wasted + short * times, used + times
        if not left:
            if used < fewest:
                fewest, best = used, list(path)
            continue
        stack.append((options(), wasted, used, len(path)))
    return best


def places(best: list[tuple[int, Pattern]]) -> dict[str, np.ndarray]:
    """Ranges of ranks: ``length``, ``first`` rank, first ``sequence`` and ``offset``, by length and rank."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for times, pattern in best:
        offset = 0
        for n in pattern:
            rows.append((n, taken.get(n, 0), sequence, offset))
            taken[n] = taken.get(n, 0) + times
            offset += n
        sequence += times
    made = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return dict(zip(("length", "first", "sequence", "offset"), made.T))


# -- pieces and their places ----------------------------------------------------------------

def pieces(docs: DataFrame, make: Callable[[], Callable[[str], bytes]], keep: Sequence[str], text: str = "text", end: int = 2,
           capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """The kept columns and, per piece, ``piece``, ``start``, ``length``, ``ids_crc32`` and, if asked for, the packed ``ids``; ``task`` and ``nth`` rank it."""
    fields = [StructField(n, LongType(), False) for n in ("piece", "start", "length", "ids_crc32", "task", "nth")] + [StructField("ids", BinaryType())] * with_ids
    kind = pa.list_(pa.struct([pa.field(f.name, pa.binary() if f.name == "ids" else pa.int64(), f.nullable) for f in fields]))

    def build():
        encode, seen, task = make(), [0] * (capacity + 1), TaskContext.get().partitionId()

        def work(texts):
            rows = []
            for t in texts:
                ids, row = encode(t or "") + array("I", [end]).tobytes(), []
                for i, (a, b) in enumerate(bounds(len(ids) // 4, capacity)):
                    part = ids[4 * a:4 * b]
                    made = {"piece": i, "start": a, "length": b - a, "ids_crc32": zlib.crc32(part), "task": task, "nth": seen[b - a]}
                    row.append(made | {"ids": part} if with_ids else made)
                    seen[b - a] += 1
                rows.append(row)
            return [pa.array(rows, kind)]

        return work

    name = fresh("_pieces", keep)
    found = map_texts(docs, keep, build, [(name, ArrayType(StructType(fields), False))], text)
    other = [f"`{c}`" for c in keep]
    return found.select(*other, F.explode(name).alias(name)).select(*other, f"{name}.*")


def place(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces (with ``length``, ``task`` and ``nth``) with ``sequence_id`` and ``offset``."""
    per_task = cut.groupBy("length", "task").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_task.select("length", "task", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    counts = {r["length"]: r["_n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("_n")).collect()}
    table = places(complete(counts, capacity))
    rank_name = fresh("_rank", cut.columns)
    rows = cut.join(starts, ["length", "task"]).select(*[cut[f"`{c}`"] for c in cut.columns], (F.col("_before") + F.col("nth")).alias(rank_name))
    step = max(counts.values(), default=0) + 1
    keys = table["length"] * step + table["first"] if step * (capacity + 1) < 1 << 62 else None

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", rank_name))
            if keys is not None:
                at = np.searchsorted(keys, length * step + rank, "right") - 1
            else:
                at = np.array([np.searchsorted(table["first"][table["length"] == n], r, "right") - 1 + np.searchsorted(table["length"], n) for n, r in zip(length, rank)], np.int64)
            made = [pa.array(table["sequence"][at] + rank - table["first"][at]), pa.array(table["offset"][at])]
            kept = [c for c in batch.schema.names if c != rank_name]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *made], names=[*kept, "sequence_id", "offset"])

    schema = StructType([*cut.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])
    return rows.mapInArrow(placed, schema)


def pack(docs: DataFrame, make: Callable[[], Callable[[str], bytes]], keep: Sequence[str], text: str = "text", end: int = 2,
         capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces with their places; written once, so that texts are tokenised once."""
    return place(stored(pieces(docs, make, keep, text, end, capacity, with_ids)), capacity).drop("task", "nth")


def sequences(placed: DataFrame) -> DataFrame:
    """``sequence_id``, ``n_tokens`` and packed ``ids`` of whole sequences from pieces with ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined: Column = F.aggregate(parts, F.lit(b""), lambda done, p: F.concat(done, p["ids"]))
    return placed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), joined.alias("ids"))
