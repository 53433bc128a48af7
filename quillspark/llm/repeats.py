"""Exact removal of repeated byte strings by bucket-pointer refinement.

A byte is removed if a string of ``length`` bytes that covers it also starts
anywhere else. The suffixes are refined bucket by bucket, sparse first:

1. Every window of ``length`` bytes picks one of its ``gram``-byte strings, the
   one of least hash. Equal windows pick at the same place, so picked suffixes
   suffice; each stands for the run of windows that picked it. Their initial
   bucket is their gram.
2. Buckets of one suffix are done. The others are sorted by the identifier of
   the whole string that the run of windows spans; equal ones are repeated in
   full. Of a bucket that still has single ones, these and one suffix of each
   class go on.
3. Their windows are refined at every place: an identifier of ``gram`` bytes is
   made of those of its halves, and windows are sorted by the identifiers at
   their start and ``gram`` bytes before their end.

Identifiers go out per slab of texts and hash range as packed arrays, and only
places inside the slab come back, so a string that a third of all documents
hold is spread over all slabs. Texts are shuffled once, into slabs by hash; the
three steps that read them reuse that exchange. Slabs are put in order by id and
text, so a repeated task finds the same places. Identifiers have 128 bits in all.

Defined results: null is empty; shorter texts keep every byte; matches never
cross documents; a repeated row is another document, so both lose what they
share; null ids are carried along.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from quillspark.llm.rolling import Rolling, blocks, mixed

LENGTH = 200
GRAM = 100
SLAB_BYTES = 8 << 20
RANGES_PER_PARTITION = 4

_HASH = Rolling(7)
_ROWS = "part int, slab long, one binary, two binary, at binary, ends binary"
_SCHEMA = pa.schema([("part", pa.int32()), ("slab", pa.int64()), *((n, pa.binary()) for n in ("one", "two", "at", "ends"))])


def _texts(table: pa.Table) -> tuple[list, np.ndarray, np.ndarray]:
    """Ids, bytes and limits of the documents of a slab, in an order of their own."""
    rows = sorted(zip(table.column("doc_id").to_pylist(), table.column("text").to_pylist()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    parts = [(t or "").encode("utf-8") for _, t in rows]
    return [i for i, _ in rows], np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)])


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every window of the given width."""
    step = 1
    while step * 2 <= width:
        values = np.minimum(values[:-step], values[step:])
        step *= 2
    return np.minimum(values[:len(values) - (width - step)], values[width - step:]) if step < width else values


def picked(data: np.ndarray, limits: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Gram hash, span hash, first and last window start of every picked suffix."""
    found = [_picked(data[limits[a]:limits[b]], limits[a:b + 1] - limits[a], limits[a], length, gram) for a, b in blocks(np.diff(limits).tolist())]
    return tuple(np.concatenate(c) for c in zip(*found)) if found else _NONE


_NONE = (*[np.zeros(0, np.uint64)] * 2, *[np.zeros(0, np.int64)] * 2)


def _picked(data: np.ndarray, limits: np.ndarray, offset: int, length: int, gram: int) -> tuple[np.ndarray, ...]:
    if len(data) < length:
        return _NONE
    sums = _HASH.sums(data)
    hashes = mixed(_HASH.windows(sums, gram))
    low = np.uint64((1 << len(data).bit_length()) - 1)
    # Hash above, place below: ties go to the first place in either copy.
    choice = _least((hashes & ~low) | np.arange(len(hashes), dtype=np.uint64), length - gram + 1) & low
    inside = np.zeros(len(choice) + 1, np.int32)
    first, last = limits[:-1], limits[1:] - length + 1
    np.add.at(inside, first[last > first], 1)
    np.add.at(inside, last[last > first], -1)
    inside = np.cumsum(inside[:-1], dtype=np.int32) > 0
    new = np.ones(len(choice), bool)
    new[1:] = (choice[1:] != choice[:-1]) | (inside[1:] != inside[:-1])
    new[first[first < len(new)]] = True
    bounds = np.append(np.flatnonzero(new), len(choice))
    runs = inside[bounds[:-1]]
    start, end = bounds[:-1][runs], bounds[1:][runs] - 1
    return hashes[choice[start].astype(np.int64)], _HASH.spans(sums, start, end + length), start + offset, end + offset


def identified(data: np.ndarray, limits: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
    """Every window start of the given runs with the identifiers of its first and its last ``GRAM`` bytes."""
    out, half, sizes = [], GRAM // 2, np.diff(limits).tolist()
    for a, b in blocks(sizes):
        offset = limits[a]
        mine = slice(*np.searchsorted(low, [offset, limits[b]]))
        widths = high[mine] - low[mine] + 1
        if not len(widths):
            continue
        starts = np.repeat(low[mine] - offset - np.cumsum(widths) + widths, widths) + np.arange(widths.sum())
        halves = _HASH.windows(_HASH.sums(data[offset:limits[b]]), half)
        grams = mixed(halves[:-half] * np.uint64(0x9E3779B97F4A7C15) + halves[half:])
        out.append((starts + offset, grams[starts], grams[starts + LENGTH - GRAM]))
    return tuple(np.concatenate(c) for c in zip(*out))


def _by_range(hashes: np.ndarray, parts: int):
    ranges = (hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
    order = np.argsort(ranges.astype(np.uint16 if parts < 1 << 16 else np.uint32), kind="stable")
    edges = np.searchsorted(ranges[order], np.arange(parts + 1, dtype=np.uint64)).tolist()
    return ((r, order[a:b]) for r, (a, b) in enumerate(zip(edges[:-1], edges[1:])) if a < b)


def _rows(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), _SCHEMA.types)], schema=_SCHEMA) if rows else _SCHEMA.empty_table()


def _start(parts: int):
    def run(table: pa.Table) -> pa.Table:
        slab = table.column("slab")[0].as_py()
        _, data, limits = _texts(table)
        grams, spans, _, _ = picked(data, limits)
        return _rows([(r, slab, grams[i].tobytes(), spans[i].tobytes(), i.astype(np.uint32).tobytes(), None) for r, i in _by_range(grams, parts)])

    return run


def _packed(table: pa.Table):
    """All identifiers of a hash range and, per row, its slab and places."""
    one, two = (np.frombuffer(b"".join(x or b"" for x in table.column(c).to_pylist()), np.uint64) for c in ("one", "two"))
    return one, two, table.column("slab").to_pylist(), [np.frombuffer(x or b"", np.uint32) for x in table.column("at").to_pylist()]


def _classes(one: np.ndarray, two: np.ndarray):
    """Sorted order, and where buckets of equal ``one`` and classes of equal pairs start in it."""
    order = np.lexsort((two, one))
    one, two = one[order], two[order]
    bucket = np.ones(len(order), bool)
    bucket[1:] = one[1:] != one[:-1]
    new = bucket.copy()
    new[1:] |= two[1:] != two[:-1]
    return order, bucket, new


def _back(values: np.ndarray, slabs: list, places: list[np.ndarray], kept: np.ndarray) -> list[tuple]:
    rows, first = [], 0
    for slab, at in zip(slabs, places):
        mine = slice(first, first + len(at))
        first += len(at)
        if kept[mine].any():
            rows.append((0, slab, values[mine][kept[mine]].tobytes(), None, at[kept[mine]].tobytes(), None))
    return rows


REPEATED, SHOWN = 1, 2


def _refine(table: pa.Table) -> pa.Table:
    """Marks of the suffixes of a hash range: repeated in full, to be shown window by window, or both."""
    one, two, slabs, places = _packed(table)
    order, bucket, new = _classes(one, two)
    size = np.bincount(np.cumsum(new) - 1)[np.cumsum(new) - 1]
    of_bucket = np.cumsum(bucket) - 1
    several = np.bincount(of_bucket)[of_bucket] > 1
    single = (size == 1) & several
    unsettled = np.bincount(of_bucket, single)[of_bucket] > 0
    marks = np.zeros(len(order), np.uint8)
    marks[order] = REPEATED * (size > 1) + SHOWN * (single | (new & unsettled))
    return _rows(_back(marks, slabs, places, marks > 0))


def _show(parts: int):
    def run(texts: pa.Table, marked: pa.Table) -> pa.Table:
        if not texts.num_rows or not marked.num_rows:
            return _SCHEMA.empty_table()
        slab = texts.column("slab")[0].as_py()
        _, data, limits = _texts(texts)
        _, _, low, high = picked(data, limits)
        marks = np.zeros(len(low), np.uint8)
        for at, one in zip(marked.column("at").to_pylist(), marked.column("one").to_pylist()):
            marks[np.frombuffer(at, np.uint32)] = np.frombuffer(one, np.uint8)
        sure = marks & REPEATED > 0
        rows = [(slab % parts, slab, None, None, low[sure].astype(np.uint32).tobytes(), high[sure].astype(np.uint32).tobytes())]
        shown = marks & SHOWN > 0
        if shown.any():
            starts, one, two = identified(data, limits, low[shown], high[shown])
            rows += [(r, slab, one[i].tobytes(), two[i].tobytes(), starts[i].astype(np.uint32).tobytes(), None) for r, i in _by_range(one, parts)]
        return _rows(rows)

    return run


def _settle(table: pa.Table) -> pa.Table:
    """Windows of a hash range that occur twice, and the settled runs as they came."""
    ended = pc.is_valid(table.column("ends"))
    settled = table.filter(ended)
    one, two, slabs, places = _packed(table.filter(pc.invert(ended)))
    order, _, new = _classes(one, two)
    size = np.bincount(np.cumsum(new) - 1)[np.cumsum(new) - 1] if len(order) else np.zeros(0, int)
    twice = np.zeros(len(order), bool)
    twice[order] = size > 1
    return pa.concat_tables([settled.cast(_SCHEMA), _rows(_back(np.zeros(len(order), np.uint8), slabs, places, twice))])


def _remove(texts: pa.Table, found: pa.Table) -> pa.Table:
    ids, data, limits = _texts(texts)
    edge = np.zeros(len(data) + 1, np.int32)
    for at, ends in zip(found.column("at").to_pylist(), found.column("ends").to_pylist()):
        starts = np.frombuffer(at, np.uint32).astype(np.int64)
        stops = np.frombuffer(ends, np.uint32).astype(np.int64) if ends is not None else starts
        np.add.at(edge, starts, 1)
        np.add.at(edge, stops + LENGTH, -1)
    gone = np.cumsum(edge[:-1], dtype=np.int32) > 0
    kept, removed, spans = [], [], []
    for a, b in zip(limits[:-1].tolist(), limits[1:].tolist()):
        mine = gone[a:b]
        removed.append(int(np.count_nonzero(mine)))
        spans.append(int(np.count_nonzero(mine[1:] & ~mine[:-1])) + int(b > a and mine[0]))
        kept.append(data[a:b][~mine].tobytes() if removed[-1] else data[a:b].tobytes())
    return pa.table({"doc_id": pa.array(ids, texts.schema.field("doc_id").type), "n_bytes": pa.array(np.diff(limits), pa.int64()),
                     "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept": pa.array(kept, pa.binary())})


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans`` and the ``kept`` bytes of every document."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    slabs = max(1, -(-total // SLAB_BYTES))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions")) * RANGES_PER_PARTITION
    texts = docs.select(F.pmod(F.xxhash64(doc_id, text), F.lit(slabs)).alias("slab"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    by_slab = texts.groupBy("slab")
    marked = by_slab.applyInArrow(_start(parts), _ROWS).groupBy("part").applyInArrow(_refine, _ROWS)
    shown = by_slab.cogroup(marked.groupBy("slab")).applyInArrow(_show(parts), _ROWS)
    found = shown.groupBy("part").applyInArrow(_settle, _ROWS)
    return by_slab.cogroup(found.groupBy("slab")).applyInArrow(_remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
