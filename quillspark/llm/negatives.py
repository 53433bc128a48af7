"""Hard negatives by exact score windows over Hilbert-ordered blocks with zone maps.

Rows are ordered along a Hilbert curve through their vectors and cut into Parquet
blocks of ``BLOCK`` rows, each with the least and greatest value of every dimension.
For an anchor, interval arithmetic on a zone map bounds every inner product with the
block's rows from both sides. A block is read for an anchor only if those bounds
meet one of its score windows:

* positives: from the last of the best same-label scores in the anchor's own block up,
* negatives: for each positive from ``low`` percent of its score, or from the last of
  the best such scores in the anchor's own block if that is more, up to ``high`` percent.

What is read is multiplied exactly, so the bounds save reading and never change a
result. Anchors are packed into slices and zone maps into pages; slices meet all pages,
then (slice, part of ``PART`` blocks) tiles are multiplied, each side of bounded size,
and only the best of each window leave a tile. Nothing but the range of every
dimension, counts of slices and pages reach the driver.

Defined results: rows with a null label or vector, or a null or non-finite component,
take no part; vectors count as long as the longest, with zeros at the end; rows are
different rows even if equal or of equal id, so a copy of an anchor can be its
positive; ids that are null come last among ties; an empty table gives no rows. Labels
are integers. Components are whole numbers; scores are exact while they fit a long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from quillspark.operators.ordered import top_k
from quillspark.plans.lineage import stored

BLOCK = 512
PART = 32
PAGE = 1024
SLICE = 4096
KEY_BITS = 128
#: Other-label scores of its own block that an anchor remembers to narrow its windows.
SEEDS = 128
_CHUNK = 256
_LAST = np.iinfo(np.int64).max
_EXACT = 2.0 ** 53


def usable(label: Column, embedding: Column) -> Column:
    finite = F.forall(embedding, lambda x: F.coalesce((F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False)))
    return label.isNotNull() & embedding.isNotNull() & finite


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Keys of rows of whole numbers below ``2 ** bits`` along a Hilbert curve, as bytes (Skilling's transform)."""
    x = [c.copy() for c in cells.T]
    step = 1 << (bits - 1)
    while step > 1:
        for i in range(len(x)):
            swap = np.where(x[i] & step, 0, (x[0] ^ x[i]) & (step - 1))
            flip = np.where(x[i] & step, step - 1, 0)
            x[i] = x[i] ^ swap if i else x[i]
            x[0] = x[0] ^ swap ^ flip
        step >>= 1
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    turn, step = np.zeros_like(x[0]), 1 << (bits - 1)
    while step > 1:
        turn = np.where(x[-1] & step, turn ^ (step - 1), turn)
        step >>= 1
    planes = [((c ^ turn) >> bit) & 1 for bit in range(bits - 1, -1, -1) for c in x]
    return np.packbits(np.array(planes, np.uint8).T, axis=1)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of a column as rows of equal width, zeros at the end."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of whole numbers, exact."""
    if a.size and b.size and float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < _EXACT:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return a @ b.T


def bounds(a: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of each row with any vector between ``low`` and ``high``."""
    up, down = np.maximum(a, 0), np.minimum(a, 0)
    return products(up, low) + products(down, high), products(up, high) + products(down, low)


def ranges(rows: DataFrame) -> dict[int, tuple[int, int]]:
    """Least and greatest value of every dimension; the driver sees one row a dimension."""

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = high = np.zeros(0, np.int64)
        for batch in batches:
            column = batch.column(0)
            wide = max([len(low), *np.diff(column.offsets.to_numpy()).tolist()])
            values = matrix(column, wide)
            low, high = np.pad(low, (0, wide - len(low))), np.pad(high, (0, wide - len(high)))
            if len(values):
                low, high = np.minimum(low, values.min(0)), np.maximum(high, values.max(0))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(low))), pa.array(low), pa.array(high)], names=["dim", "low", "high"])

    found = rows.select("vector").mapInArrow(reduced, "dim long, low long, high long").groupBy("dim").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    return {r["dim"]: (r["low"], r["high"]) for r in found.collect()}


def packed(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()


def longs(data: bytes, width: int | None = None) -> np.ndarray:
    found = np.frombuffer(data, np.int64)
    return found if width is None else found.reshape(-1, width)


def numbered(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[int, pa.Table]]:
    """Tables of ``size`` rows of a partition in order, each with a number that no other partition has."""
    held, n, count = [], 0, 0
    task = TaskContext.get().partitionId() << 32
    for batch in batches:
        while batch.num_rows:
            take = batch.slice(0, size - n)
            held.append(take)
            n += take.num_rows
            batch = batch.slice(take.num_rows)
            if n == size:
                yield task | count, pa.Table.from_batches(held).combine_chunks()
                held, n, count = [], 0, count + 1
    if held:
        yield task | count, pa.Table.from_batches(held).combine_chunks()


def blocks_of(rows: DataFrame, limits: dict[int, tuple[int, int]]) -> DataFrame:
    """One row per block: ids, labels, anchor marks and vectors packed, and the zone map."""
    width = len(limits)
    low = np.array([limits[i][0] for i in range(width)], np.int64)
    span = np.array([max(1, limits[i][1] - limits[i][0]) for i in range(width)], float)
    bits = max(1, min(16, KEY_BITS // max(1, width)))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = matrix(batch.column("vector"), width)
            cells = np.minimum(((values - low) / span * (1 << bits)).astype(np.int64), (1 << bits) - 1)
            keys = pa.array([k.tobytes() for k in hilbert(cells, bits)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, keys], names=[*batch.schema.names, "curve"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, table in numbered(batches, BLOCK):
            values = matrix(table.column("vector").chunk(0), width)
            ids = table.column("vec_id").fill_null(_LAST).to_numpy()
            made = [number, number // PART, packed(ids), packed(table.column("vec_id").is_null().to_numpy()), packed(table.column("label").to_numpy()),
                    packed(table.column("anchor").to_numpy()), packed(values), packed(values.min(0)), packed(values.max(0))]
            yield pa.RecordBatch.from_pylist([dict(zip(names, made))])

    names = ["block", "part", "ids", "unknown", "labels", "anchors", "vectors", "low", "high"]
    schema = "block long, part long, ids binary, unknown binary, labels binary, anchors binary, vectors binary, low binary, high binary"
    placed = rows.mapInArrow(keyed, "vec_id long, label long, anchor boolean, vector array<bigint>, curve binary")
    # Equal vectors are dealt by id, so a common one does not fill a partition.
    placed = placed.repartitionByRange("curve", "vec_id").sortWithinPartitions("curve", "vec_id", "label")
    return stored(placed.mapInArrow(cut, schema))


def best_of(scores: np.ndarray, ids: np.ndarray, fits: np.ndarray, low: list[int], high: list[int], k: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each window the places of its first ``k`` scores, higher first, ties by smaller id."""
    found = np.flatnonzero(fits & (scores >= min(low)) & (scores <= max(high)))
    found = found[np.lexsort((found, ids[found], -scores[found]))]
    order = -scores[found]
    for w, (a, b) in enumerate(zip(low, high)):
        start = np.searchsorted(order, -b, "left")
        stop = min(start + k, np.searchsorted(order, -a, "right"))
        if stop > start:
            yield w, found[start:stop]


def seeded(blocks: DataFrame, width: int, k: int) -> DataFrame:
    """The anchors, with the least score a positive has at least and the other labels' best scores, both from their own block."""

    def seed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                at = np.flatnonzero(np.frombuffer(row["anchors"], bool))
                vectors, labels, ids, out = longs(row["vectors"], width), longs(row["labels"]), longs(row["ids"]), []
                scores = products(vectors[at], vectors) if len(at) else None
                for i, a in enumerate(at.tolist()):
                    same = labels == labels[a]
                    others = np.sort(scores[i][~same])[::-1][:SEEDS]
                    same[a] = False
                    mine = np.sort(scores[i][same])[::-1]
                    out.append({"block": row["block"], "at": a, "vec_id": int(ids[a]), "label": int(labels[a]), "vector": packed(vectors[a]),
                                "least": int(mine[k - 1]) if len(mine) >= k else -_LAST, "seeds": packed(others)})
                if out:
                    yield pa.RecordBatch.from_pylist(out)

    return stored(blocks.select("block", "ids", "labels", "anchors", "vectors").mapInArrow(
        seed, "block long, at long, vec_id long, label long, vector binary, least long, seeds binary"))


def counted(df: DataFrame, number: str) -> tuple[DataFrame, int]:
    """The rows with ``seq`` from 0 on in the order of their numbers, and how many there are."""
    places = stored(df.select(number).selectExpr(number, f"row_number() over (order by {number}) - 1 as seq"))
    return df.join(places, number), places.count()


def search(blocks: DataFrame, asked: DataFrame, width: int, k: int, same: bool) -> DataFrame:
    """The first ``k`` rows of every window of the anchors.

    ``asked`` holds ``block``, ``at``, ``label``, ``vector`` and the windows' ends ``low`` and ``high`` as arrays of one length.
    Returns ``block``, ``at``, window ``w``, ``place``, ``found_id`` and ``score``.
    """

    def slices_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, table in numbered(batches, SLICE):
            lows, highs = (np.array(table.column(c).to_pylist(), np.int64) for c in ("low", "high"))
            made = [number, lows.shape[1], b"".join(table.column("vector").to_pylist()), packed(lows), packed(highs),
                    *[packed(table.column(c).to_numpy()) for c in ("block", "at", "label")]]
            yield pa.RecordBatch.from_pylist([dict(zip(["slice", "windows", "vectors", "lows", "highs", "blocks", "ats", "labels"], made))])

    def pages_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, table in numbered(batches, PAGE):
            made = [number, *[packed(table.column(c).to_numpy()) for c in ("block", "part")], *[b"".join(table.column(c).to_pylist()) for c in ("low", "high")]]
            yield pa.RecordBatch.from_pylist([dict(zip(["page", "page_blocks", "parts", "page_low", "page_high"], made))])

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per (slice, block) the anchors whose windows meet the bounds."""
        for batch in batches:
            for row in batch.to_pylist():
                vectors, lows, highs = longs(row["vectors"], width), longs(row["lows"], row["windows"]), longs(row["highs"], row["windows"])
                ids, parts, out = longs(row["page_blocks"]), longs(row["parts"]), []
                below, above = bounds(vectors, longs(row["page_low"], width), longs(row["page_high"], width))
                meets = np.zeros(below.shape, bool)
                for w in range(row["windows"]):
                    meets |= (above >= lows[:, w, None]) & (below <= highs[:, w, None]) & (lows <= highs)[:, w, None]
                for j in np.flatnonzero(meets.any(0)).tolist():
                    out.append({"slice": row["slice"], "part": int(parts[j]), "block": int(ids[j]), "who": packed(np.flatnonzero(meets[:, j]).astype(np.int32))})
                if out:
                    yield pa.RecordBatch.from_pylist(out)

    def multiplied(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if right.num_rows and left.num_rows:
            row = right.to_pylist()[0]
            vectors, lows, highs = longs(row["vectors"], width), longs(row["lows"], row["windows"]), longs(row["highs"], row["windows"])
            homes, ats, labels = longs(row["blocks"]), longs(row["ats"]), longs(row["labels"])
            held = sorted(left.to_pylist(), key=lambda b: b["block"])
            sizes = [len(b["ids"]) // 8 for b in held]
            block, at = np.repeat([b["block"] for b in held], sizes), np.concatenate([np.arange(n) for n in sizes])
            ids, of = (np.concatenate([longs(b[c]) for b in held]) for c in ("ids", "labels"))
            unknown = np.concatenate([np.frombuffer(b["unknown"], bool) for b in held])
            values = np.concatenate([longs(b["vectors"], width) for b in held])
            reads = {x["block"]: np.frombuffer(x["who"], np.int32) for x in row["reads"]}
            wanted = np.zeros((len(held), len(homes)), bool)
            for i, b in enumerate(held):
                wanted[i, reads[b["block"]]] = True
            which = np.repeat(np.arange(len(held)), sizes)
            anchors = np.flatnonzero(wanted.any(0))
            for c in range(0, len(anchors), _CHUNK):
                some = anchors[c:c + _CHUNK]
                scores = products(vectors[some], values)
                for i, a in enumerate(some.tolist()):
                    fits = wanted[which, a] & ((of == labels[a]) == same)
                    if same:
                        fits &= (block != homes[a]) | (at != ats[a])
                    for w, places in best_of(scores[i], ids, fits, lows[a].tolist(), highs[a].tolist(), k):
                        out += [(int(homes[a]), int(ats[a]), w, int(block[p]) * BLOCK + int(at[p]), None if unknown[p] else int(ids[p]), int(scores[i][p])) for p in places]
        names = ["block", "at", "w", "place", "found_id", "score"]
        return pa.table({n: pa.array(v, pa.int64()) for n, v in zip(names, zip(*out) if out else [[]] * 6)})

    slices = stored(asked.select("block", "at", "label", "vector", "low", "high").mapInArrow(
        slices_of, "slice long, windows long, vectors binary, lows binary, highs binary, blocks binary, ats binary, labels binary"))
    pages = stored(blocks.select("block", "part", "low", "high").mapInArrow(pages_of, "page long, page_blocks binary, parts binary, page_low binary, page_high binary"))
    pages, count = counted(pages, "page")
    met = slices.select("slice", "windows", "vectors", "lows", "highs", F.explode(F.sequence(F.lit(0), F.lit(max(1, count) - 1))).alias("seq")).join(pages, "seq")
    needs = stored(met.select("slice", "windows", "vectors", "lows", "highs", "page_blocks", "parts", "page_low", "page_high").mapInArrow(
        needed, "slice long, part long, block long, who binary"))
    left = blocks.join(needs.select("block", "slice"), "block").select("slice", "part", "block", "ids", "unknown", "labels", "vectors")
    # A part has at most PART blocks, so the list is bounded.
    reads = needs.groupBy("slice", "part").agg(F.collect_list(F.struct("block", "who")).alias("reads"))
    right = reads.join(slices, "slice").withColumnsRenamed({"slice": "of_slice", "part": "of_part"})
    tiles = left.groupBy("slice", "part").cogroup(right.groupBy("of_slice", "of_part"))
    found = tiles.applyInArrow(multiplied, "block long, at long, w long, place long, found_id long, score long")
    return stored(top_k(found, ["block", "at", "w"], [F.desc("score"), F.asc_nulls_last("found_id"), F.asc("place")], k))


def mine(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100,
         vec_id: str = "vec_id", label: str = "label", vector: str = "vector") -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id`` and both scores.

    ``vector`` holds arrays of whole numbers; ``anchor`` says which rows ask. Each anchor's best ``positives`` rows of its
    label are its positives, and of each the best ``negatives`` rows of other labels from ``low`` to ``high`` percent of its score follow.
    """
    rows = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"),
                       F.coalesce(anchor, F.lit(False)).alias("anchor"), F.col(vector).cast("array<bigint>").alias("vector"))
    rows = rows.where("label is not null and vector is not null")
    limits = ranges(rows)
    width = max(1, len(limits))
    blocks = blocks_of(rows, limits or {0: (0, 0)})
    anchors = seeded(blocks, width, positives)
    top = F.lit(_LAST)
    first = search(blocks, anchors.withColumns({"low": F.array("least"), "high": F.array(top)}), width, positives, same=True)
    found = first.select("block", "at", F.col("rank").alias("w"), F.col("found_id").alias("positive_id"), F.col("score").alias("positive_score"))
    # An anchor has at most as many windows as positives; missing ones are empty.
    scores = found.groupBy("block", "at").agg(F.map_from_entries(F.collect_list(F.struct("w", "positive_score"))).alias("scores"))
    asked = anchors.join(scores, ["block", "at"])

    def narrowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lows, highs = [], []
            for row in batch.to_pylist():
                score, seeds = dict(row["scores"]), longs(row["seeds"])
                a, b = [1] * positives, [0] * positives
                for w, s in score.items():
                    a[w - 1], b[w - 1] = -(-low * s // 100), high * s // 100
                    start = int(np.searchsorted(-seeds, -b[w - 1], "left"))
                    if start + negatives <= len(seeds):
                        a[w - 1] = max(a[w - 1], int(seeds[start + negatives - 1]))
                lows.append(a)
                highs.append(b)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("block", "at", "label", "vector")],
                                              pa.array(lows, pa.list_(pa.int64())), pa.array(highs, pa.list_(pa.int64()))],
                                             names=["block", "at", "label", "vector", "low", "high"])

    asked = asked.select("block", "at", "label", "vector", "seeds", "scores").mapInArrow(
        narrowed, "block long, at long, label long, vector binary, low array<bigint>, high array<bigint>")
    second = search(blocks, asked, width, negatives, same=False).select(
        "block", "at", (F.col("w") + 1).alias("w"), "rank", F.col("found_id").alias("negative_id"), F.col("score").alias("negative_score"))
    both = found.join(second, ["block", "at", "w"]).join(anchors.select("block", "at", F.col("vec_id").alias("anchor_id")), ["block", "at"])
    return both.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
