"""N-gram Jaccard join: linked documents as components, by rare-first prefix filtering.

1. Texts are dealt into slabs by hash; one row of each text goes on, so copies
   are one class. A slab turns its texts into sets of word shingle hashes and
   sends sorted 32-bit keys of them to hash ranges, packed in one row per slab
   and range.
2. Each hash range counts in how many texts a key occurs and answers with one
   byte per key, in the same order. Keys that collide share a count: the order
   below stays the same for all texts.
3. The slab orders the shingles of a text by frequency, ties by hash. With ``n``
   shingles, two texts can only reach the threshold if they share one of their
   first ``n - ceil(share n) + 1``. Shingles of one text come first in that order:
   whoever has enough of them has no partner and is done.
4. Texts are joined on prefix shingles with the length filter (sizes within the
   threshold), the positional filter (overlap still possible after the shared
   place) and the least difference of the sets (shingles of one text, and bits
   in which the parities of the shared ones differ); a pair is kept once, passes
   the suffix filter and is verified by exact intersection.
5. So that a large group does not become all its pairs, every prefix shingle
   first pairs its classes with one pivot of its own. Classes that these links
   left outside the largest component of a shingle meet ``PIVOTS`` classes of
   it; those still outside are paired with all other components of the shingle.
   A pair inside a component adds nothing, so no link is lost.

``width`` is the number of words of a shingle and ``percent`` the least Jaccard
share of a link; they are 4 and 85 unless given.

Shingles are compared by 64-bit hashes, texts by 128-bit hashes. Texts are
shuffled once; both steps that read them reuse that exchange and put a slab in
order by id and text, so a repeated task finds the same places.

Defined results: null and empty texts have no shingles and are linked with
nothing; fewer words than a shingle has are one shingle; a null id takes part and the component's
id is the smallest that is not null; repeated rows are linked; other columns are
not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from quillspark.llm import shingles
from quillspark.llm.components import components
from quillspark.plans.lineage import cut

PERCENT = 85
SLAB_BYTES = 8 << 20
RANGES_PER_PARTITION = 4
SUFFIX_DEPTH = 3
WORDS_OF_BITS = 8
PIVOTS = 8

_ROWS = "part int, slab long, keys binary, places binary"
_SCHEMA = pa.schema([("part", pa.int32()), ("slab", pa.int64()), ("keys", pa.binary()), ("places", pa.binary())])
_DOC = "mark binary, n int, alone int, prefix array<long>, bits array<long>, items binary"


def _texts(table: pa.Table) -> list[tuple[int | None, str]]:
    """The rows of a slab in an order of their own."""
    return sorted(zip(table.column("doc_id").to_pylist(), (t or "" for t in table.column("text").to_pylist())), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


def _mark(text: str) -> bytes:
    return hashlib.md5(text.encode("utf-8")).digest()


def _keyed(found: list[np.ndarray], parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash range and 32-bit key of every shingle of a slab, and the order by both."""
    hashes = np.concatenate([*found, np.zeros(0, np.uint64)])
    keys = (hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32) << np.uint64(32) | hashes & np.uint64(0xFFFFFFFF)
    return keys, np.argsort(keys, kind="stable")


def _table(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), _SCHEMA.types)], schema=_SCHEMA) if rows else _SCHEMA.empty_table()


def _send(parts: int, width: int):
    """Sorted keys of the slab's distinct texts, by hash range, and which rows those texts are."""

    def run(texts: pa.Table, first: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return _SCHEMA.empty_table()
        slab, rows = texts.column("slab")[0].as_py(), _texts(texts)
        wanted = set(zip(first.column("doc_id").to_pylist(), first.column("mark").to_pylist()))
        chosen = []
        for i, (doc_id, text) in enumerate(rows):
            if (doc_id, mark := _mark(text)) in wanted:
                wanted.remove((doc_id, mark))
                chosen.append(i)
        keys, order = _keyed(shingles.sets([rows[i][1] for i in chosen], width), parts)
        keys = keys[order]
        edges = np.searchsorted(keys, np.arange(parts + 1, dtype=np.uint64) << np.uint64(32)).tolist()
        out = [(slab % parts, slab, None, np.array(chosen, np.uint32).tobytes())]
        for r, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
            if a < b:
                # Steps between sorted keys are small; byte planes let the shuffle compress their upper bytes.
                steps = np.diff(keys[a:b] & np.uint64(0xFFFFFFFF), prepend=np.uint64(0)).astype(np.uint32)
                out.append((r, slab, steps.view(np.uint8).reshape(-1, 4).T.tobytes(), None))
        return _table(out)

    return run


def rarity(count: np.ndarray) -> np.ndarray:
    """Document counts on one byte: exact below 64, then eight steps per doubling."""
    return np.where(count < 64, count, np.minimum(255, 64 + np.floor(8 * np.log2(np.maximum(count, 64) / 64)))).astype(np.uint8)


def parity(hashes: np.ndarray) -> np.ndarray:
    """A bit set that every shingle flips one bit of: sets differ in at least as many shingles as bits."""
    odd = np.bincount((hashes % np.uint64(64 * WORDS_OF_BITS)).astype(np.int64), minlength=64 * WORDS_OF_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _count(table: pa.Table) -> pa.Table:
    """Of one hash range, the rarity of every key, back by slab in the order of the keys."""
    out, keys = [], []
    for part, slab, packed, places in zip(*(table.column(c).to_pylist() for c in ("part", "slab", "keys", "places"))):
        if packed is None:
            out.append((part, slab, None, places))
        else:
            steps = np.ascontiguousarray(np.frombuffer(packed, np.uint8).reshape(4, -1).T).view(np.uint32).ravel()
            keys.append((part, slab, np.cumsum(steps, dtype=np.uint64)))
    if keys:
        _, which, count = np.unique(np.concatenate([k for _, _, k in keys]), return_inverse=True, return_counts=True)
        rare, at = rarity(count)[which], 0
        for part, slab, own in keys:
            out.append((part, slab, rare[at:at + len(own)].tobytes(), None))
            at += len(own)
    return _table(out)


def least_share(n: int, percent: int = PERCENT) -> int:
    """Shingles a partner shares at least with a set of ``n``."""
    return -(-percent * n // 100)


def _order(parts: int, width: int, percent: int):
    """Distinct texts of a slab with their shared shingles and rare-first prefixes."""

    def run(texts: pa.Table, back: pa.Table) -> pa.Table:
        info = {r["part"]: r["keys"] for r in back.select(["part", "keys"]).to_pylist() if r["keys"] is not None}
        chosen = [p for p in back.column("places").to_pylist() if p is not None]
        rows = _texts(texts)
        picked = [rows[i][1] for i in np.frombuffer(chosen[0], np.uint32).tolist()] if chosen else []
        found = shingles.sets(picked, width)
        keys, order = _keyed(found, parts)
        rare = np.empty(len(keys), np.uint8)
        rare[order] = np.frombuffer(b"".join(info[r] for r in sorted(info)), np.uint8)
        alone, prefix, bits, items, at = [], [], [], [], 0
        for hashes in found:
            own = rare[at:at + len(hashes)]
            at += len(hashes)
            n, shared = len(hashes), own > 1
            single = n - int(np.count_nonzero(shared))
            length = n - least_share(n, percent) + 1 - single
            alone.append(single)
            if n and length > 0:
                hashes, own = hashes[shared], own[shared]
                prefix.append(hashes[np.argsort(own, kind="stable")[:length]].view(np.int64))
                bits.append(parity(hashes))
                items.append(hashes.tobytes())
            else:
                prefix.append(None)
                bits.append(None)
                items.append(None)
        return pa.table({"mark": pa.array(map(_mark, picked), pa.binary()), "n": pa.array(map(len, found), pa.int32()), "alone": pa.array(alone, pa.int32()),
                         "prefix": pa.array(prefix, pa.list_(pa.int64())), "bits": pa.array(bits, pa.list_(pa.int64())), "items": pa.array(items, pa.binary())})

    return run


def shared_sets(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = shingles.WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row per distinct text: its mark, the size of its set, shingles of its own, and, where a partner is possible, prefix and shared shingles."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    slabs = max(1, -(-total // SLAB_BYTES))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) * RANGES_PER_PARTITION
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.pmod(F.xxhash64(doc_id, text), F.lit(slabs)).alias("slab"), F.col(doc_id).cast("long").alias("doc_id"), body.alias("text"))
    texts = rows.groupBy("slab")
    # One row of each text goes on; the choice moves ids and marks only.
    first = rows.select("slab", "doc_id", mark_of(F.col("text")).alias("mark")).groupBy("mark").agg(F.min(F.struct("slab", "doc_id")).alias("f"))
    first = first.select("f.slab", "f.doc_id", "mark")
    sent = texts.cogroup(first.groupBy("slab")).applyInArrow(_send(parts, width), _ROWS)
    counted = sent.groupBy("part").applyInArrow(_count, _ROWS)
    return texts.cogroup(counted.groupBy("slab")).applyInArrow(_order(parts, width, percent), _DOC)


def mark_of(text: Column) -> Column:
    """128-bit mark of a text."""
    return F.unhex(F.md5(text.cast("binary")))


FACTS = ["mark", "n", "alone", "rest", *[f"bits{k}" for k in range(WORDS_OF_BITS)]]


def _may_link(percent: int) -> Column:
    """Length filter, positional filter with the shingles left after the shared one, and the least difference of the sets."""
    n, m = F.col("n"), F.col("n2")
    fits = F.least(n, m) * 100 >= F.greatest(n, m) * percent
    reach = (1 + F.least("rest", "rest2")) * (100 + percent) >= (n + m) * percent
    apart = F.col("alone") + F.col("alone2")
    for k in range(WORDS_OF_BITS):
        apart = apart + F.bit_count(F.col(f"bits{k}").bitwiseXOR(F.col(f"bits{k}2")))
    return fits & reach & ((n + m) * (100 - percent) >= apart * (100 + percent))


def _far(x: np.ndarray, y: np.ndarray, most: int, depth: int) -> int:
    """A lower bound of the symmetric difference of two sorted arrays, by halving."""
    if depth == 0 or not len(x) or not len(y):
        return abs(len(x) - len(y))
    middle = y[len(y) // 2]
    cut_x, cut_y = np.searchsorted(x, middle), len(y) // 2
    sides = abs(int(cut_x) - cut_y), abs(len(x) - int(cut_x) - len(y) + cut_y)
    if sum(sides) > most:
        return sum(sides)
    left = _far(x[:cut_x], y[:cut_y], most - sides[1], depth - 1)
    return left + (_far(x[cut_x:], y[cut_y:], most - left, depth - 1) if left + sides[1] <= most else sides[1])


def _verify(percent: int):
    """Keeps the pairs of a batch whose sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y, n, m, one, other in zip(*(batch.column(c).to_pylist() for c in ("x", "y", "n", "m", "alone_x", "alone_y"))):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                need = -(-percent * (n + m) // (100 + percent))
                most = n + m - 2 * need - one - other
                linked.append(most >= 0 and _far(x, y, most, SUFFIX_DEPTH) <= most and len(np.intersect1d(x, y, assume_unique=True)) >= need)
            yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return run


def verified(pairs: DataFrame, classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (``a``, ``b``) of classes whose sets reach the threshold."""
    side = lambda a, n, alone, x: classes.select(F.col("mark").alias(a), F.col("n").alias(n), F.col("alone").alias(alone), F.col("items").alias(x))
    both = pairs.join(side("a", "n", "alone_x", "x"), "a").join(side("b", "m", "alone_y", "y"), "b")
    return both.mapInArrow(_verify(percent), "a binary, b binary")


def _pairs(joined: DataFrame) -> DataFrame:
    """Each pair of classes once."""
    return joined.select(F.least("mark", "mark2").alias("a"), F.greatest("mark", "mark2").alias("b")).distinct()


def _second(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{c}2") for c in df.columns])


def links(classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Verified links that connect every two classes which a chain of links connects."""
    rows = classes.select("mark", "n", F.posexplode("prefix").alias("at", "shingle"), "alone", *[F.col("bits")[k].alias(f"bits{k}") for k in range(WORDS_OF_BITS)])
    rows = cut(rows.select("shingle", *[(F.col("n") - F.col("alone") - F.col("at") - 1).alias("rest") if c == "rest" else c for c in FACTS]))

    pivots = rows.groupBy("shingle").agg(F.min_by(F.struct(*FACTS), F.xxhash64("shingle", "mark")).alias("p"), F.count(F.lit(1)).alias("c"))
    pivots = _second(pivots.where("c > 1").select("shingle", "p.*"))
    met = rows.join(pivots, (F.col("shingle") == F.col("shingle2")) & (F.col("mark") != F.col("mark2")) & _may_link(percent))
    first = cut(verified(_pairs(met), classes, percent))

    open_rows, outside = _open(rows, first)
    # Of the largest component, some classes of each shingle by the hash of class and shingle.
    some = open_rows.where("label = main").groupBy("shingle", F.pmod(F.xxhash64("mark"), F.lit(PIVOTS))).agg(
        F.min_by(F.struct(*FACTS), F.xxhash64("mark", "shingle")).alias("p"))
    met = outside.join(_second(some.select("shingle", "p.*")), (F.col("shingle") == F.col("shingle2")) & _may_link(percent))
    more = cut(first.union(verified(_pairs(met), classes, percent)))

    open_rows, outside = _open(rows, more)
    crossing = outside.join(_second(open_rows), (F.col("shingle") == F.col("shingle2")) & (F.col("label") != F.col("label2")) & _may_link(percent))
    return more.union(cut(verified(_pairs(crossing), classes, percent)))


def _open(rows: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of shingles whose classes lie in several components, and those of them outside the shingle's largest one."""
    labels = cut(components(found, "a", "b"))
    placed = cut(rows.join(labels.withColumnRenamed("node", "mark"), "mark", "left").withColumn("label", F.coalesce("label", "mark")))
    sizes = placed.groupBy("shingle", "label").agg(F.count(F.lit(1)).alias("c"))
    main = sizes.groupBy("shingle").agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.count(F.lit(1)).alias("labels")).where("labels > 1")
    open_rows = cut(placed.join(main, "shingle"))
    return open_rows, open_rows.where("label <> main")


def join(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = shingles.WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row per input row: ``doc_id``, ``n`` shingles, ``mark`` of its text, ``component_id`` and the component's own ``label``.

    The label tells components apart; ids do not where they are null or stand on unlike texts.
    """
    found = cut(shared_sets(docs, text, doc_id, width, percent))
    labels = components(links(found.where("prefix is not null"), percent), "a", "b").select(F.col("node").alias("_node"), "label")
    texts = found.select(F.col("mark").alias("_mark"), "n").join(labels, F.col("_mark") == F.col("_node"), "left").select(
        "_mark", "n", F.coalesce("label", "_mark").alias("label"))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), mark_of(F.coalesce(F.col(text), F.lit(""))).alias("mark"))
    rows = rows.join(texts, F.col("mark") == F.col("_mark")).drop("_mark")
    least = rows.where("n > 0").groupBy("label").agg(F.min("doc_id").alias("_least")).select(F.col("label").alias("_label"), "_least")
    return rows.join(least, (F.col("label") == F.col("_label")) & (F.col("n") > 0), "left").select(
        "doc_id", "n", "mark", F.coalesce("_least", "doc_id").alias("component_id"), "label")


def representatives(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = shingles.WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row of each component, the one with the least id; the columns are those of the input.

    Rows without shingles all stay. Of rows with equal id in one component (repeated
    rows, or null ids) the one with the least text mark stays, and one of equal ones.
    Components are told apart by their label, so unlike texts with null or equal ids all stay.
    """
    found = join(docs, text, doc_id, width, percent)
    best = found.where("n > 0").groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("b"))
    keys = lambda x, mark: [F.coalesce(x, F.lit(0)).alias("_key"), x.isNull().alias("_none"), mark.alias("_mark")]
    keep = best.select(*keys(F.col("b.doc_id"), F.col("b.mark"))).distinct().withColumn("_keep", F.lit(True))
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.struct("*").alias("_row"), *keys(F.col(doc_id).cast("long"), mark_of(body)), (~body.rlike(r"[^ \t-\r]")).alias("_empty"))
    # Join and window need the same partitioning, so texts move once.
    turn = Window.partitionBy("_key", "_none", "_mark").orderBy("_empty")
    rows = rows.join(keep, ["_key", "_none", "_mark"], "left").withColumn("_turn", F.row_number().over(turn))
    return rows.where(F.col("_empty") | (F.col("_keep") & (F.col("_turn") == 1))).select("_row.*")
