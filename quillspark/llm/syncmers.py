"""Document fingerprints from closed syncmers, with native expressions.

The units of a text are its words; a word of ``LONG_WORD`` code points and more (in
scripts without blanks) gives one unit per pair of adjacent code points instead, which
depends on that word alone. A window of ``WORDS`` units is an anchor if its least unit
hash is the first or the last one. Whether it is one depends on the window alone, so
equal passages have equal anchors at equal distances whatever stands around them. Four
greatest hashes stand before and after the text: the window that ends with its first
unit and the one that begins with its last are always anchors, so every text with a
word has some, and short texts share those of a common start or end. The fingerprint is
the list of anchors in text order; places are kept beside them for positional matching
(``shift``). Likeness is the Dice share of the anchors that two texts have in common.

Defined results: words are runs without blanks and controls 9 to 13; a text without
words has no anchor; places count units and are negative for windows that begin before
the text; two texts without anchors are alike by 1, one without by 0; repeated anchors
count once; equal texts have equal fingerprints.

``following`` gives every row its next row by id without sorting the table in
one task: rows meet in short id buckets, and the last of a bucket takes the
first of the next bucket that has rows. Null ids come first, ties go by the hash
of the text, and the last row is followed by the first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillspark.functions.text import bind
from quillspark.operators.ordered import last_before

WORDS = 5
LONG_WORD = 20
BUCKET_BITS = 6
SPACES = r"[ \t-\r]+"


#: Stands before and after a text.
EDGE = 2**31 - 1


def units(words: Column) -> Column:
    """Hashes of the words, or of the pairs of code points of long ones, below ``EDGE``."""
    below = lambda h: F.least(h, F.lit(EDGE - 1))

    def pairs(word: Column) -> Column:
        chars = F.filter(F.split(word, ""), lambda c: c != "")
        return bind(chars, lambda c: F.transform(F.sequence(F.lit(0), F.size(c) - 2), lambda i: below(F.hash(F.get(c, i), F.get(c, i + 1)))))

    plain = F.transform(words, lambda w: below(F.hash(w)))
    mixed = F.flatten(F.transform(words, lambda w: F.when(F.length(w) < LONG_WORD, F.array(below(F.hash(w)))).otherwise(pairs(w))))
    # The same list; most texts have no long word and need no list per word.
    return F.when(F.exists(words, lambda w: F.length(w) >= LONG_WORD), mixed).otherwise(plain)


def anchors(text: Column) -> Column:
    """Places (in units) and 32-bit hashes of the closed syncmers of a text."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")
    edge = F.array_repeat(F.lit(EDGE), WORDS - 1)

    def closed(h: Column) -> Column:
        at = lambda i, k: F.get(h, i + k)
        every = F.sequence(F.lit(0), F.size(h) - WORDS)
        windows = F.filter(every, lambda i: F.least(at(i, 0), at(i, WORDS - 1)) <= F.least(*[at(i, k) for k in range(1, WORDS - 1)]))
        return F.transform(windows, lambda i: F.struct((i - (WORDS - 1)).alias("place"), F.hash(*[at(i, k) for k in range(WORDS)]).alias("hash")))

    return bind(words, lambda w: F.when(F.size(w) > 0, bind(F.concat(edge, units(w), edge), closed)).otherwise(F.array().cast("array<struct<place:int,hash:int>>")))


def likeness(left: Column, right: Column) -> Column:
    """Dice share of two lists of anchor hashes."""
    return bind(F.struct(F.array_distinct(left).alias("a"), F.array_distinct(right).alias("b")), lambda s: F.when(
        F.size(s["a"]) + F.size(s["b"]) == 0, F.lit(1.0)).otherwise(
        2.0 * F.size(F.array_intersect(s["a"], s["b"])) / (F.size(s["a"]) + F.size(s["b"]))))


def shift(left: Column, right: Column) -> Column:
    """The middle distance in words between the first places of common anchors; null without one."""
    place = lambda found, h: F.get(found["place"], F.array_position(found["hash"], h).cast("int") - 1)
    moved = F.transform(F.array_intersect(left["hash"], right["hash"]), lambda h: place(right, h) - place(left, h))
    return bind(F.sort_array(moved), lambda s: F.get(s, F.floor(F.size(s) / 2).cast("int")))


def fingerprint(anchor_hashes: Column) -> Column:
    """Eight hexadecimal digits per anchor, in text order."""
    return F.array_join(F.transform(anchor_hashes, lambda h: F.right(F.concat(F.lit("00000000"), F.lower(F.hex(h.cast("long")))), F.lit(8))), "")


def following(rows: DataFrame, doc_id: str, text: str, values: list[str]) -> DataFrame:
    """The rows with ``next_<value>`` of the next row by id; no column may start with ``_``."""
    bucket = F.shiftright(F.coalesce(F.col(doc_id), F.lit(-(1 << 63))), BUCKET_BITS)
    order = Window.partitionBy("_bucket").orderBy(F.col(doc_id).asc_nulls_first(), "_tie")
    placed = rows.withColumns({"_tie": F.xxhash64(text), "_bucket": bucket})
    # Both uses below read the same exchange.
    placed = placed.withColumns({"_leads": F.lag(F.lit(True)).over(order).isNull(), "_ends": F.lead(F.lit(True)).over(order).isNull(),
                                 **{f"_n_{v}": F.lead(v).over(order) for v in values}})
    heads = placed.where("_leads").select(F.col("_bucket").alias("_head"), *[F.col(v).alias(f"_h_{v}") for v in values])
    # Buckets, not rows, are put in order; slices of 4096 of them at a time.
    buckets = rows.select((-bucket).alias("_back")).distinct()
    linked = last_before(buckets, [], ["_back"], F.shiftright("_back", 12), {"_next": F.col("_back")})
    lowest = buckets.agg(F.max("_back")).first()[0]
    linked = linked.select((-F.col("_back")).alias("_of"), (-F.coalesce("_next", F.lit(lowest).cast("long"))).alias("_head"))
    after = linked.join(heads, "_head").drop("_head")
    joined = placed.join(after, (F.col("_bucket") == F.col("_of")) & F.col("_ends"), "left")
    return joined.select(*rows.columns, *[F.when(F.col("_ends"), F.col(f"_h_{v}")).otherwise(F.col(f"_n_{v}")).alias(f"next_{v}") for v in values])
