"""Quality rules: word and line counts of a text, and line frequency across documents.

``measure`` counts inside each text: words, characters of words, symbols, lines
equal to an earlier one, and words in repeated windows of eight. Windows are
compared exactly: numbers of words are paired to numbers of two, four and eight
words by sorting.

``frequent_lines`` hashes each normalised line (lower case, digits as 0, single
blanks) and counts, per host, the different texts that hold it. Copies of a
text count once, so being copied does not turn a document into boilerplate. A
line is removed on hosts where it is in more than ``MAX_TEXTS`` texts, and a
document that keeps less than ``MIN_LEFT`` of its words is depleted.

Rows are counted first by slots of line hashes, one partial sum a task and slot.
Only lines of slots with more than ``MAX_TEXTS`` rows can be frequent, so only they are
counted exactly, by (host, line, text) and then by (host, line) with partial sums, and
looked up again; others never leave their task. Texts are never shuffled.

Defined results: a null text has no words and lines; a null host is a host of
its own; repeated rows count once and each gets the verdict; lines without a
word are never counted; a document without words is not depleted (the base
rules decide).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType

from quillspark.llm.batches import map_texts

SYMBOLS = "#*$%&|<>"
WINDOW = 8
MAX_TEXTS = 40
MIN_LEFT = 0.3
#: Slots of line hashes, of which 64 share a number; beyond some billion lines most slots are crowded and all lines are counted exactly.
SLOTS = 1 << 26
SPACES = r"[ \t-\r]+"
WORD = r"[^ \t-\r]+"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(words: list[bytes]) -> int:
    """Words covered by windows of eight words that occur at least twice."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    width = 1
    while width < WINDOW:
        # Both numbers are below the count of words, so their pair fits.
        ids = np.unique(ids[:-width] * len(words) + ids[width:], return_inverse=True)[1]
        if width * 2 < WINDOW and ids.max() + 1 == len(ids):
            return 0
        width *= 2
    twice = np.bincount(ids)[ids] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + WINDOW, -1)
    return int(np.count_nonzero(np.cumsum(edge)))


def count(text: str | None) -> tuple[int, int, int, int, int]:
    text = text or ""
    words = text.encode("utf-8").split()
    spaces = sum(map(text.count, " \t\n\v\f\r"))
    lines = [line for line in text.split("\n") if line.encode("utf-8").strip()]
    return (len(words), len(text) - spaces, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words))


def measure(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The kept columns with the counts of each text."""
    return map_texts(docs, keep, lambda: lambda texts: list(zip(*map(count, texts))), [(c, LongType()) for c in COUNTS], text)


def normalised(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), "[0-9]", "0"), SPACES, " "))


def line_table(docs: DataFrame, text: str, host: str, doc_id: str) -> DataFrame:
    """One row per document and line with a word: id, host, text hash, words of the text, place, line hash and words."""
    lines = docs.select(F.col(doc_id).alias("_id"), F.col(host).alias("_host"), F.xxhash64(F.col(text)).alias("_text"),
                        F.regexp_count(F.col(text), F.lit(WORD)).alias("_all"), F.posexplode(F.split(F.col(text), "\n")).alias("_place", "_raw"))
    lines = lines.withColumn("_line", normalised("_raw")).where(F.col("_line") != "")
    return lines.select("_id", "_host", "_text", "_all", "_place", F.xxhash64("_line").alias("_hash"), F.xxhash64(F.lit(1), "_line").alias("_hash2"),
                        (F.length("_line") - F.length(F.replace("_line", F.lit(" "), F.lit(""))) + 1).alias("_words"))


def crowded(lines: DataFrame, max_texts: int = MAX_TEXTS) -> DataFrame:
    """The rows of lines whose slot has more than ``max_texts`` rows: every line of more than ``max_texts`` texts is among them."""
    slot = F.xxhash64("_host", "_hash").bitwiseAND(F.lit(SLOTS - 1))
    full = lines.groupBy(slot.alias("_slot")).agg(F.count("*").alias("_rows")).where(F.col("_rows") > max_texts)
    bits = full.groupBy(F.shiftright("_slot", 6).alias("_at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(_slot & 63 as int))")).alias("_bits"))
    placed = lines.withColumn("_slot", slot)
    hit = (F.shiftright("_slot", 6) == F.col("_at")) & F.expr("(_bits >>> cast(_slot & 63 as int)) & 1 = 1")
    return placed.join(F.broadcast(bits), hit).select(*lines.columns)


def frequent_lines(lines: DataFrame, max_texts: int = MAX_TEXTS) -> DataFrame:
    """Lines in more than ``max_texts`` different texts of a host."""
    return lines.groupBy("_host", "_hash", "_hash2").agg(F.countDistinct("_text").alias("_texts")).where(F.col("_texts") > max_texts)


def depletion(docs: DataFrame, text: str = "text", host: str = "source", doc_id: str = "doc_id",
              max_texts: int = MAX_TEXTS) -> DataFrame:
    """Share of its words that each document keeps (``left``); only documents that lose a line are listed.

    Keys are ``_id``, ``_host`` and ``_text`` (hash of the text); repeated rows are one key and have one share.
    """
    lines = crowded(line_table(docs, text, host, doc_id), max_texts)
    frequent = frequent_lines(lines, max_texts)
    lost = lines.join(
        frequent.select(F.col("_host").alias("_fhost"), F.col("_hash").alias("_fhash"), F.col("_hash2").alias("_fhash2")),
        F.col("_host").eqNullSafe(F.col("_fhost")) & (F.col("_hash") == F.col("_fhash")) & (F.col("_hash2") == F.col("_fhash2")))
    # A repeated row has the same places.
    held = lost.groupBy("_id", "_host", "_text", "_all").agg(F.collect_set(F.struct("_place", "_words")).alias("_lines"))
    words = F.aggregate("_lines", F.lit(0).cast("long"), lambda n, line: n + line["_words"])
    return held.select("_id", "_host", "_text", (1 - words / F.col("_all")).alias("left"))
