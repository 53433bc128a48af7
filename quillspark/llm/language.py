"""Language identification by compression.

Each language gets a zstandard raw-content dictionary of sampled training lines.
A text is lower-cased, reduced to its letters and blanks, cut into pieces and
compressed with every dictionary; the smallest total wins. The margin is the
share by which the runner-up is larger, and a text whose margin is narrow is
rejected. Pieces keep a long text from becoming its own dictionary, so margins
mean the same at every length; all pieces count. Texts that tie, mostly of a few
words, are compressed once more with a deeper search.

Learning takes a bounded sample of labelled rows: ``SAMPLE_DOCS`` documents per
language by the hash of their id, of these ``SAMPLE_LINES`` distinct lines by
hash, ``LINE_CHARS`` characters of each, ``DICTIONARY_BYTES`` in all. The driver
holds one dictionary per language.

Defined results: a null text, a text without a letter, and any text where
nothing was learned are ``und`` with score 0 and rejected; with one learned
language the margin is 1; equal sizes go to the first language by name and are
rejected. A null id is not held out. Rows are judged one by one, so repeated
rows, ties and other columns do not matter.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import zstandard
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType

from quillspark.llm.batches import map_texts
from quillspark.operators.ordered import top_k

SAMPLE_DOCS = 400
SAMPLE_LINES = 400
LINE_CHARS = 400
DICTIONARY_BYTES = 32 << 10
PIECE_BYTES = 4 << 10
MIN_MARGIN = 0.005
UNKNOWN = "und"

NOT_LETTERS = re.compile(r"[\W\d_]+")


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a row is kept from learning: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def letters(text: str | None) -> bytes:
    """Lower-case letters with single blanks between and around the words; empty without a letter."""
    words = NOT_LETTERS.sub(" ", (text or "").lower()).strip()
    return f" {words} ".encode() if any(map(str.isalpha, words)) else b""


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> dict[str, bytes]:
    """One dictionary per language from the documents that are not held out."""
    known = docs.select(F.col(lang).alias("_lang"), F.xxhash64(text).alias("_key"), F.col(text).alias("_text")).where(
        F.col("_lang").isNotNull() & F.col("_text").isNotNull() & ~held_out(doc_id))
    # Sampled by the text's own hash, so that ids decide nothing but the fold; equal texts count once.
    chosen = top_k(known.select("_lang", "_key").distinct(), ["_lang"], [F.col("_key")], SAMPLE_DOCS, "_rank")
    # At most SAMPLE_DOCS keys per language.
    texts = known.join(F.broadcast(chosen), ["_lang", "_key"], "left_semi")
    lines = texts.select("_lang", F.explode(F.split("_text", "\n")).alias("_line")).select("_lang", F.substring("_line", 1, LINE_CHARS).alias("_line")).distinct()
    best = top_k(lines, ["_lang"], [F.xxhash64("_line"), F.col("_line")], SAMPLE_LINES, "_rank")
    parts: dict[str, list[bytes]] = {}
    for row in sorted(best.collect()):
        parts.setdefault(row["_lang"], []).append(letters(row["_line"]))
    return {name: b"".join(found)[:DICTIONARY_BYTES] for name, found in sorted(parts.items())}


def _compressors(dictionaries: dict[str, bytes], **search: int) -> dict:
    settings = zstandard.ZstdCompressionParameters(window_log=16, write_content_size=False, write_checksum=False, write_dict_id=False, **search)
    return {name: zstandard.ZstdCompressor(
        dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if content else None,
        compression_params=settings).compress for name, content in dictionaries.items()}


class Classifier:
    """Compressors of one task: fast ones, and ones with a deeper search and shorter matches for what they leave tied."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.fast = _compressors(dictionaries, chain_log=14, hash_log=14, search_log=4, min_match=5, strategy=zstandard.STRATEGY_LAZY)
        self.fine = _compressors(dictionaries, chain_log=16, hash_log=16, search_log=6, min_match=3, strategy=zstandard.STRATEGY_BTLAZY2)

    def judge(self, text: str | None) -> tuple[str, float]:
        content = letters(text)
        if not content or not self.fast:
            return UNKNOWN, 0.0
        pieces = [content[i:i + PIECE_BYTES] for i in range(0, len(content), PIECE_BYTES)]
        for compressors in (self.fast, self.fine):
            sizes = sorted((sum(len(compress(p)) for p in pieces), name) for name, compress in compressors.items())
            if len(sizes) == 1 or sizes[0][0] < sizes[1][0]:
                break
        return sizes[0][1], 1 - sizes[0][0] / sizes[1][0] if len(sizes) > 1 else 1.0


def classify(docs: DataFrame, dictionaries: dict[str, bytes], keep: Sequence[str], text: str = "text",
             min_margin: float = MIN_MARGIN, names: tuple[str, str, str] = ("lang_pred", "score", "rejected")) -> DataFrame:
    """The kept columns with the language, its margin and whether the margin is too narrow."""

    def make():
        judge = Classifier(dictionaries).judge

        def work(texts):
            found = [judge(t) for t in texts]
            return [n for n, _ in found], [s for _, s in found], [n == UNKNOWN or s < min_margin for n, s in found]

        return work

    return map_texts(docs, keep, make, list(zip(names, (StringType(), DoubleType(), BooleanType()))), text)
