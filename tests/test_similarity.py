"""Matching blocks of short texts against difflib."""

import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from quillspark.functions import similarity


def test_short_texts_have_the_blocks_of_difflib(spark, monkeypatch):
    rng, pairs = random.Random(3), [("", ""), ("a", ""), (None, "a"), ("a" * 30, "b" * 30), ("ab" * 100, "ba" * 110)]
    for letters in ("ab", "abcd", "abcdefghé "):
        pairs += [("".join(rng.choices(letters, k=rng.randrange(1, 22))), "".join(rng.choices(letters, k=rng.randrange(1, 12)))) for _ in range(200)]
    rows = spark.createDataFrame(pairs, "a string, b string")
    found = rows.select("a", "b", similarity.sequence_ratio(0.4)("a", "b").alias("r")).collect()
    ratios = [SequenceMatcher(None, r["a"] or "", r["b"] or "").ratio() for r in found]
    assert [r["r"] for r in found] == [x if x >= 0.4 else 0.0 for x in ratios]
    assert all(similarity.matched(a, b) * 2 / (len(a) + len(b)) == SequenceMatcher(None, a, b).ratio() for a, b in pairs[5:])
