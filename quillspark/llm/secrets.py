"""Secret scans with native expressions: fixed patterns and character Markov models.

Patterns find assignments, access keys and hexadecimal runs. Other long tokens
are compared under two Markov models of adjacent characters, one of random
strings and one of ordinary identifiers; a token whose log-likelihood ratio
reaches ``MIN_RATIO`` is a span of kind ``markov``. The models are counted from
labelled samples: values that the patterns found are random strings, tokens of
texts without any are ordinary. The sample is bounded by ``SAMPLE_DOCS`` documents
per label, by hash of the text, and ``SAMPLE_TOKENS`` tokens of ``TOKEN_CHARS``
characters; the driver receives one count per label and pair of characters.

Positions come from splitting a text at its matches and adding lengths up in
two levels, so the work grows little faster than the matches of a text. All of
it is expressions over one row; nothing is shuffled but the sample.

Defined results: a null text is empty and has no span; positions are code points
with exclusive ends; matches of one kind do not overlap; a markov span never
overlaps another span; repeated rows are scanned alike; without a sample both
models are uniform and add nothing; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from quillspark.functions.text import bind
from quillspark.operators.ordered import top_k

# The base patterns and their least lengths.
KEYWORDS = "(?i:password|passwd|secret|token|api_?key)"
ASSIGN = f"({KEYWORDS})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
MIN_VALUE = 6

KINDS = ("assign", "access", "hex", "markov")
MIN_TOKEN = 20
TOKEN = f"[A-Za-z0-9+/_=-]{{{MIN_TOKEN},}}"
# An assignment first, so that its value is never a token of its own.
TOKEN_APART = f"{ASSIGN}|({TOKEN})"
COVERED = f"{ACCESS}|{HEX}|{ASSIGN}|{KEYWORDS}$"

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."
SAMPLE_DOCS = 2000
SAMPLE_TOKENS = 20000
TOKEN_CHARS = 200
MIN_RATIO = 6.0
PRIOR = 16
BLOCK = 256


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, b: a + b)


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """All matches of a pattern: start, end and the wanted group."""
    found = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"),
                     F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("values"))

    def placed(f: Column) -> Column:
        # Split also returns what follows the last match.
        steps = F.zip_with(F.slice(f["gaps"], 1, F.size(f["hits"])), f["hits"], lambda gap, hit: F.length(gap) + F.length(hit))
        return bind(steps, lambda s: bind(
            F.transform(F.sequence(F.lit(0), F.floor(F.size(s) / BLOCK).cast("int")), lambda b: _sum(F.slice(s, b * BLOCK + 1, BLOCK))),
            lambda blocks: F.transform(f["hits"], lambda hit, i: bind(
                _sum(F.slice(blocks, 1, F.floor(i / BLOCK).cast("int"))) + _sum(F.slice(s, (F.floor(i / BLOCK) * BLOCK).cast("int") + 1, i % BLOCK + 1)),
                lambda end: F.struct((end - F.length(hit)).alias("start"), end.alias("end"), F.get(f["values"], i).alias("value"))))))

    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    return F.when(text.rlike(pattern), bind(found, placed)).otherwise(none)


def _pairs(token: Column, use) -> Column:
    """``use`` of the codes of adjacent characters."""
    code = {ord(c): i for i, c in enumerate(ALPHABET)}
    codes = F.array(*[F.lit(code.get(i, len(ALPHABET) - 1)) for i in range(128)])
    chars = F.filter(F.split(token, ""), lambda c: c != "")
    return bind(F.transform(chars, lambda c: F.get(codes, F.ascii(c))), lambda found: F.zip_with(
        F.slice(found, 1, F.size(found) - 1), F.slice(found, 2, F.size(found) - 1), use))


def learn(docs: DataFrame, text: str = "text") -> list[float]:
    """Log-likelihood ratio of every pair of characters, random over ordinary."""
    texts = docs.select(F.coalesce(text, F.lit("")).alias("_text")).withColumn("_random", F.col("_text").rlike(f"{ASSIGN}|{ACCESS}|{HEX}"))
    hashed = texts.select("_random", "_text", F.xxhash64("_text").alias("_hash"))
    # Hashes are ranked first; only the chosen texts are read on.
    chosen = top_k(hashed.select("_random", "_hash").distinct(), ["_random"], [F.col("_hash")], SAMPLE_DOCS, "_rank")
    sample = hashed.join(F.broadcast(chosen.select("_random", "_hash")), ["_random", "_hash"], "left_semi").select("_random", "_text").distinct()
    random = F.filter(F.concat(F.regexp_extract_all("_text", F.lit(ASSIGN), F.lit(2)), F.regexp_extract_all("_text", F.lit(ACCESS), F.lit(0)),
                               F.regexp_extract_all("_text", F.lit(HEX), F.lit(0))), lambda v: F.length(v) >= MIN_TOKEN)
    ordinary = F.regexp_extract_all("_text", F.lit("[A-Za-z0-9+/_=-]{4,}"), F.lit(0))
    tokens = sample.select("_random", F.explode(F.when(F.col("_random"), random).otherwise(ordinary)).alias("_token"))
    tokens = tokens.select("_random", F.substring("_token", 1, TOKEN_CHARS).alias("_token")).distinct()
    tokens = top_k(tokens, ["_random"], [F.xxhash64("_token"), F.col("_token")], SAMPLE_TOKENS, "_rank")
    size = len(ALPHABET)
    counts = tokens.select("_random", F.explode(_pairs(F.col("_token"), lambda a, b: a * size + b)).alias("_pair")).groupBy("_random", "_pair").count().collect()
    tables = {True: [0] * size * size, False: [0] * size * size}
    for row in counts:
        tables[row["_random"]][row["_pair"]] = row["count"]
    found = {k: _chances(t, size) for k, t in tables.items()}
    return [math.log(p) - math.log(q) for p, q in zip(found[True], found[False])]


def _chances(pairs: list[int], size: int) -> list[float]:
    """Chance of each second character after each first one; rare first ones lean on the characters' own chances."""
    after = [sum(pairs[a * size:(a + 1) * size]) for a in range(size)]
    total = sum(after) + size
    alone = [(sum(pairs[b::size]) + 1) / total for b in range(size)]
    return [(pairs[a * size + b] + PRIOR * alone[b]) / (after[a] + PRIOR) for a in range(size) for b in range(size)]


def ratio(token: Column, model: list[float]) -> Column:
    """Log-likelihood ratio of a token's characters."""
    table = F.array(*[F.lit(x) for x in model])
    return F.aggregate(_pairs(token, lambda a, b: F.get(table, a * len(ALPHABET) + b)), F.lit(0.0), lambda x, y: x + y)


def base_spans(text: Column) -> dict[str, Column]:
    """Spans of the fixed patterns by kind."""
    return {"assign": F.filter(matches(text, ASSIGN, 2), lambda m: F.length(m["value"]) >= MIN_VALUE), "access": matches(text, ACCESS), "hex": matches(text, HEX)}


def markov_spans(text: Column, model: list[float], min_ratio: float = MIN_RATIO) -> Column:
    """Tokens outside every base span that look random."""
    return F.filter(matches(text, TOKEN_APART, 3), lambda m: (m["value"] != "") & ~m["value"].rlike(COVERED) & (ratio(m["value"], model) >= min_ratio))


def scan(docs: DataFrame, model: list[float], keep: list[str], text: str = "text") -> DataFrame:
    """The kept columns and ``found``: all spans (start, rank, kind, end) in order."""
    body = F.coalesce(F.col(text), F.lit(""))
    spans = {**base_spans(body), "markov": markov_spans(body, model)}

    def of_kind(kind: str) -> Column:
        return F.transform(spans[kind], lambda m: F.struct(
            m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind).alias("kind"), m["end"].alias("end")))

    return docs.select(*keep, F.sort_array(F.concat(*map(of_kind, KINDS))).alias("found"))


def listed(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
