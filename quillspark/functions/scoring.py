"""Relevance, confidence and answer decisions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from quillspark.functions import text as tx

# Thresholds of library-wide answering.
MIN_MERGED_SCORE = 0.006
MIN_TOP_SCORE = 0.008
EXTRACTIVE_SCORE = 0.06
MIN_RELEVANCE = 0.5
MERGE_POOL = 20
MMR_LIMIT = 3
ASK_CONTEXT_TOKENS = 800
NOT_FOUND = "Not found in your documents"
NO_RELEVANT = "No relevant content found in your documents"


def unit(value: Column, top: float) -> Column:
    """Clamp ``value / top`` to [0, 1]."""
    return F.least(F.greatest(value / top, F.lit(0.0)), F.lit(1.0))


def keyword_boost(hits: Column) -> Column:
    return F.least(hits * 0.04, F.lit(0.2))


def keyword_coverage(hits: Column, keys: Column) -> Column:
    return F.when(F.size(keys) == 0, 0.0).otherwise(hits / F.greatest(F.size(keys), F.lit(1)))


def phrase_hit(keys: Column, text: Column) -> Column:
    phrase = F.array_join(F.slice(keys, 1, 3), " ")
    return (phrase != "") & F.lower(text).contains(phrase)


def relevance(score: Column, hits: Column, keys: Column, text: Column) -> Column:
    scaled = F.least(score * 20.0, F.lit(1.0))
    blended = (keyword_coverage(hits, keys) * 0.5 + scaled * 0.2
               + F.when(phrase_hit(keys, text), 0.3).otherwise(0.0))
    return F.when(F.size(keys) == 0, scaled).otherwise(blended)


def relevance_gate(qtype: Column, has_keywords: Column) -> Column:
    return (
        F.when((qtype == "explanation") & ~has_keywords, 0.35)
        .when(qtype == "explanation", 0.45)
        .otherwise(0.55)
    )


def library_weights(query: Column, qtype: Column) -> tuple[Column, Column]:
    """Vector and keyword weight of a library question."""
    short = (qtype != "explanation") & (F.size(tx.unicode_words(query)) <= 5)
    return F.when(short, 0.3).otherwise(0.6), F.when(short, 0.7).otherwise(0.4)


def confidence(top: Column, average: Column, count: Column, rerank: Column, model: Column,
               factor: Column) -> Column:
    """Calibrated confidence; ``top`` is null when nothing was retrieved."""
    base = unit(top, 0.1)
    retrieval = F.when((count >= 3) & (average > 0.03), F.least(base + 0.1, F.lit(1.0))).otherwise(base)
    reranked = F.when(rerank > 0, unit(rerank, 10.0)).otherwise(0.5)
    stated = F.when(model == "high", 0.9).when(model == "medium", 0.6).when(model == "low", 0.3).otherwise(0.5)
    score = F.round(F.least(F.greatest((retrieval * 0.5 + reranked * 0.3 + stated * 0.2) * factor, F.lit(0.0)),
                            F.lit(1.0)), 3)
    return F.when(top.isNull(), 0.05).otherwise(score)


def confidence_level(score: Column) -> Column:
    return F.when(score >= 0.7, "high").when(score >= 0.4, "medium").otherwise("low")


def calibration_band(score: Column) -> Column:
    return F.when(score > 0.8, "high").when(score > 0.5, "medium").otherwise("low")


def falls_back(score: Column) -> Column:
    return score < 0.5


def is_simple_question(query: Column) -> Column:
    q = F.lower(tx.strip(query))
    opener = F.regexp_like(q, F.lit(r"(?U)^(what is|what are|define|definition of|meaning of|who is)\b"))
    return opener | ((tx.word_count(q) <= 6) & (F.length(q) < 80))


def needs_model(top: Column, query: Column, qtype: Column, keys: Column) -> Column:
    """Whether a question goes to the answer model rather than to extraction."""
    return (
        top.isNull()
        | (qtype == "explanation")
        | ((qtype == "definition") & (F.size(keys) >= 2))
        | (top < EXTRACTIVE_SCORE)
        | ~is_simple_question(query)
    )


def extractive_answer(text: Column) -> Column:
    body = F.array_join(F.slice(tx.sentences(tx.strip(text)), 1, 3), " ")
    cut = F.when(F.length(body) > 900, F.concat(F.substring(body, 1, 897), F.lit("..."))).otherwise(body)
    return F.coalesce(F.nullif(cut, F.lit("")), F.lit(NOT_FOUND))


def answer_status(n_chunks: Column, best_relevance: Column, top: Column, top_relevance: Column, gate: Column,
                  keys: Column, words: Column, qtype: Column, bm25_rank: Column) -> Column:
    """``not_found``, ``no_relevant`` or ``ok`` for a question's final context."""
    refused = F.when(F.size(keys) > 0, "no_relevant").otherwise("not_found")
    short_without_keyword_hit = (
        (words <= 5) & (F.size(keys) > 0) & (qtype != "explanation") & bm25_rank.isNull()
    )
    return (
        F.when(n_chunks == 0, "not_found")
        .when(best_relevance < gate, refused)
        .when((top < MIN_TOP_SCORE) | (top_relevance < gate) | short_without_keyword_hit, refused)
        .otherwise("ok")
    )
