"""Query typing, routing, expansion and rank fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillspark.functions import text as tx
from quillspark.functions.vectors import embedded
from quillspark.operators import dense, lexical

OVER_FETCH = 3

# Query type rules, first match wins.
TYPE_RULES = [
    ("comparison", [r"\bvs\.?\b", r"\bdifference\b", r"\bcompare\b", r"\bcompar", r"\bbetween\b.*\band\b",
                    r"\bversus\b"]),
    ("procedural", [r"\bhow\s+to\b", r"\bsteps?\s+(for|to)\b", r"\bprocess\b", r"\bprocedure\b",
                    r"\bimplementa?t?\b"]),
    ("analytical", [r"\bwhy\b", r"\bhow\s+does\b", r"\bhow\s+is\b", r"\bexplain\b", r"\banalyse\b",
                    r"\banalyze\b", r"\bcause\b", r"\breason\b", r"\bimpact\b", r"\beffect\b", r"\brelation\b"]),
    ("factual", [r"\bwhat\b", r"\bwho\b", r"\bwhen\b", r"\bwhere\b", r"\bwhich\b", r"\bdefine\b",
                 r"\bdefinition\b", r"\bname\b", r"\blist\b", r"\bis\b", r"\bare\b"]),
]

# Wording and weights of the three query variants per type.
VARIANT_WEIGHTS = [0.5, 0.3, 0.2]
VARIANT_TEXTS = {
    "comparison": ["", "Compare and contrast: ", "Similarities and differences of "],
    "procedural": ["", "Steps and process for ", "How to implement "],
    "analytical": ["", "Explain in detail: ", "Why and how: "],
    "factual": ["", "Define and explain ", "Key facts about "],
}
SIMPLE_VARIANTS = [("", 0.6), ("Explain ", 0.2), ("Key points of ", 0.2)]

# Chunks fetched per task; the second table is the older retriever's.
TASK_TOP_K = {"ask": 5, "quiz": 7, "flashcards": 7, "summary": 10, "slides": 7, "mock_test": 10,
              "fun_facts": 5, "mentor": 5}
SIMPLE_TASK_TOP_K = {"ask": 3, "quiz": 5, "flashcards": 5, "summary": 7, "slides": 5, "mock_test": 8,
                     "fun_facts": 3, "mentor": 3}


def query_type(query: Column) -> Column:
    lowered = F.lower(tx.strip(query))
    chosen = None
    for name, patterns in TYPE_RULES:
        # (?U) makes \b and \s follow Unicode letters.
        hit = F.regexp_like(lowered, F.lit("(?U)" + "|".join(patterns)))
        chosen = F.when(hit, name) if chosen is None else chosen.when(hit, name)
    return chosen.when(tx.word_count(lowered) <= 5, "factual").otherwise("analytical")


def query_complexity(query: Column) -> Column:
    n = tx.word_count(query)
    return F.when(n <= 4, "simple").when(n <= 12, "moderate").otherwise("complex")


def route(queries: DataFrame, query: str = "query") -> DataFrame:
    """Add the retrieval strategy of every query as columns."""
    n = tx.word_count(F.col(query))
    typed = queries.withColumn("query_type", query_type(F.col(query))).withColumn("_n", n)
    n = F.col("_n")
    deep = F.col("query_type").isin("comparison", "analytical")
    base_k = F.when(n <= 3, 5).when(n > 12, 10).otherwise(7)
    top_k = F.when(deep, F.greatest(base_k, F.lit(8))).when(
        F.col("query_type") == "procedural", F.greatest(base_k, F.lit(7))).otherwise(base_k)
    return typed.withColumns({
        "complexity": query_complexity(F.col(query)),
        "vector_weight": F.when(n <= 3, 0.3).when(n > 12, 0.7).otherwise(0.5),
        "bm25_weight": F.when(n <= 3, 0.7).when(n > 12, 0.3).otherwise(0.5),
        "top_k": top_k,
        "rrf_k": F.when(n <= 3, 5).when(n > 12, 15).otherwise(10),
        "needs_rerank": (n > 12) | deep,
    }).drop("_n")


def search_mode(query: Column) -> Column:
    n = tx.word_count(query)
    return F.when(n <= 3, "keyword").when(n <= 8, "hybrid").otherwise("ai")


def task_top_k(task: Column, default: Column, table: dict[str, int] = TASK_TOP_K) -> Column:
    lookup = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.element_at(lookup, task), default)


def expand(queries: DataFrame) -> DataFrame:
    """Three weighted variants per query: ``variant, variant_text, weight``."""
    texts = None
    for name, prefixes in VARIANT_TEXTS.items():
        value = F.array(*[F.lit(p) for p in prefixes])
        hit = F.col("query_type") == name
        texts = F.when(hit, value) if texts is None else texts.when(hit, value)
    texts = texts.otherwise(F.array(*[F.lit(p) for p in VARIANT_TEXTS["factual"]]))
    weights = F.array(*[F.lit(w) for w in VARIANT_WEIGHTS])
    return queries.select("*", F.posexplode(texts).alias("variant", "_prefix")).withColumns({
        "variant_text": F.concat("_prefix", "query"),
        "weight": F.element_at(weights, F.col("variant") + 1),
    }).drop("_prefix")


def expand_simple(queries: DataFrame) -> DataFrame:
    items = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(w).alias("w")) for p, w in SIMPLE_VARIANTS])
    return queries.select("*", F.posexplode(items).alias("variant", "_v")).withColumns({
        "variant_text": F.concat("_v.p", "query"), "weight": F.col("_v.w"),
    }).drop("_v")


def queries_top(queries: DataFrame) -> int | None:
    """The largest ``top_k`` of a query set."""
    return queries.agg(F.max("top_k")).first()[0]


def variant_hits(variants: DataFrame, chunks: DataFrame, embedder=None) -> DataFrame:
    """Hits of both searches for every variant, over-fetched by three.

    ``query_id, scope, chunk_id, variant, source, weighted``.
    """
    asked = variants.select(
        F.concat_ws("\x1f", F.col("query_id").cast("string"), F.col("variant").cast("string")).alias("_key"),
        "query_id", "variant", "weight", "variant_text", "top_k")
    keyed = asked.select(F.col("_key").alias("query_id"), F.col("variant_text").alias("query"))
    # The largest wanted list, so that both searches limit each task's rows.
    limit = (queries_top(asked) or 0) + OVER_FETCH

    words = lexical.bm25_top(keyed, chunks, limit)
    vectors = chunks.select("scope", "chunk_id", embedded(F.col("text"), embedder).alias("embedding"))
    asked_vectors = keyed.select("query_id", embedded(F.col("query"), embedder).alias("embedding"))
    near = dense.dense_top(asked_vectors, vectors, limit)

    cols = ["query_id", "scope", "chunk_id", "score", "rank"]
    both = words.select(*cols, F.lit("bm25").alias("source")).unionByName(
        near.select(*cols, F.lit("vector").alias("source")))
    return (
        both.withColumnRenamed("query_id", "_key").join(asked.drop("variant_text"), "_key")
        .where(F.col("rank") <= F.col("top_k") + OVER_FETCH)
        .select("query_id", "scope", "chunk_id", "variant", "source",
                (F.col("score") * F.col("weight")).alias("weighted"))
    )


def fold_replace_or_add(first: Column, second: Column) -> Column:
    """A better score replaces the kept one, a worse one adds 30 % of itself."""
    return (
        F.when(second.isNull(), first)
        .when(first.isNull() | (second > first), second)
        .otherwise(first + second * 0.3)
    )


def fuse_variants(hits: DataFrame) -> DataFrame:
    """One row per (query, scope, chunk) with its vector and keyword score."""
    def vector(i: int) -> Column:
        return F.max(F.when((F.col("source") == "vector") & (F.col("variant") == i), F.col("weighted")))

    grouped = hits.groupBy("query_id", "scope", "chunk_id").agg(
        vector(0).alias("_v0"), vector(1).alias("_v1"), vector(2).alias("_v2"),
        F.max(F.when(F.col("source") == "bm25", F.col("weighted"))).alias("bm25_score"),
        F.max(F.when((F.col("source") == "bm25") & (F.col("variant") == 0), F.col("weighted"))).alias("bm25_plain"),
    )
    folded = fold_replace_or_add(fold_replace_or_add(F.col("_v0"), F.col("_v1")), F.col("_v2"))
    return grouped.select("query_id", "scope", "chunk_id", folded.alias("vector_score"), "bm25_score",
                          F.col("_v0").alias("vector_plain"), "bm25_plain")


def list_rank(score: str) -> Column:
    """Position of a hit in the list ordered by ``score``; null when it is not in it."""
    w = Window.partitionBy("query_id", "scope").orderBy(
        F.desc_nulls_last(F.round(score, lexical.SCORE_PLACES)), F.asc("chunk_id"))
    return F.when(F.col(score).isNotNull(), F.row_number().over(w))


def fusion_ranks(scored: DataFrame, strategy: DataFrame) -> DataFrame:
    """Weighted reciprocal-rank fusion of the two lists of every (query, scope).

    ``strategy(query_id, vector_weight, bm25_weight, rrf_k, top_k)``. The
    groups hold at most 3 x 13 hits of each source.
    """
    ranks = scored.withColumns({"vector_rank": list_rank("vector_score"), "bm25_rank": list_rank("bm25_score")})
    joined = ranks.join(strategy.select("query_id", "vector_weight", "bm25_weight", "rrf_k", "top_k"), "query_id")
    rrf = (
        F.coalesce(F.col("vector_weight") / (F.col("rrf_k") + F.col("vector_rank")), F.lit(0.0))
        + F.coalesce(F.col("bm25_weight") / (F.col("rrf_k") + F.col("bm25_rank")), F.lit(0.0))
    )
    return joined.withColumn("rrf_score", rrf).withColumn("rank", list_rank("rrf_score"))


def rank_fusion(scored: DataFrame, strategy: DataFrame) -> DataFrame:
    """The fused hits within each query's ``top_k``."""
    ranked = fusion_ranks(scored, strategy)
    return ranked.where(F.col("rank") <= F.col("top_k")).select(
        "query_id", "scope", "chunk_id", "rank", "rrf_score", "vector_rank", "bm25_rank", "vector_score", "bm25_score")


def hybrid(routed: DataFrame, chunks: DataFrame, embedder=None) -> DataFrame:
    """Expansion, both searches, variant folding and fusion in one plan.

    ``routed`` carries ``query_id, query, query_type`` and the strategy columns
    of ``route``.
    """
    hits = variant_hits(expand(routed), chunks, embedder)
    return rank_fusion(fuse_variants(hits), routed)


def weighted_sum_retrieval(queries: DataFrame, chunks: DataFrame, k: int, max_tokens: int = 1500,
                           embedder=None) -> DataFrame:
    """The older retriever: three dense variants, summed, cut at the token budget."""
    variants = expand_simple(queries).withColumn(
        "_key", F.concat_ws("\x1f", F.col("query_id").cast("string"), F.col("variant").cast("string")))
    asked = variants.select(F.col("_key").alias("query_id"), embedded(F.col("variant_text"), embedder).alias("embedding"))
    vectors = chunks.select("scope", "chunk_id", embedded(F.col("text"), embedder).alias("embedding"))
    near = dense.dense_top(asked, vectors, k + 2).withColumnRenamed("query_id", "_key")
    merged = near.join(variants.select("_key", "query_id", "weight"), "_key").groupBy(
        "query_id", "scope", "chunk_id").agg(F.sum(F.col("score") * F.col("weight")).alias("score"))
    sized = merged.join(chunks.select("scope", "chunk_id", tx.model_tokens(F.col("text")).alias("tokens")),
                        ["scope", "chunk_id"])
    w = Window.partitionBy("query_id", "scope").orderBy(
        F.desc(F.round("score", lexical.SCORE_PLACES)), F.asc("chunk_id"))
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return sized.withColumn("rank", F.row_number().over(w)).withColumn(
        "total_tokens", F.sum("tokens").over(upto)).where(F.col("total_tokens") <= max_tokens)


def compare_systems(vector_top: DataFrame, hybrid_top: DataFrame) -> DataFrame:
    """Per query: size of both lists, ids in both, ids only the fusion brought."""
    both = vector_top.select("query_id", "scope", "chunk_id", F.lit(1).alias("_v"), F.lit(0).alias("_h")).unionByName(
        hybrid_top.select("query_id", "scope", "chunk_id", F.lit(0).alias("_v"), F.lit(1).alias("_h")))
    per_chunk = both.groupBy("query_id", "scope", "chunk_id").agg(F.max("_v").alias("_v"), F.max("_h").alias("_h"))
    return per_chunk.groupBy("query_id", "scope").agg(
        F.sum("_v").alias("vector_hits"), F.sum("_h").alias("hybrid_hits"),
        F.sum(F.col("_v") * F.col("_h")).alias("overlap"),
        F.sum((1 - F.col("_v")) * F.col("_h")).alias("bm25_unique"),
    )


def ask_gate(hits: DataFrame, queries: DataFrame, min_candidates: int = 5, min_words: int = 4, score_gap: float = 0.01) -> DataFrame:
    """``query_id, scope, n_chunks, gap, reranked``: whether asking would rerank, for enough chunks, a longer question and close first scores."""
    of_rank = lambda r: F.max(F.when(F.col("rank") == r, F.col("rrf_score")))
    groups = hits.groupBy("query_id", "scope").agg(F.count(F.lit(1)).alias("n_chunks"), F.abs(of_rank(1) - of_rank(2)).alias("gap"))
    sized = queries.select("query_id", tx.word_count(F.lower(tx.strip(F.col("query")))).alias("_words"))
    unsure = (F.col("n_chunks") >= min_candidates) & (F.col("_words") >= min_words) & (F.round("gap", 9) <= score_gap)
    return groups.join(sized, "query_id").select("query_id", "scope", "n_chunks", "gap", F.coalesce(unsure, F.lit(False)).alias("reranked"))


def rerank(hits: DataFrame, queries: DataFrame, chunks: DataFrame, min_candidates: int = 5,
           score_gap: float = 0.02, head: int | None = None, chars: int | None = None, scorer=None, embedder=None) -> DataFrame:
    """Rescore the hits (the first ``head``, by their first ``chars`` characters, if given) where the gate says the order is unsure.

    ``hits(query_id, scope, chunk_id, rank, rrf_score)``; adds ``reranked``,
    ``rerank_score`` and ``new_rank``. ``scorer`` is an expression of the
    columns ``query_vector`` and ``chunk_vector``; the default is the cosine
    on a 0–10 scale.
    """
    from quillspark.functions.vectors import dot

    group = Window.partitionBy("query_id", "scope")
    gap = F.abs(F.max(F.when(F.col("rank") == 1, F.col("rrf_score"))).over(group)
                - F.max(F.when(F.col("rank") == 2, F.col("rrf_score"))).over(group))
    gated = hits.withColumn(
        "reranked", (F.count("*").over(group) >= min_candidates) & (F.round(gap, 9) <= score_gap))
    query_vectors = queries.select("query_id", embedded(F.col("query"), embedder).alias("query_vector"))
    scored = (
        gated.join(chunks.select("scope", "chunk_id", tx.head(F.col("text"), chars).alias("_t")), ["scope", "chunk_id"])
        .withColumn("chunk_vector", embedded(F.col("_t"), embedder))
        .join(query_vectors, "query_id")
    )
    value = scorer or F.least(F.greatest(dot(F.col("query_vector"), F.col("chunk_vector")) * 10, F.lit(0.0)), F.lit(10.0))
    in_head = F.col("reranked") if head is None else F.col("reranked") & (F.col("rank") <= head)
    scored = scored.withColumn("rerank_score", F.when(in_head, F.round(value, lexical.SCORE_PLACES)))
    order = [F.desc(F.col("rerank_score").isNotNull()), F.desc_nulls_last("rerank_score"), F.asc("rank")]
    return scored.withColumn("new_rank", F.row_number().over(group.orderBy(*order))).drop(
        "_t", "query_vector", "chunk_vector")
