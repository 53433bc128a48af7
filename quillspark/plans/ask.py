"""Library-wide question answering over a table of questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillspark.functions import scoring as sc, text as tx
from quillspark.operators import diversity, fusion
from quillspark.operators.ordered import last_before
from quillspark.plans.search import with_text, with_vectors

CACHE_VERSION = "v2"


def cache_key(user_id: Column, normalized: Column) -> Column:
    return F.sha2(F.concat_ws("\n", F.lit(CACHE_VERSION), user_id.cast("string"), normalized), 256)


def is_followup(query: Column) -> Column:
    """A bare "explain this" without a subject of its own."""
    pattern = (r"(?i)^(?:pls|please)?\s*(?:can you\s*)?(?:explain|simplify|describe|rephrase)"
               r"(?:\s+this|\s+it)?(?:\s+in\s+detail)?\s*$")
    return F.regexp_like(tx.strip(query), F.lit(pattern))


def resolve_followups(asked: DataFrame, user: str, order: list[str], slice_by: Column, query: str = "query") -> DataFrame:
    """Rewrite a bare follow-up with the user's previous real question."""
    q = tx.strip(F.coalesce(F.col(query), F.lit("")))
    remembered = tx.library_query_type(q) != "explanation"
    prior = last_before(asked, [user], order, slice_by, {"_previous": q}, when=remembered & (q != ""))
    follow = is_followup(F.col(query)) & F.col("_previous").isNotNull()
    rewritten = F.concat(F.lit("Explain this topic from my documents in simple terms: "), F.col("_previous"))
    return prior.withColumn("is_followup", follow).withColumn(
        "resolved", F.when(follow, rewritten).otherwise(q)).drop("_previous")


def split_memoised(asked: DataFrame, results: DataFrame, key: str = "cache_key") -> tuple[DataFrame, DataFrame]:
    """Questions with a stored result, and those still to compute."""
    done = results.select(key).distinct()
    return asked.join(done, key, "left_semi"), asked.join(done, key, "left_anti")


def prepare(queries: DataFrame) -> DataFrame:
    """``query_id, query, qtype, keys, vector_weight, bm25_weight, rrf_k`` of valid questions."""
    valid = queries.where(tx.is_valid_query(F.col("query"))).withColumn("query", F.lower(tx.sanitize_query(F.col("query"))))
    typed = valid.where(F.col("query").isNotNull()).withColumn("qtype", tx.library_query_type(F.col("query"))).withColumn(
        "keys", tx.keywords(F.col("query")))
    vector_w, bm25_w = sc.library_weights(F.col("query"), F.col("qtype"))
    return typed.withColumns({
        "vector_weight": vector_w, "bm25_weight": bm25_w,
        "rrf_k": F.when(F.col("qtype") == "definition", 8).otherwise(10),
    })


def library_candidates(prepared: DataFrame, chunks: DataFrame, k: int = 5) -> DataFrame:
    """Best fused score of every chunk over the question's variants, boosted and filtered."""
    outer = fusion.expand(prepared.withColumn(
        "query_type", F.when(F.col("qtype") == "explanation", "analytical").otherwise("factual")))
    # Variants that differ in case only are asked once, by the first.
    same = Window.partitionBy("query_id", F.lower("variant_text")).orderBy("variant")
    outer = outer.withColumn("_turn", F.row_number().over(same)).where("_turn = 1").drop("_turn")
    inner = outer.select(
        F.concat_ws("\x1e", F.col("query_id").cast("string"), F.col("variant").cast("string")).alias("_vq"),
        F.col("query_id").alias("_q"), F.col("variant_text").alias("query"),
        F.when(F.col("qtype") == "definition", "factual").otherwise("analytical").alias("query_type"),
        "vector_weight", "bm25_weight", "rrf_k", F.lit(k).alias("top_k"))
    fused = fusion.hybrid(inner.withColumnRenamed("_vq", "query_id"), chunks)
    owner = inner.select(F.col("_vq").alias("query_id"), "_q")
    # Copies of a chunk found by several variants collapse to the best one.
    best = (
        fused.join(owner, "query_id").groupBy(F.col("_q").alias("query_id"), "scope", "chunk_id")
        .agg(F.max("rrf_score").alias("_rrf"), F.min("bm25_rank").alias("bm25_rank"))
    )
    rows = with_text(best, chunks).join(prepared.select("query_id", "query", "qtype", "keys"), "query_id")
    body = F.concat_ws(" ", "section", "text")
    rows = rows.withColumn("hits", tx.keyword_hits(F.col("keys"), body))
    rows = rows.withColumn("rrf_score", F.col("_rrf") + sc.keyword_boost(F.col("hits"))).drop("_rrf")
    rows = rows.withColumn("relevance", sc.relevance(F.col("rrf_score"), F.col("hits"), F.col("keys"), body))
    n_keys = F.size("keys")
    phrase = sc.phrase_hit(F.col("keys"), body)
    coverage = sc.keyword_coverage(F.col("hits"), F.col("keys"))
    return rows.where(
        (F.col("rrf_score") >= sc.MIN_MERGED_SCORE)
        & (F.round("relevance", 9) >= sc.MIN_RELEVANCE)
        & ((F.col("qtype") == "explanation") | (n_keys == 0) | (n_keys > 3) | (F.col("hits") > 0))
        & ((F.col("qtype") != "definition") | (n_keys < 2) | phrase | (coverage >= 0.75))
    )


def library_context(prepared: DataFrame, chunks: DataFrame) -> DataFrame:
    """The at most three budgeted chunks a question is answered from."""
    pool = library_candidates(prepared, chunks)
    unique = diversity.drop_near_copies(pool, "query_id", "rrf_score", 0.9, sc.MERGE_POOL)
    ranked = with_vectors(unique.withColumnRenamed("pool_rank", "rank"))
    kept = diversity.mmr(ranked, ["query_id"], sc.MMR_LIMIT)
    spread = diversity.spread_over_scopes(kept, "query_id", "mmr_rank", sc.MMR_LIMIT, 3)
    return diversity.context_budget(spread, ["query_id"], sc.ASK_CONTEXT_TOKENS, rank="spread_rank")


def decide(prepared: DataFrame, context: DataFrame) -> DataFrame:
    """Status, answer path, extractive answer and confidence of every question."""
    first = F.col("context_rank") == 1

    def of_first(name: str) -> Column:
        return F.max(F.when(first, F.col(name)))

    grouped = context.groupBy("query_id").agg(
        F.count("*").alias("n_chunks"), F.max("relevance").alias("best_relevance"),
        F.max("rrf_score").alias("top_any"), F.avg("rrf_score").alias("avg_score"),
        of_first("rrf_score").alias("top_score"), of_first("relevance").alias("top_relevance"),
        of_first("bm25_rank").alias("top_bm25_rank"), of_first("text").alias("top_text"))
    rows = prepared.join(grouped, "query_id", "left").fillna({"n_chunks": 0})
    gate = sc.relevance_gate(F.col("qtype"), F.size("keys") > 0)
    words = F.size(tx.unicode_words(F.col("query")))
    status = sc.answer_status(F.col("n_chunks"), F.round("best_relevance", 9), F.col("top_score"),
                              F.round("top_relevance", 9), gate, F.col("keys"), words, F.col("qtype"), F.col("top_bm25_rank"))
    rows = rows.withColumn("status", status)
    answered = F.col("status") == "ok"
    model = sc.needs_model(F.col("top_score"), F.col("query"), F.col("qtype"), F.col("keys"))
    rows = rows.withColumn("path", F.when(~answered, "none").when(model, "model").otherwise("extractive"))
    conf = sc.confidence(F.col("top_any"), F.col("avg_score"), F.col("n_chunks"), F.lit(0.0), F.lit("medium"), F.lit(1.0))
    # A context refused by its first chunk is still scored, on that chunk alone.
    refused = sc.confidence(F.col("top_score"), F.col("top_score"), F.col("n_chunks"), F.lit(0.0), F.lit("medium"),
                            F.lit(1.0))
    return rows.withColumns({
        "answer": F.when(F.col("status") == "not_found", sc.NOT_FOUND)
        .when(F.col("status") == "no_relevant", sc.NO_RELEVANT)
        .when(F.col("path") == "extractive", sc.extractive_answer(F.col("top_text"))),
        "confidence": F.when(answered, conf).when(
            (F.col("n_chunks") > 0) & (F.round("best_relevance", 9) >= gate), refused).otherwise(0.05),
    }).withColumn("level", sc.confidence_level(F.col("confidence"))).select(
        "query_id", "query", "qtype", "status", "path", "n_chunks", "top_score", "top_relevance",
        "answer", "confidence", "level")


def ask(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    prepared = prepare(queries)
    return decide(prepared, library_context(prepared, chunks))
