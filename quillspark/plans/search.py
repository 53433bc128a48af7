"""The three search modes over a table of (query, scope) pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillspark.functions import scoring as sc, text as tx
from quillspark.functions.vectors import embedded
from quillspark.operators import diversity, fusion, lexical
from quillspark.plans.lineage import cut

FALLBACK = (
    "The information requested could not be reliably found in the uploaded document. "
    "Please try rephrasing your question or ensure the relevant content is in the document."
)


def with_text(hits: DataFrame, chunks: DataFrame, *extra: str) -> DataFrame:
    """Chunk rows of the hits, missing columns filled with their defaults."""
    defaults = {"section": F.lit(""), "page": F.lit(1), "type": F.lit("text")}
    have = [F.col(n) if n in chunks.columns else d.alias(n) for n, d in defaults.items()]
    return hits.join(chunks.select("scope", "chunk_id", "text", *have, *extra), ["scope", "chunk_id"])


def with_vectors(hits: DataFrame, embedder=None) -> DataFrame:
    return hits.withColumn("embedding", embedded(F.col("text"), embedder))


def result_rows(hits: DataFrame, score: Column, rank: str) -> DataFrame:
    return hits.select(
        "query_id", "scope", "chunk_id", F.col(rank).alias("rank"),
        F.substring("text", 1, 300).alias("text"), "section", "page",
        F.round(score, 4).alias("score"), "type",
    )


def keyword_search(queries: DataFrame, chunks: DataFrame, k: int = 10) -> DataFrame:
    hits = lexical.bm25_top(queries, chunks, k)
    return result_rows(with_text(hits, chunks), F.col("score"), "rank")


def hybrid_search(routed: DataFrame, chunks: DataFrame, limit: int = 10, fused: DataFrame | None = None) -> DataFrame:
    hits = with_vectors(with_text(fused if fused is not None else fusion.hybrid(routed, chunks), chunks))
    kept = diversity.mmr(hits, ["query_id", "scope"], limit)
    return result_rows(kept, F.col("rrf_score"), "mmr_rank")


def ai_context(routed: DataFrame, chunks: DataFrame, limit: int = 7, max_tokens: int = 1500,
               fused: DataFrame | None = None) -> DataFrame:
    """Reranked, diversified and budgeted context of every (query, scope)."""
    fused = fused if fused is not None else cut(fusion.hybrid(routed, chunks))
    asked = routed.where("needs_rerank")
    sure = fused.join(routed.where("not needs_rerank").select("query_id"), "query_id", "left_semi")
    unsure = fusion.rerank(fused.join(asked.select("query_id"), "query_id", "left_semi"), asked, chunks)
    cols = ["query_id", "scope", "chunk_id", "rrf_score"]
    ordered = sure.select(*cols, "rank").unionByName(unsure.select(*cols, F.col("new_rank").alias("rank")))
    hits = with_vectors(with_text(ordered, chunks))
    kept = diversity.mmr(hits, ["query_id", "scope"], limit)
    return diversity.context_budget(kept, ["query_id", "scope"], max_tokens, rank="mmr_rank")


def confidence_per_group(context: DataFrame, keys: list[str], factor: Column | None = None,
                         model: Column | None = None) -> DataFrame:
    grouped = context.groupBy(*keys).agg(
        F.max("rrf_score").alias("top_score"), F.avg("rrf_score").alias("avg_score"),
        F.count("*").alias("n_chunks"))
    score = sc.confidence(F.col("top_score"), F.col("avg_score"), F.col("n_chunks"), F.lit(0.0),
                          model if model is not None else F.lit("medium"),
                          factor if factor is not None else F.lit(1.0))
    return grouped.withColumn("confidence", score).withColumn(
        "level", sc.confidence_level(F.col("confidence")))


def ai_search(routed: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row per (query, scope): context, citations, confidence, fallback."""
    context = cut(ai_context(routed, chunks))
    keys = ["query_id", "scope"]
    judged = confidence_per_group(context, keys)
    texts = diversity.assemble_context(context, keys)
    cited = F.array_sort(F.collect_list(F.struct(
        "context_rank", F.col("chunk_id").cast("string").alias("chunk_id"), "section", "page",
        F.substring("text", 1, 150).alias("preview"))))
    citations = context.groupBy(*keys).agg(cited.alias("sources"))
    fallback = sc.falls_back(F.col("confidence"))
    return (
        judged.join(texts, keys).join(citations, keys)
        .withColumn("fallback", fallback)
        .withColumn("answer", F.when(fallback, FALLBACK))
        .withColumn("sources", F.when(fallback, F.expr("slice(sources, 1, 0)")).otherwise(F.col("sources")))
    )


def search(requests: DataFrame, chunks: DataFrame, corrections: DataFrame | None = None) -> DataFrame:
    """All modes at once; ``requests(query_id, query, mode)``.

    ``corrections(query_id, corrected)`` comes from the spelling operator.
    Keyword mode searches the corrected text; the other modes are routed by it
    but search the text as written.
    """
    asked = requests
    if corrections is not None:
        asked = requests.join(corrections.select("query_id", "corrected"), "query_id", "left")
    else:
        asked = requests.withColumn("corrected", F.lit(None).cast("string"))
    asked = asked.withColumn("effective_query", F.coalesce("corrected", "query"))
    asked = asked.withColumn(
        "mode", F.when(F.col("mode") == "auto", fusion.search_mode(F.col("effective_query"))).otherwise(F.col("mode")))
    routed = fusion.route(asked, "effective_query")

    keyword = routed.where("mode = 'keyword'").select("query_id", F.col("effective_query").alias("query"))
    out = keyword_search(keyword, chunks).withColumn("mode", F.lit("keyword"))
    both = routed.where("mode in ('hybrid', 'ai')")
    fused = cut(fusion.hybrid(both, chunks))
    plain = fused.join(routed.where("mode = 'hybrid'").select("query_id"), "query_id", "left_semi")
    out = out.unionByName(hybrid_search(routed, chunks, fused=plain).withColumn("mode", F.lit("hybrid")))
    answered = routed.where("mode = 'ai'")
    context = ai_context(answered, chunks, fused=fused.join(answered.select("query_id"), "query_id", "left_semi"))
    ai = result_rows(context, F.col("rrf_score"), "context_rank").withColumn("mode", F.lit("ai"))
    return out.unionByName(ai)


def across_scopes(hits: DataFrame, scopes: DataFrame, limit: int) -> DataFrame:
    """Merge the per-scope hits of a query; partly indexed scopes count 75 %.

    ``scopes(scope, status)``.
    """
    graded = hits.join(scopes.select("scope", "status"), "scope")
    weighted = graded.withColumn(
        "score", F.when(F.col("status") == "partially_ready", F.col("score") * 0.75).otherwise(F.col("score")))
    w = Window.partitionBy("query_id").orderBy(
        F.desc(F.round("score", 6)), F.asc("scope"), F.asc("chunk_id"))
    return weighted.withColumn("merged_rank", F.row_number().over(w)).where(
        F.col("merged_rank") <= max(1, limit))
