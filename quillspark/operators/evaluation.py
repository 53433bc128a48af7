"""Retrieval evaluation over one long table of system results."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from quillspark.functions import scoring as sc, text as tx
from quillspark.functions.vectors import cosine, hashing_embedder
from quillspark.operators import fusion
from quillspark.operators.ordered import order_statistics, top_k

# Up to this many passages are sent to the chunks.
SENT_PASSAGES = 100_000

# Phrases of a declined answer; the second list is the metric module's.
DECLINED_RUN = ["not enough context", "not found", "not in the document", "cannot be determined", "not mentioned",
                "no information", "not available", "outside the scope", "not covered"]
DECLINED_METRIC = ["not in document", "not found", "information not found", "could not be found"]


def passage_gold(passages: DataFrame, chunks: DataFrame) -> DataFrame:
    """``query_id, chunk_id`` where a chunk holds the whole passage, word for word.

    A passage is looked up by its longest word, so only chunks with that word
    are compared. Passages of checked number are sent to the chunks, which are
    read once and not shuffled; of more, the word join carries ids and the texts
    join afterwards.
    """
    def spaced(words: Column) -> Column:
        return F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))

    wanted = passages.select("query_id", tx.words(F.col("query")).alias("_w")).where(F.size("_w") > 0)
    longest = F.element_at(F.array_sort(F.transform("_w", lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), 1)
    wanted = wanted.select("query_id", longest["w"].alias("_key"), spaced(F.col("_w")).alias("_needle"))
    few = wanted.limit(SENT_PASSAGES + 1).toArrow()
    if few.num_rows <= SENT_PASSAGES:
        return _held_passages(few, chunks, wanted.schema["query_id"].dataType.simpleString())
    words = chunks.select("chunk_id", F.explode(F.array_distinct(tx.words(F.col("text")))).alias("_key"))
    pairs = words.join(wanted.select("query_id", "_key"), "_key").select("query_id", "chunk_id")
    texts = chunks.select("chunk_id", spaced(tx.words(F.col("text"))).alias("_hay"))
    return (
        pairs.join(texts, "chunk_id").join(wanted.select("query_id", "_needle"), "query_id")
        .where(F.col("_hay").contains(F.col("_needle"))).select("query_id", "chunk_id")
    )


def _held_passages(wanted: pa.Table, chunks: DataFrame, id_type: str) -> DataFrame:
    """``query_id, chunk_id`` of passages (``query_id, _key, _needle``) that are sent to the chunks."""
    keys, needles, ids = wanted["_key"].to_pylist(), wanted["_needle"].to_pylist(), wanted["query_id"].combine_chunks()
    by_key: dict[str, list[int]] = {}
    for at, key in enumerate(keys):
        by_key.setdefault(key, []).append(at)
    shared = chunks.sparkSession.sparkContext.broadcast((ids, needles, by_key))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, needles, by_key = shared.value
        for batch in batches:
            rows, found = [], []
            single = pc.replace_substring_regex(batch.column("text"), f"{tx.SPACE}+", " ")
            for row, text in enumerate(single.to_pylist()):
                own = by_key.keys() & set(text.split(" ")) if text else ()
                hay = f" {text} "
                mine = [at for key in own for at in by_key[key] if needles[at] in hay]
                found += mine
                rows += [row] * len(mine)
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(found, pa.int64())), batch.column("chunk_id").take(pa.array(rows, pa.int64()))], names=["query_id", "chunk_id"])

    return chunks.select("chunk_id", "text").mapInArrow(scan, f"query_id {id_type}, chunk_id {chunks.schema['chunk_id'].dataType.simpleString()}")


def system_results(routed: DataFrame, chunks: DataFrame, k: int = 5, embedder=None) -> DataFrame:
    """Top-k of the vector, keyword and fused systems from one set of searches.

    The unexpanded query is the first variant, so the single systems are read
    off the same hits: ``query_id, scope, system, rank, chunk_id, score``.
    """
    ranked = fusion.fusion_ranks(fusion.fuse_variants(fusion.variant_hits(fusion.expand(routed), chunks, embedder)), routed)
    first = fusion.VARIANT_WEIGHTS[0]
    rows = ranked.withColumns({"_vr": fusion.list_rank("vector_plain"), "_br": fusion.list_rank("bm25_plain")})

    def entry(name: str, rank: str, score: Column) -> Column:
        return F.struct(F.lit(name).alias("system"), F.col(rank).alias("rank"), score.alias("score"))

    listed = F.array(entry("vector", "_vr", F.col("vector_plain") / first),
                     entry("bm25", "_br", F.col("bm25_plain") / first),
                     entry("hybrid", "rank", F.col("rrf_score")))
    return rows.select("query_id", "scope", "chunk_id", F.explode(listed).alias("_e")).select(
        "query_id", "scope", "chunk_id", "_e.*").where(F.col("rank") <= k)


def with_reranked(results: DataFrame, queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """Add the reranked system to a result table holding the fused one."""
    fused = results.where("system = 'hybrid'").withColumnRenamed("score", "rrf_score").drop("system")
    again = fusion.rerank(fused, queries, chunks).select(
        "query_id", "scope", "chunk_id", F.lit("reranked").alias("system"), F.col("new_rank").alias("rank"),
        F.col("rrf_score").alias("score"))
    return results.unionByName(again)


def pseudo_gold(gold: DataFrame, results: DataFrame, system: str = "hybrid", k: int = 5) -> DataFrame:
    """Gold ids, and for unlabelled queries the top of one system, flagged as circular."""
    labelled = gold.select("query_id", "chunk_id", F.lit(False).alias("circular"))
    stand_in = results.where((F.col("system") == system) & (F.col("rank") <= k)).join(
        gold.select("query_id").distinct(), "query_id", "left_anti").select("query_id", "chunk_id", F.lit(True).alias("circular"))
    return labelled.unionByName(stand_in)


def query_metrics(results: DataFrame, gold: DataFrame, queries: DataFrame, systems: list[str]) -> DataFrame:
    """``recall3, recall5, mrr`` of every query and system; 0 without gold or hits."""
    sizes = gold.groupBy("query_id").agg(F.countDistinct("chunk_id").alias("n_gold"))
    marked = results.join(gold.select("query_id", "chunk_id", F.lit(1).alias("_hit")).distinct(), ["query_id", "chunk_id"], "left")
    hit = F.col("_hit").isNotNull()
    found = marked.groupBy("query_id", "system").agg(
        F.count_if(hit & (F.col("rank") <= 3)).alias("_h3"), F.count_if(hit & (F.col("rank") <= 5)).alias("_h5"),
        F.min(F.when(hit, F.col("rank"))).alias("first_hit"))
    every = queries.select("query_id", F.explode(F.array(*[F.lit(s) for s in systems])).alias("system"))
    joined = every.join(found, ["query_id", "system"], "left").join(sizes, "query_id", "left")

    def recall(c: str) -> Column:
        return F.coalesce(F.col(c) / F.col("n_gold"), F.lit(0.0))

    return joined.select(
        "query_id", "system", F.coalesce("n_gold", F.lit(0)).alias("n_gold"), recall("_h3").alias("recall3"),
        recall("_h5").alias("recall5"), F.coalesce(1 / F.col("first_hit"), F.lit(0.0)).alias("mrr"))


def ablation(metrics: DataFrame) -> DataFrame:
    """Mean metrics per system."""
    return metrics.groupBy("system").agg(
        F.count("*").alias("queries"), F.round(F.avg("recall3"), 4).alias("recall3"),
        F.round(F.avg("recall5"), 4).alias("recall5"), F.round(F.avg("mrr"), 4).alias("mrr"))


def dataset_averages(metrics: DataFrame, dataset: str = "dataset") -> DataFrame:
    """Per system the mean of the datasets' means, so that a small dataset counts as much as a large one."""
    names = ("recall3", "recall5", "mrr")
    each = metrics.groupBy(dataset, "system").agg(*[F.avg(n).alias(n) for n in names])
    return each.groupBy("system").agg(F.count("*").alias("datasets"), *[F.round(F.avg(n), 4).alias(n) for n in names])


def improvement_pct(after: Column, before: Column) -> Column:
    return F.round((after - before) / F.greatest(before, F.lit(0.001)) * 100, 1)


def rerank_impact(results: DataFrame, gold: DataFrame, queries: DataFrame) -> DataFrame:
    """Per query: whether reranking moved a relevant chunk into or out of the top three."""
    marked = results.where(F.col("system").isin("hybrid", "reranked") & (F.col("rank") <= 3)).join(
        gold.select("query_id", "chunk_id").distinct().withColumn("_hit", F.lit(1)), ["query_id", "chunk_id"], "left")
    hits = marked.groupBy("query_id").agg(
        F.count_if(F.col("_hit").isNotNull() & (F.col("system") == "hybrid")).alias("before_hits"),
        F.count_if(F.col("_hit").isNotNull() & (F.col("system") == "reranked")).alias("after_hits"))
    rows = queries.select("query_id").join(hits, "query_id", "left").fillna(0, ["before_hits", "after_hits"])
    before, after = F.col("before_hits"), F.col("after_hits")
    return rows.withColumns({
        "impact": F.when((before == 0) & (after > 0), "improved").when((before > 0) & (after == 0), "degraded").otherwise("same"),
        "more_hits": after > before, "equal_hits": after == before})


def order_changes(results: DataFrame) -> DataFrame:
    """First five ids before and after reranking, and whether they differ."""
    def ids(system: str) -> Column:
        rows = F.collect_list(F.when(F.col("system") == system, F.struct("rank", "chunk_id")))
        return F.array_join(F.transform(F.array_sort(rows), lambda x: x["chunk_id"].cast("string")), ",")

    top = results.where(F.col("system").isin("hybrid", "reranked") & (F.col("rank") <= 5))
    lists = top.groupBy("query_id").agg(ids("hybrid").alias("before_ids"), ids("reranked").alias("after_ids"))
    return lists.withColumn("ranking_changed", F.col("before_ids") != F.col("after_ids"))


# --- answers ---------------------------------------------------------------------

def word_set(text: Column) -> Column:
    return F.array_distinct(tx.words(F.lower(text)))


def grounding(answer: Column, context: Column) -> Column:
    """Share of the answer's words found in its context; 1 for a blank answer."""
    words = word_set(F.coalesce(answer, F.lit("")))
    return F.when(F.size(words) == 0, 1.0).otherwise(
        F.size(F.array_intersect(words, word_set(F.coalesce(context, F.lit(""))))) / F.size(words))


def declined(answer: Column, phrases: list[str]) -> Column:
    return tx.contains_any(F.lower(F.coalesce(answer, F.lit(""))), phrases)


def exact_match(answer: Column, expected: Column) -> Column:
    return F.coalesce(F.lower(tx.strip(answer)) == F.lower(tx.strip(expected)), F.lit(False))


def answer_metrics(responses: DataFrame) -> DataFrame:
    """All answer metrics in one aggregate.

    ``responses(answer, context, expected, in_scope)``.
    """
    weak = grounding(F.col("answer"), F.col("context")) < 0.3
    said_so = declined(F.col("answer"), DECLINED_METRIC)
    return responses.agg(
        F.round(F.avg(exact_match(F.col("answer"), F.col("expected")).cast("int")), 4).alias("accuracy"),
        F.round(F.avg(weak.cast("int")), 4).alias("hallucination_rate"),
        F.round(F.avg((said_so != F.col("in_scope")).cast("int")), 4).alias("not_found_accuracy"),
        F.round(F.avg(F.when(~F.col("in_scope"), declined(F.col("answer"), DECLINED_RUN).cast("int"))), 4)
        .alias("not_found_accuracy_run"))


def failure_category(found: Column, answer: Column, expected: Column, similarity: Column, confidence: Column) -> Column:
    gradable = (F.coalesce(expected, F.lit("")) != "") & (F.lower(expected) != "not_in_document")
    return (
        F.when((found == 0) | F.lower(answer).contains("not enough context"), "retrieval_failure")
        .when(gradable & (similarity < 0.65), "generation_failure")
        .when(gradable & (confidence < 0.5), "confidence_mismatch").otherwise("success"))


def calibration(predictions: DataFrame) -> DataFrame:
    """Accuracy per confidence band, and the factor the high band asks for.

    ``predictions(confidence, correct)``.
    """
    banded = predictions.groupBy(sc.calibration_band(F.col("confidence")).alias("band")).agg(
        F.count("*").alias("samples"), F.round(F.avg(F.col("correct").cast("int")), 4).alias("accuracy"))
    return banded


def calibration_factor(predictions: DataFrame) -> DataFrame:
    """One row: 0.85 when at least three high-band answers are right less than 70 %."""
    high = F.col("confidence") > 0.8
    return predictions.agg(
        F.count_if(high).alias("high_samples"),
        F.coalesce(F.avg(F.when(high, F.col("correct").cast("int"))), F.lit(0.0)).alias("_acc")).select(
        "high_samples", F.round("_acc", 4).alias("high_accuracy"),
        F.when((F.col("high_samples") >= 3) & (F.col("_acc") < 0.7), 0.85).otherwise(1.0).alias("factor"),
        (F.col("_acc") >= 0.7).alias("well_calibrated"))


# --- harness -----------------------------------------------------------------------

def harness_details(results: DataFrame, queries: DataFrame, chunks: DataFrame, embedder=None,
                    chars: int | None = None) -> DataFrame:
    """Similarity of the first text and key-term coverage of the first three, per system.

    ``queries(query_id, query, expected, key_terms)``; texts are compared whole
    or by their first ``chars`` characters.
    """
    embed = embedder or hashing_embedder()
    shown = results.where(F.col("rank") <= 3).join(
        chunks.select("scope", "chunk_id", tx.head(F.col("text"), chars).alias("_t")), ["scope", "chunk_id"])
    texts = F.array_sort(F.collect_list(F.struct("rank", "_t")))
    grouped = shown.groupBy("query_id", "system").agg(
        F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("top_score"), texts.alias("_r"))
    rows = grouped.join(queries.select("query_id", "expected", "key_terms"), "query_id")
    rows = rows.withColumns({
        "_best": embed(tx.tokenize(F.element_at("_r._t", 1))), "_want": embed(tx.tokenize(F.col("expected"))),
        "_all": F.lower(F.array_join("_r._t", " "))})
    covered = F.size(F.filter("key_terms", lambda k: F.col("_all").contains(F.lower(k))))
    return rows.select(
        "query_id", "system", "top_score", cosine(F.col("_best"), F.col("_want")).alias("similarity"),
        F.when(F.size("key_terms") > 0, covered / F.size("key_terms")).alias("coverage"))


def trust(results: DataFrame) -> DataFrame:
    """Trust score of every query from the vector and fused lists."""
    top = F.col("rank") == 1
    per = results.where(F.col("system").isin("vector", "hybrid")).groupBy("query_id", "chunk_id").agg(
        F.max(F.when((F.col("system") == "vector") & (F.col("rank") <= 3), 1).otherwise(0)).alias("_v"),
        F.max(F.when((F.col("system") == "hybrid") & (F.col("rank") <= 3), 1).otherwise(0)).alias("_h"),
        F.max(F.when((F.col("system") == "vector") & top, F.col("score"))).alias("_tv"),
        F.max(F.when((F.col("system") == "hybrid") & top, F.col("score"))).alias("_th"))
    rows = per.groupBy("query_id").agg(
        F.coalesce(F.max("_tv"), F.lit(0.0)).alias("top_vector"), F.coalesce(F.max("_th"), F.lit(0.0)).alias("top_rrf"),
        (F.sum(F.col("_v") * F.col("_h")) / 3).alias("overlap"))
    value = F.least(F.col("top_vector") / 0.5, F.lit(1.0)) * 0.4 + F.least(F.col("top_rrf") / 0.1, F.lit(1.0)) * 0.3 + \
        F.col("overlap") * 0.3
    return rows.withColumn("trust", F.round(value, 6)).withColumn(
        "level", F.when(F.col("trust") > 0.7, "high").when(F.col("trust") > 0.4, "medium").otherwise("low"))


def is_correct(adversarial: Column, top_vector: Column, recall5: Column) -> Column:
    return F.when(adversarial, top_vector < 0.25).otherwise(recall5 > 0)


def failure_export(adversarial: Column, correct: Column, similarity: Column, coverage: Column) -> Column:
    return (
        F.when(~adversarial & ~correct, "retrieval_miss").when(adversarial & ~correct, "false_positive")
        .when(~adversarial & (similarity < 0.3) & (coverage < 0.3), "hallucination_risk"))


def sampled_runs(queries: DataFrame, runs: int = 3, ratio: float = 0.8, seed: str = "s") -> DataFrame:
    """``run, query_id`` of a seeded sample without replacement for every run.

    Each run keeps the ids with the smallest hashes; the cut-off hash comes
    from exact order statistics, so no run is sorted in one task.
    """
    drawn = queries.select("query_id", F.explode(F.sequence(F.lit(1), F.lit(runs))).alias("run")).withColumn(
        "_h", F.md5(F.concat_ws("|", F.lit(seed), F.col("run").cast("string"), F.col("query_id").cast("string"))))
    size = F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(ratio)))
    cut = order_statistics(drawn, ["run"], "_h", F.substring("_h", 1, 3), {"cut": size - 1})
    return drawn.join(cut.select("run", "cut"), "run").where(F.col("_h") <= F.col("cut")).select("run", "query_id")


def stability(run_metrics: DataFrame, threshold: float = 0.05) -> DataFrame:
    """Mean and population deviation of recall over runs, per system."""
    return run_metrics.groupBy("system").agg(
        F.count("*").alias("runs"), F.round(F.avg("recall5"), 4).alias("recall_mean"),
        F.round(F.stddev_pop("recall5"), 4).alias("recall_std"), F.round(F.avg("mrr"), 4).alias("mrr_mean"),
        (F.stddev_pop("recall5") < threshold).alias("stable"))


def latency_summary(calls: DataFrame, key: str, value: str) -> DataFrame:
    """Mean, p50 and p95 as the elements at ``n // 2`` and ``int(n * 0.95)``."""
    mid = F.floor(F.col("n") / 2)
    high = F.floor(F.col("n") * F.lit(0.95))
    stats = order_statistics(calls, [key], value, F.floor(F.col(value)), {"p50": mid, "p95": high})
    means = calls.groupBy(key).agg(F.avg(value).alias("mean"))
    return stats.join(means, key)


def acceptance(**named: Column) -> dict[str, Column]:
    """The five criteria and the verdict, from the named figures."""
    baseline, hybrid, reranked = named["baseline"], named["hybrid"], named["reranked"]
    checks = {
        "hybrid_gt_baseline": (hybrid > baseline) | ((hybrid >= 0.95) & (baseline >= 0.95)),
        "reranked_gte_hybrid": reranked >= hybrid,
        "high_conf_accuracy_gt_70": F.coalesce(named["high_accuracy"] > 0.7, F.lit(True)),
        "chunk_quality_gt_80": named["chunk_quality"] > 0.8,
        "stability_std_lt_005": F.coalesce(named["stable"], F.lit(True)),
    }
    all_of = F.lit(True)
    for c in checks.values():
        all_of = all_of & c
    return {**checks, "verdict": F.when(all_of, "VALIDATED").otherwise("NEEDS_IMPROVEMENT")}


def latest(reports: DataFrame, key: str, ts: str) -> DataFrame:
    """The newest report of every key."""
    rest = [c for c in reports.columns if c != key]
    return reports.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(ts)).alias("_r")).select(key, "_r.*")


def first_hits(results: DataFrame, k: int) -> DataFrame:
    return top_k(results, ["query_id", "system"], [F.asc("rank")], k, "_r").drop("_r")
