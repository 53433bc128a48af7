"""Retrieval queries over the driver's tables, with their oracle statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillspark.functions import scoring as sc, text as tx
from quillspark.operators import dense, diversity, fusion, lexical
from quillspark.plans import ask, search
from quillspark.workloads import sql
from quillspark.workloads.tables import (
    CHUNKS_BY_SOURCE_SQL, CHUNKS_WHOLE_SQL, QUERIES_SQL, chunks_by_source, chunks_whole, queries, read)

QUERIES, ORACLES = {}, {}


def bound(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return add


# --- keyword index --------------------------------------------------------------

@bound("bm25_topk", f"""with {CHUNKS_BY_SOURCE_SQL}, {QUERIES_SQL},
{sql.bm25('queries', 'chunks')}, {sql.ranked('bm25', 'best', 10)}
select query_id, scope, chunk_id, rank, round(score, 6) as score from best""")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = lexical.bm25_top(queries(spark, sf_dir), chunks_by_source(spark, sf_dir), 10)
    return hits.select("query_id", "scope", "chunk_id", "rank", F.round("score", 6).alias("score"))


@bound("bm25_topk_corpus", f"""with {CHUNKS_WHOLE_SQL}, {QUERIES_SQL},
{sql.bm25('queries', 'chunks')}, {sql.ranked('bm25', 'best', 10)}
select query_id, chunk_id, rank, round(score, 6) as score from best""")
def bm25_topk_corpus(spark, sf_dir):
    hits = lexical.bm25_top(queries(spark, sf_dir), chunks_whole(spark, sf_dir), 10)
    return hits.select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


@bound("bm25_topk_legacy_tokens", f"""with {CHUNKS_BY_SOURCE_SQL}, {QUERIES_SQL},
{sql.bm25('queries', 'chunks', legacy=True)}, {sql.ranked('bm25', 'best', 10)}
select query_id, scope, chunk_id, rank, round(score, 6) as score from best""")
def bm25_topk_legacy_tokens(spark, sf_dir):
    hits = lexical.bm25_top(queries(spark, sf_dir), chunks_by_source(spark, sf_dir), 10, legacy=True)
    return hits.select("query_id", "scope", "chunk_id", "rank", F.round("score", 6).alias("score"))


@bound("bm25_postings", f"""with {CHUNKS_BY_SOURCE_SQL},
t as (select scope, chunk_id, {sql.tokens('text')} as terms from chunks)
select scope, chunk_id, dl, term, count(*) as tf from
(select scope, chunk_id, len(terms)::int as dl, unnest(terms) as term from t) group by all""")
def bm25_postings(spark, sf_dir):
    return lexical.postings(chunks_by_source(spark, sf_dir))


@bound("bm25_term_stats", f"""with {CHUNKS_BY_SOURCE_SQL},
t as (select scope, chunk_id, unnest({sql.tokens('text')}) as term from chunks)
select scope, term, count(distinct chunk_id) as df from t group by all""")
def bm25_term_stats(spark, sf_dir):
    return lexical.term_stats(lexical.postings(chunks_by_source(spark, sf_dir)))


@bound("bm25_scope_stats", f"""with {CHUNKS_BY_SOURCE_SQL}
select scope, count(*) as n_docs, round(avg(len({sql.tokens('text')})), 6) as avg_dl from chunks group by scope""")
def bm25_scope_stats(spark, sf_dir):
    stats = lexical.scope_stats(lexical.chunk_stats(chunks_by_source(spark, sf_dir)))
    return stats.withColumn("avg_dl", F.round("avg_dl", 6))


# --- dense search ---------------------------------------------------------------

def label_centroids(spark, sf_dir) -> DataFrame:
    """One query vector per label: the mean of its vectors, component by component."""
    cells = read(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("pos", "v"))
    means = cells.groupBy("label", "pos").agg(F.avg(F.col("v").cast("double")).alias("m"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "m")))
    return means.groupBy("label").agg(ordered.alias("_c")).select(
        F.col("label").alias("query_id"), F.col("_c.m").alias("embedding"))


def vector_corpus(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(
        F.lit("all").alias("scope"), F.col("vec_id").alias("chunk_id"), "embedding", "label")


VECTOR_SQL = """cells as (select vec_id, label, unnest(embedding)::double as v, generate_subscripts(embedding, 1) as pos
    from embeddings),
nrm as (select vec_id, sqrt(sum(v * v)) as n from cells group by vec_id),
mean as (select label as query_id, pos, avg(v) as m from cells group by all),
qn as (select query_id, sqrt(sum(m * m)) as n from mean group by query_id),
scored as (select q.query_id, 'all' as scope, c.vec_id as chunk_id, c.label,
    round(sum(q.m * c.v) / any_value(qn.n) / any_value(nrm.n), 8) as score
    from mean q join cells c using (pos) join qn using (query_id) join nrm using (vec_id) group by all)"""


@bound("dense_topk", f"""with {VECTOR_SQL}, {sql.ranked('scored', 'best', 10)}
select query_id, chunk_id, rank, round(score, 6) as score from best""")
def dense_topk(spark, sf_dir):
    hits = dense.dense_top(label_centroids(spark, sf_dir), vector_corpus(spark, sf_dir), 10)
    return hits.select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


@bound("text_vectors", f"""with {CHUNKS_WHOLE_SQL}, {sql.vectors('chunks', 'chunk_id', 'text', 'e')}
select chunk_id, b, round(v, 6) as v from e where v <> 0""")
def text_vectors(spark, sf_dir):
    embedded = dense.embed_texts(chunks_whole(spark, sf_dir))
    cells = embedded.select("chunk_id", F.posexplode("embedding").alias("b", "v"))
    return cells.where("v <> 0").withColumn("v", F.round("v", 6))


@bound("dense_text_topk", f"""with {CHUNKS_BY_SOURCE_SQL}, {QUERIES_SQL},
{sql.dense('queries', 'chunks')}, {sql.ranked('dense', 'best', 5)}
select query_id, scope, chunk_id, rank, round(score, 6) as score from best""")
def dense_text_topk(spark, sf_dir):
    asked = dense.embed_texts(queries(spark, sf_dir), "query")
    hits = dense.dense_top(asked, dense.embed_texts(chunks_by_source(spark, sf_dir)), 5)
    return hits.select("query_id", "scope", "chunk_id", "rank", F.round("score", 6).alias("score"))


# --- query understanding ----------------------------------------------------------

def all_questions(spark, sf_dir) -> DataFrame:
    """Every benchmark passage and every user turn as a question table."""
    asked = queries(spark, sf_dir).select(
        F.concat(F.lit("b"), F.col("query_id").cast("string")).alias("query_id"), "query")
    turns = read(spark, sf_dir, "conversations").where("role = 'user'").select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("."), F.col("turn").cast("string")).alias("query_id"),
        F.col("text").alias("query"))
    parts = read(spark, sf_dir, "conversations").where("role = 'user'").select(
        "conv_id", "turn", F.posexplode(tx.sentences(F.col("text"))).alias("i", "query"))
    lines = parts.select(F.concat_ws(".", F.lit("s"), F.col("conv_id").cast("string"), F.col("turn").cast("string"),
                                     F.col("i").cast("string")).alias("query_id"), "query")
    return asked.unionByName(turns).unionByName(lines)


ALL_QUESTIONS_SQL = f"""asked as (
    select 'b' || item_id as query_id, text as query from benchmark
    union all select 'c' || conv_id || '.' || turn, text from conversations where role = 'user'
    union all select 's.' || conv_id || '.' || turn || '.' || (i - 1), s[i] from (
        select conv_id, turn, s, unnest(range(1, len(s) + 1)) as i from (
            select conv_id, turn, {sql.sentences('text')} as s from conversations where role = 'user')))"""


@bound("route_queries", f"""with {ALL_QUESTIONS_SQL}, {sql.routed('asked', 'r')}
select query_id, query_type, complexity, vector_weight, bm25_weight, top_k, rrf_k, needs_rerank,
    case when {sql.wc('query')} <= 3 then 'keyword' when {sql.wc('query')} <= 8 then 'hybrid' else 'ai' end as mode
from r""")
def route_queries(spark, sf_dir):
    routed = fusion.route(all_questions(spark, sf_dir))
    return routed.withColumn("mode", fusion.search_mode(F.col("query"))).drop("query")


@bound("expand_queries", f"""with {ALL_QUESTIONS_SQL}, {sql.routed('asked', 'r')}, {sql.variants('r', 'v')}
select query_id, variant, weight, query as variant_text from v""")
def expand_queries(spark, sf_dir):
    routed = fusion.route(all_questions(spark, sf_dir))
    return fusion.expand(routed).select("query_id", "variant", "weight", "variant_text")


@bound("task_top_k", f"""with {ALL_QUESTIONS_SQL}, {sql.routed('asked', 'r')},
t(task, k, k_simple) as (values ('ask', 5, 3), ('quiz', 7, 5), ('flashcards', 7, 5), ('summary', 10, 7), ('slides', 7, 5),
    ('mock_test', 10, 8), ('fun_facts', 5, 3), ('mentor', 5, 3), ('search', null, null))
select query_id, task, coalesce(k, top_k) as k, coalesce(k_simple, 3) as k_simple from r cross join t""")
def task_top_k(spark, sf_dir):
    routed = fusion.route(all_questions(spark, sf_dir))
    tasks = [*fusion.TASK_TOP_K, "search"]
    each = routed.select("query_id", "top_k", F.explode(F.array(*[F.lit(t) for t in tasks])).alias("task"))
    return each.select("query_id", "task", fusion.task_top_k(F.col("task"), F.col("top_k")).alias("k"),
                       fusion.task_top_k(F.col("task"), F.lit(3), fusion.SIMPLE_TASK_TOP_K).alias("k_simple"))


@bound("question_features", f"""with {ALL_QUESTIONS_SQL},
f as (select query_id, query, {sql.keywords('query')} as keys, lower({sql.strip('query')}) as q,
    regexp_replace({sql.strip('query')}, '[^a-zA-Z]', '', 'g') as letters from asked),
g as (select *, case when starts_with(q, 'what is') or starts_with(q, 'define') then 'definition'
    when contains(q, 'explain') or contains(q, 'simplify') or contains(q, 'describe') or contains(q, 'rephrase')
    then 'explanation' else 'general' end as qtype from f)
select query_id, array_to_string(keys, ' ') as keywords, qtype,
    length(q) >= 3 and not (length(letters) > 0 and length(letters) <= 2) as valid,
    case when qtype = 'explanation' and len(keys) = 0 then 0.35::double when qtype = 'explanation' then 0.45::double
    else 0.55::double end as gate,
    case when qtype <> 'explanation' and len(list_filter(regexp_split_to_array(query, '[^\\p{{L}}\\p{{N}}_]+'),
    lambda w: w <> '')) <= 5 then 0.3::double else 0.6::double end as vector_weight from g""")
def question_features(spark, sf_dir):
    asked = all_questions(spark, sf_dir).withColumn("keys", tx.keywords(F.col("query"))).withColumn(
        "qtype", tx.library_query_type(F.col("query")))
    vector_w, _ = sc.library_weights(F.col("query"), F.col("qtype"))
    return asked.select(
        "query_id", F.array_join("keys", " ").alias("keywords"), "qtype", tx.is_valid_query(F.col("query")).alias("valid"),
        sc.relevance_gate(F.col("qtype"), F.size("keys") > 0).alias("gate"), vector_w.alias("vector_weight"))


@bound("sanitized_queries", f"""with recursive {ALL_QUESTIONS_SQL},
w as (select query_id, {sql.words(sql.strip('query'))} as ws from asked),
f as (select query_id, list_reduce(list_transform(ws, lambda x: [x]),
    lambda acc, x: case when len(list_filter(list_slice(acc, greatest(len(acc) - 2, 1), len(acc)),
        lambda y: lower(y) = lower(x[1]))) > 0 then acc else list_concat(acc, x) end,
    cast([] as varchar[])) as kept from w)
select query_id, nullif(array_to_string(kept, ' '), '') as sanitized from f""")
def sanitized_queries(spark, sf_dir):
    return all_questions(spark, sf_dir).select("query_id", tx.sanitize_query(F.col("query")).alias("sanitized"))


# --- fusion -------------------------------------------------------------------------

ROUTED_SQL = f"{QUERIES_SQL}, {sql.routed('queries', 'routed')}"


@bound("hybrid_rrf", f"""with {CHUNKS_BY_SOURCE_SQL}, {ROUTED_SQL}, {sql.hybrid('routed', 'chunks')}
select query_id, scope, chunk_id, rank, vector_rank, bm25_rank, round(rrf_score, 6) as rrf_score from hyb""")
def hybrid_rrf(spark, sf_dir):
    routed = fusion.route(queries(spark, sf_dir))
    hits = fusion.hybrid(routed, chunks_by_source(spark, sf_dir))
    return hits.select("query_id", "scope", "chunk_id", "rank", "vector_rank", "bm25_rank",
                       F.round("rrf_score", 6).alias("rrf_score"))


FIXED_ROUTE_SQL = f"""{QUERIES_SQL}, routed as (select *, 'factual' as query_type, 0.5::double as vector_weight,
    0.5::double as bm25_weight, 10 as rrf_k, 5 as top_k from queries)"""


def fixed_route(spark, sf_dir, k: int = 5) -> DataFrame:
    """The strategy the evaluation harness runs with: defaults, top five."""
    return queries(spark, sf_dir).withColumns({
        "query_type": F.lit("factual"), "vector_weight": F.lit(0.5), "bm25_weight": F.lit(0.5),
        "rrf_k": F.lit(10), "top_k": F.lit(k)})


@bound("vector_vs_hybrid", f"""with {CHUNKS_BY_SOURCE_SQL}, {FIXED_ROUTE_SQL}, {sql.hybrid('routed', 'chunks')},
{sql.dense('queries', 'chunks')}, {sql.ranked('dense', 'vec', 5)},
u as (select query_id, scope, chunk_id, max(v) as v, max(h) as h from (
    select query_id, scope, chunk_id, 1 as v, 0 as h from vec union all
    select query_id, scope, chunk_id, 0, 1 from hyb) group by all)
select query_id, scope, sum(v)::bigint as vector_hits, sum(h)::bigint as hybrid_hits, sum(v * h)::bigint as overlap,
    sum((1 - v) * h)::bigint as bm25_unique from u group by all""")
def vector_vs_hybrid(spark, sf_dir):
    corpus = chunks_by_source(spark, sf_dir)
    asked = dense.embed_texts(queries(spark, sf_dir), "query")
    near = dense.dense_top(asked, dense.embed_texts(corpus), 5)
    return fusion.compare_systems(near, fusion.hybrid(fixed_route(spark, sf_dir), corpus))


@bound("reranked_hits", f"""with {CHUNKS_BY_SOURCE_SQL}, {ROUTED_SQL}, {sql.hybrid('routed', 'chunks')},
g as (select *, count(*) over w >= 5 and round(abs(max(case when rank = 1 then rrf_score end) over w
    - max(case when rank = 2 then rrf_score end) over w), 9) <= 0.02 as reranked
    from hyb window w as (partition by query_id, scope)),
head as (select scope, chunk_id, text from chunks),
{sql.vectors('queries', 'query_id', 'query', 'rq')}, {sql.vectors('head', 'scope, chunk_id', 'text', 'rc')},
d as (select g.query_id, g.scope, g.chunk_id, sum(q.v * c.v) as s from g join rc c using (scope, chunk_id)
    join rq q on q.query_id = g.query_id and q.b = c.b group by all),
s as (select g.*, case when reranked then round(least(greatest(coalesce(s, 0) * 10, 0), 10), 8) end as rs
    from g left join d using (query_id, scope, chunk_id))
select query_id, scope, chunk_id, rank, coalesce(reranked, false) as reranked, round(rs, 6) as rerank_score,
    (row_number() over (partition by query_id, scope order by rs is not null desc, rs desc nulls last, rank))::int
    as new_rank
from s""")
def reranked_hits(spark, sf_dir):
    routed = fusion.route(queries(spark, sf_dir))
    corpus = chunks_by_source(spark, sf_dir)
    hits = fusion.rerank(fusion.hybrid(routed, corpus), queries(spark, sf_dir), corpus)
    return hits.select("query_id", "scope", "chunk_id", "rank", F.coalesce("reranked", F.lit(False)).alias("reranked"),
                       F.round("rerank_score", 6).alias("rerank_score"), "new_rank")


@bound("ask_rerank_gate", f"""with {CHUNKS_BY_SOURCE_SQL}, {ROUTED_SQL}, {sql.hybrid('routed', 'chunks')},
g as (select query_id, scope, count(*) as n_chunks,
    abs(max(case when rank = 1 then rrf_score end) - max(case when rank = 2 then rrf_score end)) as gap from hyb group by all)
select g.query_id, g.scope, g.n_chunks, round(g.gap, 6) as gap,
    coalesce(g.n_chunks >= 5 and {sql.wc(sql.strip('q.query'))} > 3 and round(g.gap, 9) <= 0.01, false) as reranked
from g join queries q using (query_id)""")
def ask_rerank_gate(spark, sf_dir):
    asked = queries(spark, sf_dir)
    hits = fusion.hybrid(fusion.route(asked), chunks_by_source(spark, sf_dir))
    return fusion.ask_gate(hits, asked).withColumn("gap", F.round("gap", 6))


@bound("weighted_sum_retrieval", f"""with {CHUNKS_BY_SOURCE_SQL}, {QUERIES_SQL},
p(variant, prefix, weight) as (values (0, '', 0.6::double), (1, 'Explain ', 0.2::double), (2, 'Key points of ', 0.2::double)),
v as (select q.query_id as qid, q.query_id || '~' || variant as query_id, prefix || query as query, weight
    from queries q cross join p),
{sql.dense('v', 'chunks')}, {sql.ranked('dense', 'near', 5)},
m as (select qid as query_id, scope, chunk_id, sum(score * weight) as score from near join v using (query_id) group by all),
b as (select query_id, scope, chunk_id, score, floor({sql.wc('text')} * 1.5)::int as tokens from m
    join chunks using (scope, chunk_id)),
c as (select *, (row_number() over w)::int as rank, sum(tokens) over (w rows unbounded preceding) as total from b
    window w as (partition by query_id, scope order by round(score, 8) desc, chunk_id))
select query_id, scope, chunk_id, rank, total::bigint as total_tokens, round(score, 6) as score from c where total <= 1500""")
def weighted_sum_retrieval(spark, sf_dir):
    hits = fusion.weighted_sum_retrieval(queries(spark, sf_dir), chunks_by_source(spark, sf_dir), 3)
    return hits.select("query_id", "scope", "chunk_id", "rank", "total_tokens", F.round("score", 6).alias("score"))


# --- diversity and budgets ------------------------------------------------------------

@bound("mmr_selection")
def mmr_selection(spark, sf_dir):
    routed = fusion.route(queries(spark, sf_dir))
    corpus = chunks_by_source(spark, sf_dir)
    hits = search.with_vectors(search.with_text(fusion.hybrid(routed, corpus), corpus))
    kept = diversity.mmr(hits, ["query_id", "scope"], 10)
    return kept.select("query_id", "scope", "chunk_id", "rank", "mmr_rank")


def budget_sql(hits: str, out: str, order: str, limit: int) -> str:
    return f"""
{out}_a as (select h.*, c.text, floor({sql.wc('text')} * 1.5)::int as n from {hits} h join chunks c using (scope, chunk_id)),
{out}_b as (select *, (row_number() over w)::int as context_rank, sum(n) over (w rows unbounded preceding) as total from {out}_a
    window w as (partition by query_id, scope order by {order})),
{out}_c as (select *, {limit} - (total - n) as room, total > {limit} as over,
    sum(case when total > {limit} then 1 else 0 end) over (partition by query_id, scope order by context_rank) as nth
    from {out}_b),
{out}_d as (select *, over and nth = 1 and room > 100 as truncated from {out}_c),
{out} as (select * exclude (text), case when truncated then array_to_string(list_slice({sql.words('text')}, 1,
    floor(room / 1.5)::int), ' ') || '...' else text end as text from {out}_d where not over or truncated)"""


@bound("context_budget", f"""with {CHUNKS_BY_SOURCE_SQL}, {QUERIES_SQL}, {sql.bm25('queries', 'chunks')},
{sql.ranked('bm25', 'best', 10)}, {budget_sql('best', 'ctx', 'round(score, 8) desc, rank', 1500)}
select query_id, scope, chunk_id, context_rank, truncated, floor({sql.wc('text')} * 1.5)::int as used_tokens,
    md5(text) as text_md5 from ctx""")
def context_budget(spark, sf_dir):
    corpus = chunks_by_source(spark, sf_dir)
    hits = search.with_text(lexical.bm25_top(queries(spark, sf_dir), corpus, 10), corpus)
    kept = diversity.context_budget(hits, ["query_id", "scope"], 1500, score="score")
    return kept.select("query_id", "scope", "chunk_id", "context_rank", "truncated", "used_tokens",
                       F.md5("text").alias("text_md5"))


@bound("assembled_context", f"""with {CHUNKS_BY_SOURCE_SQL}, {QUERIES_SQL}, {sql.bm25('queries', 'chunks')},
{sql.ranked('bm25', 'best', 10)}, {budget_sql('best', 'ctx', 'round(score, 8) desc, rank', 1500)}
select query_id, scope, md5(string_agg(text, chr(10) || chr(10) order by context_rank)) as context_md5,
    md5(string_agg('[doc=' || scope || ' chunk=' || chunk_id || ']' || chr(10) || text, chr(10) || chr(10)
        order by context_rank)) as headed_md5 from ctx group by all""")
def assembled_context(spark, sf_dir):
    corpus = chunks_by_source(spark, sf_dir)
    hits = search.with_text(lexical.bm25_top(queries(spark, sf_dir), corpus, 10), corpus)
    kept = diversity.context_budget(hits, ["query_id", "scope"], 1500, score="score")
    plain = F.col("text")
    headed = F.concat(F.lit("[doc="), "scope", F.lit(" chunk="), F.col("chunk_id").cast("string"), F.lit("]\n"), "text")
    rows = F.array_sort(F.collect_list(F.struct("context_rank", plain.alias("p"), headed.alias("h"))))
    return kept.groupBy("query_id", "scope").agg(rows.alias("r")).select(
        "query_id", "scope", F.md5(F.array_join("r.p", "\n\n")).alias("context_md5"),
        F.md5(F.array_join("r.h", "\n\n")).alias("headed_md5"))


@bound("spread_over_sources", f"""with {CHUNKS_BY_SOURCE_SQL}, {QUERIES_SQL}, {sql.bm25('queries', 'chunks')},
{sql.ranked('bm25', 'best', 5)},
pool as (select * from (select query_id, scope, chunk_id, row_number() over (partition by query_id
    order by round(score, 8) desc, scope, chunk_id) as pool_rank from best) where pool_rank <= 20),
o as (select *, case when row_number() over (partition by query_id, scope order by pool_rank) > 1 then 1 else 0 end as over
    from pool),
r as (select *, (row_number() over (partition by query_id order by over, pool_rank))::int as spread_rank,
    sum(1 - over) over (partition by query_id) as own from o)
select query_id, scope, chunk_id, spread_rank from r where spread_rank <= 3 and (over = 0 or own < 3)""")
def spread_over_sources(spark, sf_dir):
    hits = lexical.bm25_top(queries(spark, sf_dir), chunks_by_source(spark, sf_dir), 5)
    order = [F.desc(F.round("score", 8)), F.asc("scope"), F.asc("chunk_id")]
    pool = lexical.top_k(hits, ["query_id"], order, 20, "pool_rank")
    spread = diversity.spread_over_scopes(pool, "query_id", "pool_rank", 3, 1)
    return spread.select("query_id", "scope", "chunk_id", "spread_rank")


# --- relevance and confidence ------------------------------------------------------------

BOOST_SQL = f"""bags as (select *, regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}_]+') as bag from chunks),
k as (select query_id, query, {sql.keywords('query')} as keys from queries),
body as (select h.query_id, h.scope, h.chunk_id, h.rrf_score, h.rank, h.bm25_rank, lower(' ' || c.text) as body, k.keys,
    len(list_filter(k.keys, lambda x: list_contains(c.bag, x)))::int
    as hits from hyb h join bags c using (scope, chunk_id) join k using (query_id)),
rel as (select *, rrf_score + least(0.04 * hits, 0.2) as boosted,
    array_to_string(list_slice(keys, 1, 3), ' ') as phrase from body),
scored as (select *, case when len(keys) = 0 then least(boosted * 20, 1) else
    0.5 * hits / len(keys) + 0.2 * least(boosted * 20, 1)
    + case when phrase <> '' and contains(body, phrase) then 0.3 else 0 end end as relevance from rel)"""


@bound("relevance_scores", f"""with {CHUNKS_BY_SOURCE_SQL}, {FIXED_ROUTE_SQL}, {sql.hybrid('routed', 'chunks')}, {BOOST_SQL}
select query_id, scope, chunk_id, hits, round(boosted, 6) as boosted, round(relevance, 6) as relevance,
    round(hits / greatest(len(keys), 1), 6) as coverage from scored""")
def relevance_scores(spark, sf_dir):
    corpus = chunks_by_source(spark, sf_dir)
    hits = fusion.hybrid(fixed_route(spark, sf_dir), corpus)
    rows = search.with_text(hits, corpus).join(
        queries(spark, sf_dir).select("query_id", tx.keywords(F.col("query")).alias("keys")), "query_id")
    body = F.concat_ws(" ", "section", "text")
    rows = rows.withColumn("hits", tx.keyword_hits(F.col("keys"), body))
    boosted = F.col("rrf_score") + sc.keyword_boost(F.col("hits"))
    return rows.select(
        "query_id", "scope", "chunk_id", "hits", F.round(boosted, 6).alias("boosted"),
        F.round(sc.relevance(boosted, F.col("hits"), F.col("keys"), body), 6).alias("relevance"),
        F.round(sc.keyword_coverage(F.col("hits"), F.col("keys")), 6).alias("coverage"))


@bound("retrieval_confidence", f"""with {CHUNKS_BY_SOURCE_SQL}, {ROUTED_SQL}, {sql.hybrid('routed', 'chunks')},
g as (select query_id, scope, max(rrf_score) as top, avg(rrf_score) as av, count(*) as n from hyb group by all),
c as (select *, case when n >= 3 and av > 0.03 then least(least(greatest(top / 0.1, 0), 1) + 0.1, 1)
    else least(greatest(top / 0.1, 0), 1) end as r from g),
s as (select query_id, scope, n as n_chunks, round(0.5 * r + 0.3 * 0.5 + 0.2 * 0.6, 3) as confidence from c)
select *, case when confidence >= 0.7 then 'high' when confidence >= 0.4 then 'medium' else 'low' end as level,
    confidence < 0.5 as fallback from s""")
def retrieval_confidence(spark, sf_dir):
    hits = fusion.hybrid(fusion.route(queries(spark, sf_dir)), chunks_by_source(spark, sf_dir))
    judged = search.confidence_per_group(hits, ["query_id", "scope"])
    return judged.select("query_id", "scope", "n_chunks", "confidence", "level",
                         sc.falls_back(F.col("confidence")).alias("fallback"))


# --- whole searches ------------------------------------------------------------------------

@bound("keyword_search", f"""with {CHUNKS_BY_SOURCE_SQL}, {QUERIES_SQL},
{sql.bm25('queries', 'chunks')}, {sql.ranked('bm25', 'best', 10)}
select query_id, scope, chunk_id, rank, substr(text, 1, 300) as text, '' as section, 1 as page,
    round(score, 4) as score, 'text' as type from best join chunks using (scope, chunk_id)""")
def keyword_search(spark, sf_dir):
    return search.keyword_search(queries(spark, sf_dir), chunks_by_source(spark, sf_dir))


@bound("search_all_modes")
def search_all_modes(spark, sf_dir):
    modes = F.array(*[F.lit(m) for m in ("auto", "keyword", "hybrid")])
    asked = queries(spark, sf_dir).withColumn("mode", F.explode(modes)).withColumn(
        "query_id", F.concat_ws("/", F.col("query_id").cast("string"), "mode"))
    return search.search(asked, chunks_by_source(spark, sf_dir))


@bound("ai_search_answers")
def ai_search_answers(spark, sf_dir):
    routed = fusion.route(queries(spark, sf_dir))
    found = search.ai_search(routed, chunks_by_source(spark, sf_dir))
    return found.select("query_id", "scope", "n_chunks", "confidence", "level", "fallback",
                        F.length("context").alias("context_chars"), F.size("sources").alias("n_sources"))


@bound("search_across_sources", f"""with {CHUNKS_BY_SOURCE_SQL}, {QUERIES_SQL},
{sql.bm25('queries', 'chunks')}, {sql.ranked('bm25', 'best', 10)},
st as (select scope, case when count(*) filter (lang = 'en') * 2 > count(*) then 'ready' else 'partially_ready' end as status
    from (select source as scope, lang from documents) group by scope),
m as (select b.query_id, b.scope, b.chunk_id, st.status,
    case when st.status = 'partially_ready' then score * 0.75 else score end as score from best b join st using (scope)),
r as (select *, (row_number() over (partition by query_id order by round(score, 6) desc, scope, chunk_id))::int
    as merged_rank from m)
select query_id, scope, chunk_id, status, merged_rank, round(score, 4) as score from r where merged_rank <= 10""")
def search_across_sources(spark, sf_dir):
    corpus = chunks_by_source(spark, sf_dir)
    hits = lexical.bm25_top(queries(spark, sf_dir), corpus, 10)
    english = F.count(F.when(F.col("lang") == "en", 1)) * 2 > F.count("*")
    scopes = corpus.groupBy("scope").agg(english.alias("_e")).select(
        "scope", F.when(F.col("_e"), "ready").otherwise("partially_ready").alias("status"))
    merged = search.across_scopes(hits, scopes, 10)
    return merged.select("query_id", "scope", "chunk_id", "status", "merged_rank", F.round("score", 4).alias("score"))


@bound("library_ask")
def library_ask(spark, sf_dir):
    return ask.ask(queries(spark, sf_dir), chunks_by_source(spark, sf_dir))


@bound("library_context_hits")
def library_context_hits(spark, sf_dir):
    context = ask.library_context(ask.prepare(queries(spark, sf_dir)), chunks_by_source(spark, sf_dir))
    return context.select("query_id", "scope", "chunk_id", "context_rank", "truncated", "used_tokens",
                          F.round("rrf_score", 6).alias("rrf_score"), F.round("relevance", 6).alias("relevance"))


@bound("highlighted_hits")
def highlighted_hits(spark, sf_dir):
    corpus = chunks_by_source(spark, sf_dir)
    asked = queries(spark, sf_dir)
    hits = lexical.bm25_top(asked, corpus, 3).join(asked, "query_id")
    rows = search.with_text(hits, corpus)
    return rows.select("query_id", "scope", "chunk_id", "rank",
                       tx.highlight(F.col("text"), F.col("query")).alias("snippet"))
