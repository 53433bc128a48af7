"""Retrieval evaluation of the benchmark passages against the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from quillspark.functions import scoring as sc, text as tx
from quillspark.functions.vectors import cosine, hashing_embedder
from quillspark.operators import dense, evaluation as ev, quality
from quillspark.operators.lexical import bm25_top
from quillspark.operators.ordered import order_statistics
from quillspark.plans import search
from quillspark.plans.lineage import cut
from quillspark.workloads import sql
from quillspark.workloads.documents import GROUPS_SQL, QUALITY_SQL, document_chunks, positioned_chunks
from quillspark.workloads.retrieval import FIXED_ROUTE_SQL, VECTOR_SQL, fixed_route, label_centroids, vector_corpus
from quillspark.workloads.tables import CHUNKS_WHOLE_SQL, QUERIES_SQL, chunks_whole, queries, read

QUERIES, ORACLES = {}, {}
SYSTEMS = ["vector", "bm25", "hybrid"]


def bound(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return add


def gold(spark, sf_dir) -> DataFrame:
    return cut(ev.passage_gold(queries(spark, sf_dir), chunks_whole(spark, sf_dir)))


def results(spark, sf_dir) -> DataFrame:
    """The few hits of every system, written once: every report reads them several times."""
    return cut(ev.system_results(fixed_route(spark, sf_dir), chunks_whole(spark, sf_dir), 5))


def reranked(spark, sf_dir, res: DataFrame | None = None) -> DataFrame:
    res = res if res is not None else results(spark, sf_dir)
    return cut(ev.with_reranked(res, queries(spark, sf_dir), chunks_whole(spark, sf_dir)))


def metrics(spark, sf_dir, res: DataFrame | None = None, labelled: DataFrame | None = None) -> DataFrame:
    res = res if res is not None else results(spark, sf_dir)
    labelled = labelled if labelled is not None else gold(spark, sf_dir)
    return ev.query_metrics(res, labelled, queries(spark, sf_dir), SYSTEMS)


def kind():
    """Query type: out of scope without gold, else one of three by id."""
    return F.when(F.col("n_gold") == 0, "adversarial").otherwise(F.element_at(
        F.array(F.lit("factual"), F.lit("conceptual"), F.lit("multi-hop")), (F.col("query_id") % 3 + 1).cast("int")))


GOLD_SQL = f"""dw as (select doc_id as chunk_id, ' ' || array_to_string({sql.words('text')}, ' ') || ' ' as hay from documents),
qw as (select item_id as query_id, ' ' || array_to_string({sql.words('text')}, ' ') || ' ' as needle from benchmark),
gold as (select query_id, chunk_id from qw join dw on contains(hay, needle))"""

EVAL_SQL = f"""{CHUNKS_WHOLE_SQL}, {FIXED_ROUTE_SQL}, {GOLD_SQL}, {sql.hybrid('routed', 'chunks')},
{sql.bm25('queries', 'chunks', 'bq')}, {sql.ranked('bq', 'bqr', 5)},
{sql.dense('queries', 'chunks', 'dq')}, {sql.ranked('dq', 'dqr', 5)},
res as (select query_id, scope, chunk_id, 'vector' as system, rank, score from dqr
    union all select query_id, scope, chunk_id, 'bm25', rank, score from bqr
    union all select query_id, scope, chunk_id, 'hybrid', rank, rrf_score from hyb),
ng as (select query_id, count(distinct chunk_id) as n_gold from gold group by query_id),
hit as (select query_id, system, count(*) filter (g.chunk_id is not null and rank <= 3) as h3,
    count(*) filter (g.chunk_id is not null) as h5, min(rank) filter (g.chunk_id is not null) as f
    from res left join gold g using (query_id, chunk_id) group by all),
met as (select q.query_id, s.system, coalesce(n_gold, 0) as n_gold, coalesce(h3 / n_gold, 0) as recall3,
    coalesce(h5 / n_gold, 0) as recall5, coalesce(1 / f, 0) as mrr
    from queries q cross join (values ('vector'), ('bm25'), ('hybrid')) s(system)
    left join hit using (query_id, system) left join ng using (query_id))"""

RERANK_SQL = f"""rg as (select *, count(*) over w >= 5 and round(abs(max(case when rank = 1 then rrf_score end) over w
    - max(case when rank = 2 then rrf_score end) over w), 9) <= 0.02 as on_ from hyb window w as (partition by query_id)),
rh as (select scope, chunk_id, text from chunks),
{sql.vectors('queries', 'query_id', 'query', 'rq')}, {sql.vectors('rh', 'scope, chunk_id', 'text', 'rc')},
rd as (select h.query_id, h.chunk_id, sum(q.v * c.v) as s from hyb h join rc c using (scope, chunk_id)
    join rq q on q.query_id = h.query_id and q.b = c.b group by all),
rs as (select g.*, case when on_ then round(least(greatest(coalesce(s, 0) * 10, 0), 10), 8) end as rs
    from rg g left join rd using (query_id, chunk_id)),
rr as (select *, row_number() over (partition by query_id order by rs is not null desc, rs desc nulls last, rank) as nr from rs)"""


@bound("passage_gold", f"with {GOLD_SQL} select query_id, chunk_id from gold")
def passage_gold(spark, sf_dir):
    return gold(spark, sf_dir)


@bound("query_metrics", f"""with {EVAL_SQL} select query_id, system, n_gold, round(recall3, 6) as recall3,
    round(recall5, 6) as recall5, round(mrr, 6) as mrr from met""")
def query_metrics(spark, sf_dir):
    m = metrics(spark, sf_dir)
    return m.withColumns({c: F.round(c, 6) for c in ("recall3", "recall5", "mrr")})


@bound("system_ablation", f"""with {EVAL_SQL} select system, count(*) as queries, round(avg(recall3), 4) as recall3,
    round(avg(recall5), 4) as recall5, round(avg(mrr), 4) as mrr from met where n_gold > 0 group by system""")
def system_ablation(spark, sf_dir):
    return ev.ablation(metrics(spark, sf_dir).where("n_gold > 0"))


@bound("dataset_averages", f"""with {EVAL_SQL}, d as (select query_id % 2 as dataset, system, avg(recall3) as a, avg(recall5) as b, avg(mrr) as c
    from met where n_gold > 0 group by all)
select system, count(*) as datasets, round(avg(a), 4) as recall3, round(avg(b), 4) as recall5, round(avg(c), 4) as mrr from d group by system""")
def dataset_averages(spark, sf_dir):
    return ev.dataset_averages(metrics(spark, sf_dir).where("n_gold > 0").withColumn("dataset", F.col("query_id") % 2))


@bound("ablation_with_pseudo_gold", f"""with {EVAL_SQL}, {RERANK_SQL},
pg as (select query_id, chunk_id, false as circular from gold union all
    select query_id, chunk_id, true from hyb where query_id not in (select query_id from gold)),
r4 as (select query_id, chunk_id, system, rank from res union all select query_id, chunk_id, 'reranked', nr from rr),
n2 as (select query_id, count(distinct chunk_id) as n, bool_or(circular) as circular from pg group by query_id),
h2 as (select query_id, system, count(*) filter (g.chunk_id is not null) as h5, min(rank) filter (g.chunk_id is not null) as f
    from r4 left join pg g using (query_id, chunk_id) group by all),
m2 as (select q.query_id, s.system, circular, coalesce(h5 / n, 0) as r, coalesce(1 / f, 0) as mrr from queries q
    cross join (values ('vector'), ('hybrid'), ('reranked')) s(system) left join h2 using (query_id, system) join n2 using (query_id)),
a as (select circular, count(distinct query_id) as queries,
    {', '.join(f"round(avg({m}) filter (system = '{s}'), 4) as {s}_{m2}" for s in ('vector', 'hybrid', 'reranked') for m, m2 in (('r', 'recall5'), ('mrr', 'mrr')))}
    from m2 group by circular)
select *, round((hybrid_recall5 - vector_recall5) / greatest(vector_recall5, 0.001) * 100, 1) as hybrid_gain_pct,
    round((reranked_recall5 - hybrid_recall5) / greatest(hybrid_recall5, 0.001) * 100, 1) as rerank_gain_pct from a""")
def ablation_with_pseudo_gold(spark, sf_dir):
    """Three systems with unlabelled queries judged by the fused list itself, kept apart."""
    res = reranked(spark, sf_dir)
    labelled = cut(ev.pseudo_gold(gold(spark, sf_dir), res))
    names = ["vector", "hybrid", "reranked"]
    per_query = ev.query_metrics(res, labelled, queries(spark, sf_dir), names).join(
        labelled.select("query_id", "circular").distinct(), "query_id")
    wide = per_query.groupBy("circular").agg(
        F.countDistinct("query_id").alias("queries"),
        *[F.round(F.avg(F.when(F.col("system") == s, F.col(m))), 4).alias(f"{s}_{m}") for s in names for m in ("recall5", "mrr")])
    return wide.withColumns({
        "hybrid_gain_pct": ev.improvement_pct(F.col("hybrid_recall5"), F.col("vector_recall5")),
        "rerank_gain_pct": ev.improvement_pct(F.col("reranked_recall5"), F.col("hybrid_recall5"))})


@bound("rerank_impact", f"""with {EVAL_SQL}, {RERANK_SQL},
c as (select query_id, count(*) filter (rank <= 3 and g.chunk_id is not null) as b, count(*) filter (nr <= 3 and g.chunk_id is not null) as a
    from rr left join gold g using (query_id, chunk_id) group by query_id)
select q.query_id, coalesce(b, 0) as before_hits, coalesce(a, 0) as after_hits, case when coalesce(b, 0) = 0 and coalesce(a, 0) > 0
    then 'improved' when coalesce(b, 0) > 0 and coalesce(a, 0) = 0 then 'degraded' else 'same' end as impact,
    coalesce(a, 0) > coalesce(b, 0) as more_hits, coalesce(a, 0) = coalesce(b, 0) as equal_hits from queries q left join c using (query_id)""")
def rerank_impact(spark, sf_dir):
    return ev.rerank_impact(reranked(spark, sf_dir), gold(spark, sf_dir), queries(spark, sf_dir))


@bound("rerank_order_changes", f"""with {EVAL_SQL}, {RERANK_SQL},
o as (select query_id, string_agg(chunk_id, ',' order by rank) as before_ids, string_agg(chunk_id, ',' order by nr) as after_ids
    from rr group by query_id) select *, before_ids <> after_ids as ranking_changed from o""")
def rerank_order_changes(spark, sf_dir):
    return ev.order_changes(reranked(spark, sf_dir))


# --- answers --------------------------------------------------------------------------

def responses(spark, sf_dir) -> DataFrame:
    """Extractive answers of the best keyword hit; odd out-of-scope items decline."""
    corpus = chunks_whole(spark, sf_dir)
    best = search.with_text(bm25_top(queries(spark, sf_dir), corpus, 1), corpus)
    scope = gold(spark, sf_dir).select("query_id").distinct().withColumn("in_scope", F.lit(True))
    rows = queries(spark, sf_dir).join(best.select("query_id", "text"), "query_id", "left").join(scope, "query_id", "left")
    rows = rows.withColumn("in_scope", F.coalesce("in_scope", F.lit(False)))
    answer = F.when(~F.col("in_scope") & (F.col("query_id") % 2 == 1), "Not found in the document.").otherwise(
        sc.extractive_answer(F.coalesce("text", F.lit(""))))
    return rows.select("query_id", answer.alias("answer"), F.coalesce("text", F.lit("")).alias("context"),
                       F.array_join(F.slice(tx.sentences(F.col("query")), 1, 3), " ").alias("expected"), "in_scope")


RESPONSES_SQL = f"""{CHUNKS_WHOLE_SQL}, {QUERIES_SQL}, {GOLD_SQL}, {sql.bm25('queries', 'chunks')}, {sql.ranked('bm25', 'best', 1)},
r0 as (select q.query_id, q.query, coalesce(c.text, '') as context, q.query_id in (select query_id from gold) as in_scope
    from queries q left join best b using (query_id) left join chunks c on c.chunk_id = b.chunk_id),
r1 as (select *, array_to_string(list_slice({sql.sentences(sql.strip('context'))}, 1, 3), ' ') as body from r0),
resp as (select query_id, context, in_scope, array_to_string(list_slice({sql.sentences('query')}, 1, 3), ' ') as expected,
    case when not in_scope and query_id % 2 = 1 then 'Not found in the document.' else coalesce(nullif(
    case when length(body) > 900 then substr(body, 1, 897) || '...' else body end, ''), 'Not found in your documents') end as answer from r1),
ws as (select *, list_distinct({sql.words('lower(answer)')}) as aw, list_distinct({sql.words('lower(context)')}) as cw from resp),
gr as (select *, case when len(aw) = 0 then 1 else len(list_intersect(aw, cw)) / len(aw) end as grounding from ws)"""


@bound("answer_grounding", f"""with {RESPONSES_SQL} select query_id, in_scope, answer, round(grounding, 6) as grounding,
    lower(trim(answer)) = lower(trim(expected)) as exact, grounding < 0.3 as hallucinated from gr""")
def answer_grounding(spark, sf_dir):
    value = ev.grounding(F.col("answer"), F.col("context"))
    return responses(spark, sf_dir).select(
        "query_id", "in_scope", "answer", F.round(value, 6).alias("grounding"),
        ev.exact_match(F.col("answer"), F.col("expected")).alias("exact"), (value < 0.3).alias("hallucinated"))


@bound("answer_metrics", f"""with {RESPONSES_SQL} select round(avg((lower(trim(answer)) = lower(trim(expected)))::int), 4) as accuracy,
    round(avg((grounding < 0.3)::int), 4) as hallucination_rate,
    round(avg(((contains(lower(answer), 'not found') or contains(lower(answer), 'not in document') or contains(lower(answer), 'could not be found'))
        <> in_scope)::int), 4) as not_found_accuracy,
    round(avg((contains(lower(answer), 'not found'))::int) filter (not in_scope), 4) as not_found_accuracy_run from gr""")
def answer_metrics(spark, sf_dir):
    return ev.answer_metrics(responses(spark, sf_dir))


SIM_SQL = sql.vectors('av', 'query_id', 'answer', 'sa') + "," + sql.vectors('av', 'query_id', 'expected', 'se') + """,
sim as (select av.query_id, coalesce(sum(a.v * e.v), 0) as s from av left join sa a using (query_id)
    left join se e on e.query_id = av.query_id and e.b = a.b group by av.query_id)"""


@bound("failure_categories", f"""with {RESPONSES_SQL}, av as (select * from resp), {SIM_SQL},
c as (select query_id, round(s, 6) as similarity, case when contains(lower(answer), 'not enough context') or context = '' then 'retrieval_failure'
    when in_scope and expected <> '' and round(s, 6) < 0.65 then 'generation_failure'
    when in_scope and expected <> '' and (query_id % 10) / 10 < 0.5 then 'confidence_mismatch' else 'success' end as category
    from resp join sim using (query_id))
select category, count(*) as cases, round(count(*) / sum(count(*)) over () * 100, 1) as pct, round(avg(similarity), 3) as avg_similarity
from c group by category""")
def failure_categories(spark, sf_dir):
    embed = hashing_embedder()
    rows = responses(spark, sf_dir).withColumns({
        "_a": embed(tx.tokenize(F.col("answer"))), "_e": embed(tx.tokenize(F.col("expected")))})
    rows = rows.withColumn("similarity", F.round(cosine(F.col("_a"), F.col("_e")), 6))
    category = ev.failure_category(
        F.when(F.col("context") == "", 0).otherwise(1), F.col("answer"),
        F.when(F.col("in_scope"), F.col("expected")).otherwise("NOT_IN_DOCUMENT"), F.col("similarity"),
        (F.col("query_id") % 10) / 10)
    counted = rows.groupBy(category.alias("category")).agg(F.count("*").alias("cases"), F.round(F.avg("similarity"), 3).alias("avg_similarity"))
    # Four categories at most, so the total is a window over four rows.
    total = F.sum("cases").over(Window.partitionBy(F.lit(1)))
    return counted.select("category", "cases", F.round(F.col("cases") / total * 100, 1).alias("pct"), "avg_similarity")


def predictions(spark, sf_dir) -> DataFrame:
    """Labelled documents, confident in proportion to their length, right when their quality is 1."""
    # Counted before the join, which so moves no text.
    docs = read(spark, sf_dir, "documents").select("doc_id", F.least(F.lit(1.0), tx.word_count(F.col("text")) / 400).alias("confidence"))
    return docs.join(read(spark, sf_dir, "labels"), "doc_id").select("confidence", (F.col("quality") == 1).alias("correct"))


PRED_SQL = f"""p as (select least(1.0, {sql.wc('text')} / 400) as c, quality = 1 as ok from documents join labels using (doc_id))"""


@bound("calibration_bands", f"""with {PRED_SQL} select case when c > 0.8 then 'high' when c > 0.5 then 'medium' else 'low' end as band,
    count(*) as samples, round(avg(ok::int), 4) as accuracy from p group by band""")
def calibration_bands(spark, sf_dir):
    return ev.calibration(predictions(spark, sf_dir))


@bound("calibration_factor", f"""with {PRED_SQL}, h as (select count(*) filter (c > 0.8) as high_samples, coalesce(avg(ok::int) filter (c > 0.8), 0) as a from p)
select high_samples, round(a, 4) as high_accuracy, case when high_samples >= 3 and a < 0.7 then 0.85::double else 1.0::double end as factor,
    a >= 0.7 as well_calibrated from h""")
def calibration_factor(spark, sf_dir):
    return ev.calibration_factor(predictions(spark, sf_dir))


# --- harness ------------------------------------------------------------------------------

def harness_queries(spark, sf_dir) -> DataFrame:
    return queries(spark, sf_dir).withColumns({
        "expected": F.col("query"), "key_terms": F.array_distinct(tx.keywords(F.col("query")))})


def harness(spark, sf_dir) -> DataFrame:
    res = results(spark, sf_dir)
    details = ev.harness_details(res, harness_queries(spark, sf_dir), chunks_whole(spark, sf_dir))
    per_query = ev.query_metrics(res, gold(spark, sf_dir), queries(spark, sf_dir), SYSTEMS)
    joined = per_query.join(details, ["query_id", "system"], "left")
    return joined.withColumns({"type": kind(), "similarity": F.round("similarity", 6), "coverage": F.round("coverage", 6)})


HARNESS_SQL = f"""{EVAL_SQL},
sh as (select r.query_id, r.system, r.rank, r.score, c.text as t from res r join chunks c using (scope, chunk_id) where rank <= 3),
bt as (select query_id, system, any_value(score) filter (rank = 1) as top_score, any_value(t) filter (rank = 1) as text,
    lower(string_agg(t, ' ' order by rank)) as alltext from sh group by all),
{sql.vectors('bt', 'query_id, system', 'text', 'bv')}, {sql.vectors('queries', 'query_id', 'query', 'ex')},
sm as (select b.query_id, b.system, sum(b.v * e.v) as s from bv b join ex e on e.query_id = b.query_id and e.b = b.b group by all),
kt as (select query_id, list_distinct({sql.keywords('query')}) as keys from queries),
det as (select bt.query_id, bt.system, top_score, round(coalesce(s, 0), 6) as similarity,
    round(case when len(keys) > 0 then len(list_filter(keys, lambda k: contains(alltext, k))) / len(keys) end, 6) as coverage
    from bt left join sm using (query_id, system) join kt using (query_id)),
har as (select m.*, top_score, similarity, coverage, case when n_gold = 0 then 'adversarial'
    else {sql.lst(['factual', 'conceptual', 'multi-hop'])}[query_id % 3 + 1] end as type from met m left join det using (query_id, system))"""


@bound("harness_details", f"""with {HARNESS_SQL} select query_id, system, type, similarity, coverage, round(recall5, 6) as recall5 from har""")
def harness_details(spark, sf_dir):
    return harness(spark, sf_dir).select("query_id", "system", "type", "similarity", "coverage", F.round("recall5", 6).alias("recall5"))


@bound("harness_systems", f"""with {HARNESS_SQL} select system, round(avg(recall3) filter (n_gold > 0), 4) as recall3,
    round(avg(recall5) filter (n_gold > 0), 4) as recall5, round(avg(mrr) filter (n_gold > 0), 4) as mrr,
    round(avg(similarity) filter (type <> 'adversarial'), 4) as avg_similarity, round(avg(coverage), 4) as avg_coverage,
    round(count(*) filter (type <> 'adversarial' and similarity < 0.3 and coverage < 0.3) / count(*) filter (type <> 'adversarial') * 100, 1)
    as hallucination_pct from har group by system""")
def harness_systems(spark, sf_dir):
    scope = F.col("type") != "adversarial"
    weak = scope & (F.col("similarity") < 0.3) & (F.col("coverage") < 0.3)
    means = [F.round(F.avg(F.when(scope, F.col(c))), 4).alias(c) for c in ("recall3", "recall5", "mrr")]
    return harness(spark, sf_dir).groupBy("system").agg(
        *means, F.round(F.avg(F.when(scope, F.col("similarity"))), 4).alias("avg_similarity"),
        F.round(F.avg("coverage"), 4).alias("avg_coverage"),
        F.round(F.count_if(weak) / F.count_if(scope) * 100, 1).alias("hallucination_pct"))


def judged(spark, sf_dir) -> DataFrame:
    """Trust, correctness and failure category of every query (fused system)."""
    res = results(spark, sf_dir)
    details = ev.harness_details(res, harness_queries(spark, sf_dir), chunks_whole(spark, sf_dir)).where("system = 'hybrid'")
    per_query = ev.query_metrics(res, gold(spark, sf_dir), queries(spark, sf_dir), ["hybrid"])
    rows = per_query.join(ev.trust(res), "query_id", "left").join(details.drop("system"), "query_id", "left").fillna(
        0.0, ["top_vector", "top_rrf", "overlap", "similarity", "coverage"])
    rows = rows.withColumns({"type": kind(), "similarity": F.round("similarity", 6), "coverage": F.round("coverage", 6)})
    adversarial = F.col("type") == "adversarial"
    rows = rows.withColumn("correct", ev.is_correct(adversarial, F.round("top_vector", 6), F.col("recall5")))
    return rows.withColumn("failure", ev.failure_export(adversarial, F.col("correct"), F.col("similarity"), F.col("coverage")))


JUDGED_SQL = f"""{HARNESS_SQL},
ov as (select v.query_id, count(*) as o from res v join res h on h.query_id = v.query_id and h.chunk_id = v.chunk_id
    where v.system = 'vector' and h.system = 'hybrid' and v.rank <= 3 and h.rank <= 3 group by v.query_id),
tp as (select query_id, max(score) filter (system = 'vector' and rank = 1) as tv, max(score) filter (system = 'hybrid' and rank = 1) as th
    from res group by query_id),
tr as (select tp.query_id, tv, round(0.4 * least(tv / 0.5, 1) + 0.3 * least(th / 0.1, 1) + 0.3 * coalesce(o, 0) / 3, 6) as trust
    from tp left join ov using (query_id)),
jd as (select h.query_id, type, similarity, coverage, trust, recall5, case when trust > 0.7 then 'high' when trust > 0.4 then 'medium' else 'low' end as level,
    case when type = 'adversarial' then round(tv, 6) < 0.25 else recall5 > 0 end as correct from har h join tr using (query_id) where system = 'hybrid'),
jf as (select *, case when type <> 'adversarial' and not correct then 'retrieval_miss' when type = 'adversarial' and not correct then 'false_positive'
    when type <> 'adversarial' and similarity < 0.3 and coverage < 0.3 then 'hallucination_risk' end as failure from jd)"""


@bound("trust_levels", f"""with {JUDGED_SQL} select level, count(*) as queries, count(*) filter (correct) as correct,
    round(count(*) filter (correct) / count(*) * 100, 1) as accuracy_pct from jf group by level""")
def trust_levels(spark, sf_dir):
    return judged(spark, sf_dir).groupBy("level").agg(
        F.count("*").alias("queries"), F.count_if("correct").alias("correct"),
        F.round(F.count_if("correct") / F.count("*") * 100, 1).alias("accuracy_pct"))


@bound("type_breakdown", f"""with {JUDGED_SQL} select type, count(*) as queries, round(avg(similarity), 4) as avg_similarity,
    round(avg(coverage), 4) as avg_coverage, round(count(*) filter (correct) / count(*) * 100, 1) as correct_pct,
    round(count(*) filter (case when type = 'factual' then coverage >= 0.5 else similarity >= 0.4 end) / count(*) * 100, 1) as answer_accuracy
    from jf group by type""")
def type_breakdown(spark, sf_dir):
    right = F.when(F.col("type") == "factual", F.col("coverage") >= 0.5).otherwise(F.col("similarity") >= 0.4)
    return judged(spark, sf_dir).groupBy("type").agg(
        F.count("*").alias("queries"), F.round(F.avg("similarity"), 4).alias("avg_similarity"),
        F.round(F.avg("coverage"), 4).alias("avg_coverage"),
        F.round(F.count_if("correct") / F.count("*") * 100, 1).alias("correct_pct"),
        F.round(F.count_if(right) / F.count("*") * 100, 1).alias("answer_accuracy"))


@bound("failure_export", f"""with {JUDGED_SQL} select query_id, type, failure, similarity, coverage, trust, level from jf where failure is not null""")
def failure_export(spark, sf_dir):
    return judged(spark, sf_dir).where("failure is not null").select(
        "query_id", "type", "failure", "similarity", "coverage", "trust", "level")


@bound("latency_percentiles", """with r as (select event_type, value, row_number() over (partition by event_type order by value) - 1 as i,
    count(*) over (partition by event_type) as n, avg(value) over (partition by event_type) as m from events where value is not null)
select event_type, any_value(n) as n, round(any_value(m), 4) as mean, max(value) filter (i = n // 2) as p50,
    max(value) filter (i = floor(n * 0.95::double)) as p95 from r group by event_type""")
def latency_percentiles(spark, sf_dir):
    stats = ev.latency_summary(read(spark, sf_dir, "events"), "event_type", "value")
    return stats.select("event_type", "n", F.round("mean", 4).alias("mean"), "p50", "p95")


# --- stability, gates, audit -------------------------------------------------------------------

SAMPLES_SQL = """drawn as (select q.query_id, r.run::int as run, row_number() over (partition by r.run order by md5('s|' || r.run || '|' || q.query_id)) as i,
    count(*) over (partition by r.run) as n from (select item_id as query_id from benchmark) q cross join range(1, 4) r(run)),
kept as (select run, query_id from drawn where i <= greatest(1, floor(n * 0.8::double)))"""


@bound("sampled_runs", f"with {SAMPLES_SQL} select run, query_id from kept")
def sampled_runs(spark, sf_dir):
    return ev.sampled_runs(queries(spark, sf_dir))


def run_metrics(spark, sf_dir, res: DataFrame | None = None, labelled: DataFrame | None = None) -> DataFrame:
    per_query = metrics(spark, sf_dir, res, labelled).where("n_gold > 0")
    return ev.sampled_runs(queries(spark, sf_dir)).join(per_query, "query_id").groupBy("run", "system").agg(
        F.avg("recall5").alias("recall5"), F.avg("mrr").alias("mrr"))


STABLE_SQL = f"""{SAMPLES_SQL}, rm as (select run, system, avg(recall5) as recall5, avg(mrr) as mrr from kept join met using (query_id)
    where n_gold > 0 group by all),
stab as (select system, count(*) as runs, round(avg(recall5), 4) as recall_mean, round(stddev_pop(recall5), 4) as recall_std,
    round(avg(mrr), 4) as mrr_mean, stddev_pop(recall5) < 0.05 as stable from rm group by system)"""


@bound("stability_report", f"with {EVAL_SQL}, {STABLE_SQL} select * from stab")
def stability_report(spark, sf_dir):
    return ev.stability(run_metrics(spark, sf_dir))


@bound("acceptance_gate", f"""with {EVAL_SQL}, {RERANK_SQL}, {STABLE_SQL}, {PRED_SQL}, {QUALITY_SQL},
rk as (select avg(coalesce(h / n_gold, 0)) as r from ng left join (select query_id, count(*) as h from rr join gold using (query_id, chunk_id)
    group by query_id) using (query_id)),
f as (select (select avg(recall5) from met where system = 'vector' and n_gold > 0) as b, (select avg(recall5) from met where system = 'hybrid' and n_gold > 0) as h,
    (select r from rk) as r, (select coalesce(avg(ok::int) filter (c > 0.8), 0) from p) as hc, (select avg((passed >= 3)::int) from q) as cq,
    (select stable from stab where system = 'hybrid') as st),
k as (select round(h, 6) > round(b, 6) or (h >= 0.95 and b >= 0.95) as hybrid_gt_baseline, round(r, 6) >= round(h, 6) as reranked_gte_hybrid, hc > 0.7 as high_conf_accuracy_gt_70,
    cq > 0.8 as chunk_quality_gt_80, st as stability_std_lt_005 from f)
select *, case when hybrid_gt_baseline and reranked_gte_hybrid and high_conf_accuracy_gt_70 and chunk_quality_gt_80 and stability_std_lt_005
    then 'VALIDATED' else 'NEEDS_IMPROVEMENT' end as verdict from k""")
def acceptance_gate(spark, sf_dir):
    """Four aggregates as named figures, folded into one row of criteria."""
    base, labelled = results(spark, sf_dir), gold(spark, sf_dir)
    per_query = ev.query_metrics(reranked(spark, sf_dir, base), labelled, queries(spark, sf_dir), [*SYSTEMS, "reranked"]).where("n_gold > 0")
    recall = per_query.groupBy("system").agg(F.round(F.avg("recall5"), 6).alias("v")).select(F.col("system").alias("name"), "v")
    high = ev.calibration_factor(predictions(spark, sf_dir)).select(F.lit("high").alias("name"), F.col("high_accuracy").alias("v"))
    checked = quality.checks(positioned_chunks(spark, sf_dir)).agg(F.avg(F.col("valid").cast("int")).alias("v")).select(
        F.lit("quality").alias("name"), "v")
    stable = ev.stability(run_metrics(spark, sf_dir, base, labelled)).where("system = 'hybrid'").select(
        F.lit("stable").alias("name"), F.col("stable").cast("double").alias("v"))
    figures = recall.unionByName(high).unionByName(checked).unionByName(stable)

    def figure(name: str):
        return F.max(F.when(F.col("name") == name, F.col("v")))

    row = figures.agg(*[figure(n).alias(n) for n in ("vector", "hybrid", "reranked", "high", "quality", "stable")])
    checks = ev.acceptance(baseline=F.col("vector"), hybrid=F.col("hybrid"), reranked=F.col("reranked"), high_accuracy=F.col("high"),
                           chunk_quality=F.col("quality"), stable=F.col("stable") == 1.0)
    return row.select(*[c.alias(n) for n, c in checks.items()])


@bound("audit_figures", f"""with {EVAL_SQL}, {GROUPS_SQL}, {STABLE_SQL},
ch as (select type, word_count from text_chunks where word_count >= 50 union all select type, {sql.wc('text')}::int from parents),
tops as (select q.query_id, max(score) filter (system = 'vector' and rank = 1) as tv, max(score) filter (system = 'hybrid' and rank = 1) as th
    from queries q left join res using (query_id) where q.query_id not in (select query_id from gold) group by q.query_id)
select 'chunks.' || type as figure, count(*)::double as value from ch group by type
union all select 'avg_words', round(avg(word_count), 1) from ch
union all select 'recall5.' || system, round(avg(recall5), 4) from met where n_gold > 0 group by system
union all select 'mrr.' || system, round(avg(mrr), 4) from met where n_gold > 0 group by system
union all select 'stability_std.' || system, recall_std from stab
union all select 'not_found_accuracy', round(avg((round(coalesce(tv, 0), 6) < 0.25 or round(coalesce(th, 0), 6) < 0.02)::int), 4) from tops""")
def audit_figures(spark, sf_dir):
    """Chunk profile, ablation, stability and refusals as one list of figures."""
    chunks = document_chunks(spark, sf_dir).where("kept").select("type", "word_count")
    res, labelled = results(spark, sf_dir), gold(spark, sf_dir)
    means = ev.ablation(metrics(spark, sf_dir, res, labelled).where("n_gold > 0"))
    out = chunks.groupBy(F.concat(F.lit("chunks."), "type").alias("figure")).agg(F.count("*").cast("double").alias("value"))
    out = out.unionByName(chunks.agg(F.round(F.avg("word_count"), 1).alias("value")).withColumn("figure", F.lit("avg_words")))
    for name in ("recall5", "mrr"):
        out = out.unionByName(means.select(F.concat(F.lit(name + "."), "system").alias("figure"), F.col(name).alias("value")))
    out = out.unionByName(ev.stability(run_metrics(spark, sf_dir, res, labelled)).select(
        F.concat(F.lit("stability_std."), "system").alias("figure"), F.col("recall_std").alias("value")))
    outside = queries(spark, sf_dir).select("query_id").join(labelled, "query_id", "left_anti").join(ev.trust(res), "query_id", "left").fillna(
        0.0, ["top_vector", "top_rrf"])
    refused = (F.round("top_vector", 6) < 0.25) | (F.round("top_rrf", 6) < 0.02)
    return out.unionByName(outside.agg(F.round(F.avg(refused.cast("int")), 4).alias("value")).withColumn(
        "figure", F.lit("not_found_accuracy")))


@bound("label_precision", f"""with {VECTOR_SQL}, {sql.ranked('scored', 'best', 10)}
select query_id, round(count(*) filter (label = query_id) / 10, 4) as precision10, round(coalesce(1 / min(rank) filter (label = query_id), 0), 4) as mrr
from best group by query_id""")
def label_precision(spark, sf_dir):
    """Share of a label's ten nearest vectors that carry the label."""
    corpus = vector_corpus(spark, sf_dir)
    hits = dense.dense_top(label_centroids(spark, sf_dir), corpus, 10).join(corpus.select("chunk_id", "label"), "chunk_id")
    same = F.col("label") == F.col("query_id")
    return hits.groupBy("query_id").agg(
        F.round(F.count_if(same) / 10, 4).alias("precision10"),
        F.round(F.coalesce(1 / F.min(F.when(same, F.col("rank"))), F.lit(0.0)), 4).alias("mrr"))


@bound("latest_reports", """select event_type as doc_id, max_by(event_id, (ts, event_id)) as report_id, max_by(value, (ts, event_id)) as score
from events group by event_type""")
def latest_reports(spark, sf_dir):
    reports = read(spark, sf_dir, "events").select(
        F.col("event_type").alias("doc_id"), F.col("event_id").alias("report_id"), F.col("value").alias("score"),
        F.struct("ts", "event_id").alias("_at"))
    return ev.latest(reports, "doc_id", "_at").select("doc_id", "report_id", "score")
