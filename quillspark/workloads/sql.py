"""DuckDB text shared by the oracle statements."""

from __future__ import annotations

from quillspark.functions import text as tx
from quillspark.operators.fusion import TYPE_RULES, VARIANT_TEXTS, VARIANT_WEIGHTS

SP = tx.SPACE


def quoted(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


def lst(values) -> str:
    return f"[{quoted(values)}]"


def words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '{SP}+'), lambda w: w <> '')"


def wc(x: str) -> str:
    return f"len({words(x)})"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SP}+|{SP}+$', '', 'g')"


def tokens(x: str, legacy: bool = False) -> str:
    low = f"lower({x})"
    if not legacy:
        low = f"regexp_replace({low}, '{SP}+', ' ', 'g')"
    kept = f"regexp_replace({low}, '[^a-z0-9 ]', '', 'g')"
    return (f"list_filter(string_split_regex({kept}, ' +'), lambda t: length(t) > 1 and t not in "
            f"({quoted(tx.STOP_WORDS)}))")


def keywords(x: str) -> str:
    return (f"list_filter(regexp_extract_all(lower({x}), '[a-z0-9+#]{{2,}}'), lambda t: t not in "
            f"({quoted(tx.NOISE_WORDS)}))")


def sentences(x: str) -> str:
    marked = f"regexp_replace({x}, '([.!?]){SP}+', '\\1' || chr(1), 'g')"
    stripped = f"list_transform(string_split({marked}, chr(1)), lambda s: {strip('s')})"
    return f"list_filter({stripped}, lambda s: s <> '')"


def bm25(queries: str, chunks: str, out: str = "bm25", legacy: bool = False) -> str:
    """CTEs ending in ``out(query_id, scope, chunk_id, score)``."""
    return f"""
{out}_tok as (select scope, chunk_id, {tokens('text', legacy)} as terms from {chunks}),
{out}_len as (select scope, chunk_id, len(terms) as dl from {out}_tok),
{out}_scope as (select scope, count(*) as n_docs, avg(dl) as avg_dl from {out}_len group by scope),
{out}_post as (select scope, chunk_id, term, count(*) as tf
    from (select scope, chunk_id, unnest(terms) as term from {out}_tok) group by all),
{out}_df as (select scope, term, count(*) as df from {out}_post group by all),
{out}_q as (select query_id, term, count(*) as mult
    from (select query_id, unnest({tokens('query', legacy)}) as term from {queries}) group by all),
{out} as (select query_id, scope, chunk_id, score from (
    select q.query_id, p.scope, p.chunk_id,
        sum(q.mult * ln((s.n_docs - d.df + 0.5) / (d.df + 0.5) + 1.0) * (p.tf * 2.5)
            / (p.tf + 1.5 * (0.25 + 0.75 * l.dl / s.avg_dl))) as score
    from {out}_q q join {out}_post p using (term) join {out}_df d using (scope, term)
    join {out}_scope s using (scope) join {out}_len l using (scope, chunk_id)
    group by all) where score > 0)"""


def vectors(table: str, keys: str, text: str, out: str) -> str:
    """CTEs ending in ``out(keys..., b, v)``: the non-zero cells of unit vectors."""
    return f"""
{out}_t as (select {keys}, unnest({tokens(text)}) as t from {table}),
{out}_h as (select t, ('0x' || substr(md5(t), 1, 2))::int % 64 as b,
    case when ('0x' || substr(md5(t), 3, 2))::int < 128 then 1 else -1 end as sg
    from (select distinct t from {out}_t)),
{out}_c as (select {keys}, b, sum(sg)::double as v from {out}_t join {out}_h using (t) group by all),
{out}_n as (select {keys}, sqrt(sum(v * v)) as nrm from {out}_c group by all),
{out} as (select {keys}, b, v / nrm as v from {out}_c join {out}_n using ({keys}) where nrm > 0)"""


def dense(queries: str, chunks: str, out: str = "dense") -> str:
    """CTEs ending in ``out(query_id, scope, chunk_id, score)`` over all pairs."""
    return vectors(queries, "query_id", "query", f"{out}_qv") + "," + vectors(
        chunks, "scope, chunk_id", "text", f"{out}_cv") + f""",
{out}_dot as (select q.query_id, c.scope, c.chunk_id, sum(q.v * c.v) as s
    from {out}_qv q join {out}_cv c using (b) group by all),
{out} as (select q.query_id, c.scope, c.chunk_id, round(coalesce(s, 0), 8) as score
    from {queries} q cross join {chunks} c left join {out}_dot d
    on d.query_id = q.query_id and d.scope = c.scope and d.chunk_id = c.chunk_id)"""


def ranked(source: str, out: str, k: int, keys: str = "query_id, scope") -> str:
    return f"""
{out} as (select * from (select *, (row_number() over (partition by {keys}
    order by round(score, 8) desc, chunk_id))::int as rank from {source}) where rank <= {k})"""


def query_type(x: str) -> str:
    low = f"lower({strip(x)})"
    # RE2 boundaries are ASCII: set blanks around every non-word character instead.
    spread = f"(' ' || regexp_replace({low}, '([^\\p{{L}}\\p{{N}}_])', ' \\1 ', 'g') || ' ')"
    w = "[^\\p{L}\\p{N}_]"

    def wordy(p: str) -> str:
        p = p.replace(r"\s+", f"{w}+").replace(r"\.?", "")
        if p.endswith(r"\bcompar"):
            return f"{w}compar"
        p = p.replace(r"\b.*\b", f"{w}(?:.*{w})?").replace(r"\b", w)
        return p

    out = "case "
    for name, patterns in TYPE_RULES:
        joined = "|".join("(?:" + wordy(p) + ")" for p in patterns)
        out += f"when regexp_matches({spread}, '(?s){joined}') then '{name}' "
    return out + f"when {wc(low)} <= 5 then 'factual' else 'analytical' end"


def routed(source: str, out: str) -> str:
    """CTE adding the strategy columns to ``source(query_id, query)``."""
    n = wc("query")
    return f"""
{out}_0 as (select *, {n} as n, {query_type('query')} as query_type from {source}),
{out} as (select * exclude (n),
    case when n <= 4 then 'simple' when n <= 12 then 'moderate' else 'complex' end as complexity,
    case when n <= 3 then 0.3::double when n > 12 then 0.7::double else 0.5::double end as vector_weight,
    case when n <= 3 then 0.7::double when n > 12 then 0.3::double else 0.5::double end as bm25_weight,
    greatest(case when n <= 3 then 5 when n > 12 then 10 else 7 end,
        case when query_type in ('comparison', 'analytical') then 8 when query_type = 'procedural' then 7 else 0 end)
        as top_k,
    case when n <= 3 then 5 when n > 12 then 15 else 10 end as rrf_k,
    (n > 12 or query_type in ('comparison', 'analytical')) as needs_rerank from {out}_0)"""


def variants(source: str, out: str) -> str:
    parts = []
    for name, prefixes in VARIANT_TEXTS.items():
        for i, prefix in enumerate(prefixes):
            parts.append(f"('{name}', {i}, '{prefix}', {VARIANT_WEIGHTS[i]}::double)")
    return f"""
{out}_t(query_type, variant, prefix, weight) as (values {', '.join(parts)}),
{out} as (select r.* exclude (query), r.query_id || '~' || v.variant as vkey, v.variant, v.weight,
    v.prefix || r.query as query from {source} r join {out}_t v using (query_type))"""


def hybrid(source: str, chunks: str, out: str = "hyb") -> str:
    """CTEs ending in ``out``: fused hits of ``source`` (already routed)."""
    return variants(source, f"{out}_v") + f""",
{out}_k as (select vkey as query_id, query from {out}_v),""" + bm25(f"{out}_k", chunks, f"{out}_b") + "," + dense(
        f"{out}_k", chunks, f"{out}_d") + "," + ranked(f"{out}_b", f"{out}_br", 13) + "," + ranked(
        f"{out}_d", f"{out}_dr", 13) + f""",
{out}_hits as (
    select v.query_id, h.scope, h.chunk_id, v.variant, h.src, h.score * v.weight as w
    from (select *, 'b' as src from {out}_br union all by name select *, 'v' as src from {out}_dr) h
    join {out}_v v on v.vkey = h.query_id where h.rank <= v.top_k + 3),
{out}_p as (select query_id, scope, chunk_id,
    max(case when src = 'v' and variant = 0 then w end) as v0,
    max(case when src = 'v' and variant = 1 then w end) as v1,
    max(case when src = 'v' and variant = 2 then w end) as v2,
    max(case when src = 'b' then w end) as bm25_score from {out}_hits group by all),
{out}_f1 as (select *, case when v1 is null then v0 when v0 is null or v1 > v0 then v1 else v0 + v1 * 0.3 end as a
    from {out}_p),
{out}_f as (select *, case when v2 is null then a when a is null or v2 > a then v2 else a + v2 * 0.3 end as vector_score
    from {out}_f1),
{out}_r as (select *,
    case when vector_score is not null then (row_number() over (partition by query_id, scope
        order by round(vector_score, 8) desc nulls last, chunk_id))::int end as vector_rank,
    case when bm25_score is not null then (row_number() over (partition by query_id, scope
        order by round(bm25_score, 8) desc nulls last, chunk_id))::int end as bm25_rank from {out}_f),
{out}_s as (select r.query_id, r.scope, r.chunk_id, vector_rank, bm25_rank, top_k,
    coalesce(vector_weight / (rrf_k + vector_rank), 0) + coalesce(bm25_weight / (rrf_k + bm25_rank), 0) as rrf_score
    from {out}_r r join {source} s using (query_id)),
{out} as (select * from (select *, (row_number() over (partition by query_id, scope
    order by round(rrf_score, 8) desc, chunk_id))::int as rank from {out}_s) where rank <= top_k)"""
