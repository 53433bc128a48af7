"""Text preparation, sections, chunks and chunk quality over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from quillspark.functions import text as tx
from quillspark.operators import chunking, lexical, quality, sections
from quillspark.plans import search
from quillspark.workloads import sql
from quillspark.workloads.tables import CHUNKS_BY_SOURCE_SQL, QUERIES_SQL, chunks_by_source, queries, read, spread

QUERIES, ORACLES = {}, {}


def bound(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return add


def documents(spark, sf_dir) -> DataFrame:
    return spread(read(spark, sf_dir, "documents"), "doc_id")


def document_sections(spark, sf_dir) -> DataFrame:
    docs = documents(spark, sf_dir).select(
        "doc_id", F.col("text").alias("content"), F.expr("cast(null as array<string>)").alias("pages"))
    return sections.normalize(docs)


def document_chunks(spark, sf_dir) -> DataFrame:
    return chunking.chunk_sections(document_sections(spark, sf_dir))


@bound("cleaned_text", """with m as (select doc_id, regexp_replace(text, '([\\p{L}\\p{N}_])-\\n([\\p{L}\\p{N}_])', '\\1\\2', 'g') as t
    from documents),
p as (select doc_id, replace(replace(replace(replace(t, chr(10) || chr(10), chr(1) || chr(1)), chr(1) || chr(10), chr(1) || chr(1)),
    chr(10), ' '), chr(1), chr(10)) as t from m)
select doc_id, md5(""" + sql.strip("regexp_replace(regexp_replace(t, '[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')")
       + """) as text_md5, length(""" + sql.strip("regexp_replace(regexp_replace(t, '[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')")
       + """) as n from p""")
def cleaned_text(spark, sf_dir):
    clean = documents(spark, sf_dir).select("doc_id", tx.clean_text(F.col("text")).alias("t"))
    return clean.select("doc_id", F.md5("t").alias("text_md5"), F.length("t").cast("bigint").alias("n"))


def three_line_pages(spark, sf_dir) -> DataFrame:
    """Documents cut into pages of three lines."""
    lines = F.split(F.col("text"), "\n")
    pages = tx.bind(lines, lambda ls: F.transform(
        F.sequence(F.lit(0), F.size(ls) - 1, F.lit(3)), lambda i: F.array_join(F.slice(ls, i + 1, 3), "\n")))
    return documents(spark, sf_dir).select("doc_id", pages.alias("pages"))


PAGES_SQL = """l as (select doc_id, string_split(text, chr(10)) as ls from documents),
pg as (select doc_id, list_transform(range(0, len(ls), 3), lambda i: array_to_string(ls[i + 1 : i + 3], chr(10))) as pages
    from l)"""


@bound("running_lines_removed", f"""with {PAGES_SQL},
e as (select doc_id, pages,
    list_transform(pages, lambda p: list_filter(list_transform(string_split(p, chr(10)), lambda s: {sql.strip('s')}),
        lambda s: s <> '')[1]) as firsts,
    list_transform(pages, lambda p: list_filter(list_transform(string_split(p, chr(10)), lambda s: {sql.strip('s')}),
        lambda s: s <> '')[-1]) as lasts from pg),
m as (select doc_id, pages,
    list_filter(list_distinct(firsts), lambda s: length(s) < 120 and len(list_filter(firsts, lambda x: x = s)) >= len(pages) * 0.5)
        as head,
    list_filter(list_distinct(lasts), lambda s: length(s) < 120 and len(list_filter(lasts, lambda x: x = s)) >= len(pages) * 0.5)
        as foot from e),
c as (select doc_id, pages, case when len(pages) < 3 then pages else list_transform(pages, lambda p: array_to_string(
    list_filter(string_split(p, chr(10)), lambda s, i: not (list_contains(head, {sql.strip('s')}) and i - 1 < 3)
        and not (list_contains(foot, {sql.strip('s')}) and i - 1 > len(string_split(p, chr(10))) - 4)), chr(10))) end as cleaned
    from m)
select doc_id, len(pages)::int as n_pages, md5(array_to_string(cleaned, chr(12))) as pages_md5,
    (length(array_to_string(pages, chr(12))) - length(array_to_string(cleaned, chr(12))))::int as removed_chars from c""")
def running_lines_removed(spark, sf_dir):
    rows = three_line_pages(spark, sf_dir).withColumn("cleaned", sections.strip_running_lines(F.col("pages")))
    whole, clean = F.array_join("pages", "\f"), F.array_join("cleaned", "\f")
    return rows.select("doc_id", F.size("pages").alias("n_pages"), F.md5(clean).alias("pages_md5"),
                       (F.length(whole) - F.length(clean)).alias("removed_chars"))


@bound("page_estimates", f"""with {PAGES_SQL},
u as (select doc_id, pages, unnest(range(1, len(pages) + 1))::int as pos from pg),
s as (select doc_id, pos, pages, list_distinct({sql.words("lower(" + sql.strip("pages[pos]") + ")")}) as w
    from u),
o as (select doc_id, pos, list_transform(pages, lambda p: len(list_intersect(w, {sql.words('lower(p)')}))) as ov from s)
select doc_id, pos, case when list_max(ov) > 0 then list_position(ov, list_max(ov))::int else 1 end as page from o""")
def page_estimates(spark, sf_dir):
    rows = three_line_pages(spark, sf_dir).select("doc_id", "pages", F.posexplode("pages").alias("_p", "content"))
    return rows.select("doc_id", (F.col("_p") + 1).alias("pos"),
                       sections.estimate_page(F.col("content"), F.col("pages")).alias("page"))


def html_sql() -> str:
    t = "regexp_replace(html, '(?is)<script\\b.*?</script>|<style\\b.*?</style>|<nav\\b.*?</nav>|<head\\b.*?</head>|<!--.*?-->', '', 'g')"
    for depth in range(1, 7):
        t = f"regexp_replace({t}, '(?i)<h{depth}\\b[^>]*>', chr(10) || chr(10) || '{'#' * depth} ', 'g')"
    t = f"regexp_replace({t}, '(?i)</(h[1-6]|p|div|li|tr|article|footer|ul|table)>|<(br|p)\\b[^>]*>', chr(10), 'g')"
    t = f"regexp_replace({t}, '<[^>]*>', '', 'g')"
    for entity, char in sections.ENTITIES:
        t = f"replace({t}, '{entity}', '{char.replace(chr(39), chr(39) * 2)}')"
    return sql.strip(f"regexp_replace({t}, '[ \\t]*\\n\\s*', chr(10), 'g')")


@bound("page_sections", f"""with m as (select page_id as doc_id, {html_sql()} as t from pages),
h as (select doc_id, regexp_extract_all(chr(10) || t, '\\n#{{1,6}}\\s+[^\\n]+') as heads,
    string_split_regex(chr(10) || t, '\\n#{{1,6}}\\s+[^\\n]+') as bodies from m),
u as (select doc_id, unnest(range(1, len(heads) + 1)) as i, heads, bodies from h),
s as (select doc_id, i, regexp_extract(heads[i], '(#{{1,6}})\\s+([^\\n]+)', 1) as marks,
    {sql.strip("regexp_extract(heads[i], '(#{1,6})\\s+([^\\n]+)', 2)")} as heading,
    {sql.strip('bodies[i + 1]')} as content from u)
select doc_id, (row_number() over (partition by doc_id order by i))::int as section_ord, heading,
    case length(marks) when 1 then 'h1' when 2 then 'h2' else 'h3' end as level, md5(content) as content_md5, 1 as page
from s where content <> ''""")
def page_sections(spark, sf_dir):
    found = sections.page_sections(spread(read(spark, sf_dir, "pages"), "page_id"))
    return found.select("doc_id", "section_ord", "heading", "level", F.md5("content").alias("content_md5"), "page")


@bound("table_lines", """select o_orderkey as doc_id, 'Entity: ' || o_orderkey || ' | Attribute: ' || a || ' | Value: ' || v as line
from (select o_orderkey, unnest(['order', 'status', 'priority', 'Column_4']) as a,
    unnest([o_orderkey::varchar, o_orderstatus, o_orderpriority, o_custkey::varchar]) as v from orders)""")
def table_lines(spark, sf_dir):
    """Each order as a markdown table with one cell more than its header."""
    header = F.lit("intro\n| order | status | priority |\n|---|:-:|---|\n")
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", F.col("o_orderkey").cast("string"), "o_orderstatus",
                                              "o_orderpriority", F.col("o_custkey").cast("string")), F.lit(" |\nend"))
    docs = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.concat(header, cells).alias("t"))
    tables = docs.select("doc_id", F.explode(sections.extract_tables(F.col("t"))).alias("table"))
    return tables.select("doc_id", F.explode(F.split(chunking.eav_lines(F.col("table")), "\n")).alias("line"))


@bound("sheet_sections", """select o_custkey as doc_id, (row_number() over (partition by o_custkey order by o_orderpriority))::int as section_ord,
    o_orderpriority as heading, string_agg(o_orderkey || ' | ' || o_orderstatus || ' | ' || strftime(o_orderdate, '%Y-%m-%d'),
    chr(10) order by o_orderkey) as content from orders group by o_custkey, o_orderpriority""")
def sheet_sections(spark, sf_dir):
    """Each customer's orders as a workbook with one sheet per priority."""
    orders = read(spark, sf_dir, "orders")
    sheets = orders.select("o_custkey", "o_orderpriority").distinct().withColumn(
        "sheet_no", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderpriority")))
    rows = orders.join(sheets, ["o_custkey", "o_orderpriority"]).select(
        F.col("o_custkey").alias("doc_id"), "sheet_no", F.col("o_orderpriority").alias("sheet"),
        F.col("o_orderkey").alias("row_no"),
        F.array(F.col("o_orderkey").cast("string"), "o_orderstatus", F.date_format("o_orderdate", "yyyy-MM-dd")).alias("cells"))
    return sections.sheet_sections(rows).select("doc_id", "section_ord", "heading", "content")


@bound("layout_profile", f"""with b as (select doc_id, text, string_split(text, chr(10)) as ls, {sql.strip('text')} = '' as blank,
    len(regexp_extract_all(text, '(\\|[^\\n]*\\|)|(\\t[^\\n]*\\t)|(_{{3,}})|(─{{3,}})|[┌┐└┘├┤]')) as tm from documents),
c as (select *, len(ls) as n, len(list_filter(ls, lambda s: {sql.strip('s')} <> '')) as filled from b),
d as (select *, (case when tm > 3 then 40 else 0 end + case when length(text) / greatest(filled, 1) < 30 then 15 else 0 end
    + case when (n - filled) / greatest(n, 1) > 0.4 then 10 else 0 end
    + case when filled / 1 > 80 then 10 else 0 end) as score from c)
select doc_id, case when blank then 0 else {sql.wc('text')} end::int as word_count,
    case when blank then 0 else tm end::int as table_matches, case when blank then 0 else score end::int as score,
    case when blank then 'ocr' when score >= 40 then 'docling' else 'pymupdf' end as parser from d""")
def layout_profile(spark, sf_dir):
    profile = tx.layout_profile(F.col("text"), F.lit(1))
    return documents(spark, sf_dir).select("doc_id", *[c.alias(n) for n, c in profile.items()])


@bound("sentence_list", f"""with s as (select doc_id, {sql.sentences('text')} as s from documents)
select doc_id, unnest(range(1, len(s) + 1))::int as ord, md5(unnest(s)) as sentence_md5 from s""")
def sentence_list(spark, sf_dir):
    split = documents(spark, sf_dir).select("doc_id", F.posexplode(tx.sentences(F.col("text"))).alias("_p", "s"))
    return split.select("doc_id", (F.col("_p") + 1).alias("ord"), F.md5("s").alias("sentence_md5"))


GROUPS_SQL = f"""sents as (select doc_id, {sql.sentences('text')} as s from documents where {sql.strip('text')} <> ''),
el as (select doc_id, s, list_transform(s, lambda x, i: {{'i': i::int, 'start': 1, 'w': {sql.wc('x')}::int, 'last': 0,
    'cuts': []::struct(a int, b int)[]}}) as e from sents),
fold as (select doc_id, s, list_reduce(e, lambda acc, x: {{
    'i': x.i,
    'start': case when acc.w + x.w >= 350 then case when x.i - acc.start + 1 > 2 then x.i - 1 else x.i + 1 end else acc.start end,
    'w': case when acc.w + x.w >= 350 then case when x.i - acc.start + 1 > 2 then acc.last + x.w else 0 end else acc.w + x.w end,
    'last': x.w,
    'cuts': case when acc.w + x.w >= 350 then list_append(acc.cuts, {{'a': acc.start, 'b': x.i}}) else acc.cuts end
    }}, {{'i': 0, 'start': 1, 'w': 0, 'last': 0, 'cuts': []::struct(a int, b int)[]}}) as f from el),
g as (select doc_id, list_transform(f.cuts, lambda c: array_to_string(s[c.a : c.b], ' ')) as texts, f,
    array_to_string(s[f.start : f.i], ' ') as tail from fold),
grouped as (select doc_id, case when f.start > f.i then texts
    when f.w < 120 and len(texts) > 0 then list_append(texts[1 : len(texts) - 1], texts[len(texts)] || ' ' || tail)
    else list_append(texts, tail) end as texts from g),
pieces as (select doc_id, unnest(range(1, len(texts) + 1))::int as ord, unnest(texts) as text from grouped),
text_chunks as (select doc_id, 'text' as type, ord, {sql.strip('text')} as text, {sql.wc('text')}::int as word_count from pieces),
parents as (select doc_id, 'parent' as type, 1 as ord, 'Document Content' || chr(10) || chr(10)
    || array_to_string(list_slice({sql.words('text')}, 1, 100), ' ')
    || case when {sql.wc('text')} > 100 then '...' else '' end as text from documents where {sql.strip('text')} <> '')"""


@bound("sentence_groups", f"""with {GROUPS_SQL} select doc_id, ord, md5(text) as text_md5, word_count from text_chunks""")
def sentence_groups(spark, sf_dir):
    chunks = document_chunks(spark, sf_dir).where("type = 'text'")
    return chunks.select("doc_id", "ord", F.md5("text").alias("text_md5"), "word_count")


@bound("hierarchical_chunks", f"""with {GROUPS_SQL},
a as (select doc_id, type, ord, text, word_count from text_chunks where word_count >= 50
    union all select doc_id, type, ord, text, {sql.wc('text')}::int from parents)
select doc_id, type, ord, word_count, md5(text) as text_md5,
    'c_' || substr(sha256(doc_id || '|1|' || type || '|' || ord), 1, 12) as chunk_id,
    case when type = 'text' then 'c_' || substr(sha256(doc_id || '|1|parent|1'), 1, 12) end as parent_id from a""")
def hierarchical_chunks(spark, sf_dir):
    chunks = document_chunks(spark, sf_dir).where("kept")
    return chunks.select("doc_id", "type", "ord", "word_count", F.md5("text").alias("text_md5"), "chunk_id", "parent_id")


@bound("chunk_summary", f"""with {GROUPS_SQL}
select doc_id, 1 + count(*) filter (word_count >= 50) as total, 1::bigint as parents,
    count(*) filter (word_count >= 50) as text_chunks, 0::bigint as table_chunks,
    count(*) filter (word_count < 50) as discarded from text_chunks group by doc_id""")
def chunk_summary(spark, sf_dir):
    return chunking.chunk_summary(document_chunks(spark, sf_dir))


@bound("chunk_histogram", f"""with {GROUPS_SQL},
a as (select type, word_count from text_chunks where word_count >= 50 union all select type, {sql.wc('text')}::int from parents)
select type, count(*) as chunks, round(avg(word_count), 1) as avg_words from a group by type""")
def chunk_histogram(spark, sf_dir):
    chunks = document_chunks(spark, sf_dir).where("kept")
    return chunks.groupBy("type").agg(F.count("*").alias("chunks"), F.round(F.avg("word_count"), 1).alias("avg_words"))


WINDOWS_SQL = f"""w as (select doc_id, text, {sql.words('text')} as ws from documents where {sql.strip('text')} <> ''),
st as (select *, unnest(case when len(ws) <= 400 then [0] else range(0, len(ws), 325) end) as s from w),
windows as (select doc_id, (s // 325 + 1)::int as ord, case when len(ws) <= 400 then {sql.strip('text')}
    else array_to_string(ws[s + 1 : s + 375], ' ') end as text from st)"""


@bound("sliding_windows", f"""with {WINDOWS_SQL}
select doc_id, ord, md5(text) as text_md5, 'c_' || substr(sha256(doc_id || '|1|window|' || ord), 1, 12) as chunk_id
from windows""")
def sliding_windows(spark, sf_dir):
    windows = chunking.sliding_windows(document_sections(spark, sf_dir))
    return windows.select("doc_id", "ord", F.md5("text").alias("text_md5"), "chunk_id")


def last_word_sql(x: str) -> str:
    return f"regexp_replace(lower({sql.words(x)}[-1]), '[.,;:!?]+$', '')"


def any_sql(x: str, phrases) -> str:
    return "(" + " or ".join(f"contains({x}, '{p}')" for p in phrases) + ")"


@bound("chunk_validity", f"""with {WINDOWS_SQL}
select doc_id, ord, {sql.wc('text')} >= 120 and coalesce({last_word_sql('text')}, '') not in ({sql.quoted(tx.DANGLING_WORDS)})
    and regexp_matches(text, '[.!?]') as valid, {any_sql('lower(text)', tx.ANSWER_PHRASES)} as answerable,
    {any_sql('lower(text)', tx.QUALITY_PHRASES)} as complete_idea,
    floor({sql.wc('text')} * 1.5)::int as tokens, greatest(1, floor(length(text) / 4))::int as ledger_tokens from windows""")
def chunk_validity(spark, sf_dir):
    windows = chunking.sliding_windows(document_sections(spark, sf_dir))
    text = F.col("text")
    return windows.select("doc_id", "ord", tx.is_valid_chunk(text).alias("valid"), tx.can_answer(text).alias("answerable"),
                          tx.has_complete_idea(text).alias("complete_idea"), tx.model_tokens(text).alias("tokens"),
                          tx.ledger_tokens(text).alias("ledger_tokens"))


# --- quality -----------------------------------------------------------------------

def positioned_chunks(spark, sf_dir) -> DataFrame:
    chunks = document_chunks(spark, sf_dir).where("kept and type = 'text'")
    return chunks.select("doc_id", F.col("ord").alias("position"), "chunk_id", "text")


QUALITY_SQL = f"""{GROUPS_SQL},
tc as (select doc_id, ord, text, word_count, row_number() over (partition by doc_id order by ord) as rn from text_chunks
    where word_count >= 50),
hd as (select doc_id, ord, text from tc where word_count >= 20),
{sql.vectors('hd', 'doc_id, ord', 'text', 'hv')},
dup as (select b.doc_id, b.ord from hv a join hv b on a.doc_id = b.doc_id and a.ord < b.ord and a.b = b.b
    group by b.doc_id, b.ord, a.ord having round(sum(a.v * b.v), 9) > 0.85),
chk as (select tc.doc_id, tc.ord, word_count >= 50 as long_enough, regexp_matches({sql.strip('text')}, '[.!?]$') as ends_sentence,
    {any_sql('lower(text)', tx.QUALITY_PHRASES)} as answerable,
    coalesce({last_word_sql('text')}, '') not in ({sql.quoted(tx.QUALITY_DANGLING_WORDS)}) as complete_end,
    d.ord is null as "distinct" from tc left join (select distinct doc_id, ord from dup) d using (doc_id, ord)),
q as (select *, (long_enough::int + ends_sentence::int + answerable::int + complete_end::int + "distinct"::int) as passed from chk)"""


@bound("chunk_checks", f"""with {QUALITY_SQL} select *, passed >= 3 as valid from q""")
def chunk_checks(spark, sf_dir):
    checked = quality.checks(positioned_chunks(spark, sf_dir))
    return checked.select("doc_id", F.col("position").alias("ord"), "long_enough", "ends_sentence", "answerable",
                          "complete_end", "distinct", "passed", "valid")


@bound("chunk_quality_report", f"""with {QUALITY_SQL}
select doc_id, count(*) as total_text_chunks, count(*) filter (passed >= 3) as valid_chunks,
    round(count(*) filter (passed >= 3) / count(*), 4) as quality_score,
    count(*) filter (not "distinct") as duplicate_chunks, round(count(*) filter (not "distinct") / count(*) * 100, 1) as duplicate_pct,
    round(count(*) filter (long_enough) / count(*) * 100, 1) as word_count_pct,
    round(count(*) filter (ends_sentence) / count(*) * 100, 1) as sentence_end_pct,
    round(count(*) filter (answerable) / count(*) * 100, 1) as answerable_pct,
    round(count(*) filter (complete_end) / count(*) * 100, 1) as no_trailing_conj_pct from q group by doc_id""")
def chunk_quality_report(spark, sf_dir):
    return quality.report(quality.checks(positioned_chunks(spark, sf_dir)), ["doc_id"])


@bound("near_duplicate_chunks", f"""with {QUALITY_SQL} select distinct doc_id, ord from dup""")
def near_duplicate_chunks(spark, sf_dir):
    chunks = positioned_chunks(spark, sf_dir)
    return quality.near_duplicates(chunks).join(chunks, ["doc_id", "chunk_id"]).select(
        "doc_id", F.col("position").alias("ord"))


# --- fetch, citations, samples --------------------------------------------------------

BEST_SQL = f"""{CHUNKS_BY_SOURCE_SQL}, {QUERIES_SQL}, {sql.bm25('queries', 'chunks')}, {sql.ranked('bm25', 'best', 5)}"""


@bound("ordered_fetch", f"""with {BEST_SQL}
select query_id, scope, (rank - 1)::int as pos, chunk_id, length(text) as n from best join chunks using (scope, chunk_id)""")
def ordered_fetch(spark, sf_dir):
    """Hit id lists, with an unknown id in each, back to chunk rows in list order."""
    corpus = chunks_by_source(spark, sf_dir)
    hits = lexical.bm25_top(queries(spark, sf_dir), corpus, 5)
    ids = F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda x: x["chunk_id"])
    lists = hits.groupBy("query_id", "scope").agg(F.concat(ids, F.array(F.lit(-1).cast("bigint"))).alias("chunk_ids"))
    rows = chunking.fetch_in_order(lists, corpus.drop("scope"), ["query_id", "scope"])
    return rows.select("query_id", "scope", "pos", "chunk_id", F.length("text").cast("bigint").alias("n"))


@bound("hit_citations", f"""with {BEST_SQL}
select query_id, scope, string_agg(chunk_id || ':1:' || md5(substr(text, 1, 150)), ';' order by rank) as citations
from best join chunks using (scope, chunk_id) group by all""")
def hit_citations(spark, sf_dir):
    corpus = chunks_by_source(spark, sf_dir)
    hits = search.with_text(lexical.bm25_top(queries(spark, sf_dir), corpus, 5), corpus)
    cite = F.concat_ws(":", F.col("chunk_id").cast("string"), F.col("page").cast("string"), F.md5(F.substring("text", 1, 150)))
    rows = F.array_sort(F.collect_list(F.struct("rank", cite.alias("c"))))
    return hits.groupBy("query_id", "scope").agg(F.array_join(F.transform(rows, lambda r: r["c"]), ";").alias("citations"))


@bound("spread_sample", f"""with {WINDOWS_SQL},
src as (select d.source, w.doc_id, w.ord, row_number() over (partition by source order by w.doc_id, w.ord) as i,
    count(*) over (partition by source) as n from windows w join documents d using (doc_id))
select source, doc_id, ord, i as sample_ord from src
where n <= 8 or i - 1 < 3 or i - 1 >= n - 3 or i - 1 between n // 2 - 1 and n // 2 + 1""")
def spread_sample(spark, sf_dir):
    windows = chunking.sliding_windows(document_sections(spark, sf_dir)).join(
        read(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    placed = windows.withColumn("_key", F.struct("doc_id", "ord"))
    sample = chunking.spread_sample(placed, "source", "_key", F.floor(F.col("doc_id") / 64))
    return sample.select("source", "doc_id", "ord", F.col("sample_ord").cast("bigint").alias("sample_ord"))
