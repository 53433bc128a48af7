"""Hierarchy, subjects, suggestions, quizzes, responses and the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quillspark.functions import labels as lb, text as tx
from quillspark.operators import catalog, chunking, hierarchy, lexical, quiz, responses, subjects, suggest
from quillspark.plans.lineage import cut
from quillspark.workloads import sql
from quillspark.workloads.documents import WINDOWS_SQL, document_sections, documents
from quillspark.workloads.tables import chunks_by_source, queries, read

QUERIES, ORACLES = {}, {}


def bound(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return add


# --- hierarchy ---------------------------------------------------------------------

def conversation_sections(spark, sf_dir) -> DataFrame:
    """A conversation as a headed document: system h1, user h2, assistant h3 sections."""
    role, turn = F.col("role"), F.col("turn")
    return read(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("doc_id"), (turn + 1).alias("section_ord"),
        F.when(role == "system", "h1").when(role == "user", "h2").otherwise("h3").alias("level"),
        F.concat(F.initcap(role), F.lit(" part "), (turn / 2).cast("int").cast("string")).alias("heading"),
        F.when((F.col("conv_id") + turn) % 5 == 0, " ").otherwise(F.col("text")).alias("content"),
        (turn + 1).cast("int").alias("page"))


def conversation_nodes(spark, sf_dir) -> DataFrame:
    """The stored node table the readers below share."""
    return cut(hierarchy.course_nodes(conversation_sections(spark, sf_dir)))


SECTIONS_SQL = f"""s as (select conv_id as doc_id, turn + 1 as section_ord,
    case role when 'system' then 'h1' when 'user' then 'h2' else 'h3' end as level,
    upper(role[1]) || role[2:] || ' part ' || (turn // 2) as title,
    case when (conv_id + turn) % 5 = 0 then '' else {sql.strip('text')} end as content, (turn + 1)::int as page from conversations)"""
NODE = "struct(level varchar, title varchar, content varchar)[]"
SLUG = "substr(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60)"
NODES_SQL = f"""{SECTIONS_SQL},
p as (select *, lag(case when level <> 'h1' or content <> '' then 'topic' else 'unit' end) over (partition by doc_id order by section_ord) as before from s),
l as (select doc_id, section_ord, page, case level
    when 'h1' then list_concat([{{'level': 'unit', 'title': title, 'content': null::varchar}}], case when content <> '' then
        [{{'level': 'topic', 'title': title || ' Overview', 'content': null::varchar}}, {{'level': 'subtopic', 'title': title || ' Details', 'content': content}}]
        else []::{NODE} end)
    when 'h2' then list_concat(case when before is null then [{{'level': 'unit', 'title': 'General Unit', 'content': null::varchar}}] else []::{NODE} end,
        [{{'level': 'topic', 'title': title, 'content': null::varchar}}], case when content <> '' then
        [{{'level': 'subtopic', 'title': title || ' Details', 'content': content}}] else []::{NODE} end)
    else list_concat(case when before is null then [{{'level': 'unit', 'title': 'General Unit', 'content': null::varchar}}] else []::{NODE} end,
        case when coalesce(before, 'unit') = 'unit' then [{{'level': 'topic', 'title': 'General Topic', 'content': null::varchar}}] else []::{NODE} end,
        [{{'level': 'subtopic', 'title': title, 'content': content}}]) end as ns from p),
n as (select doc_id, section_ord, page, unnest(range(1, len(ns) + 1)) as pos, unnest(ns, recursive := true) from l),
c as (select *, row_number() over w as sort_order, count(*) filter (level = 'unit') over w as ui, count(*) filter (level = 'topic') over w as ti,
    count(*) filter (level = 'subtopic') over w as si from n window w as (partition by doc_id order by section_ord, pos rows unbounded preceding)),
d as (select *, level || '_' || lpad((case level when 'unit' then ui when 'topic' then ti else si end)::varchar, 4, '0') || '_' || {SLUG.format('title')} as node_id from c),
e as (select *, last_value(case when level = 'unit' then node_id end ignore nulls) over w as iu, last_value(case when level = 'topic' then node_id end ignore nulls) over w as it
    from d window w as (partition by doc_id order by section_ord, pos rows unbounded preceding)),
nodes as (select doc_id, node_id, case level when 'unit' then 'subject_0001_general-studies' when 'topic' then iu else it end as parent_id, level, title, content, page, sort_order from e
    union all select distinct doc_id, 'subject_0001_general-studies', null, 'subject', 'General Studies', null, 1, 0 from s)"""


@bound("section_tree", f"""with {SECTIONS_SQL}, i as (select *, 'n_' || lpad(section_ord::varchar, 5, '0') as node_id from s),
t as (select *, last_value(case when level = 'h1' then node_id end ignore nulls) over w as h1, last_value(case when level in ('h1', 'h2') then node_id end ignore nulls) over w as h12
    from i window w as (partition by doc_id order by section_ord rows between unbounded preceding and 1 preceding))
select doc_id, node_id, case level when 'h2' then h1 when 'h3' then h12 end as parent_id, title as heading, level, page, md5(content) as content_md5 from t""")
def section_tree(spark, sf_dir):
    tree = hierarchy.section_tree(conversation_sections(spark, sf_dir))
    return tree.select("doc_id", "node_id", "parent_id", "heading", "level", "page", F.md5("content").alias("content_md5"))


@bound("course_nodes", f"""with {NODES_SQL} select doc_id, node_id, parent_id, level, title, md5(content) as content_md5, page, sort_order from nodes""")
def course_nodes(spark, sf_dir):
    nodes = hierarchy.course_nodes(conversation_sections(spark, sf_dir))
    return nodes.select("doc_id", "node_id", "parent_id", "level", "title", F.md5("content").alias("content_md5"), "page", "sort_order")


@bound("readable_tree", f"""with {NODES_SQL} select doc_id, node_id, row_number() over (partition by doc_id, coalesce(parent_id, '') order by sort_order) as child_ord,
    coalesce(content, '') <> '' as has_content, length(coalesce(content, ''))::int as shown_chars from nodes""")
def readable_tree(spark, sf_dir):
    tree = hierarchy.readable_tree(conversation_nodes(spark, sf_dir))
    return tree.select("doc_id", "node_id", "child_ord", "has_content", F.length("content").alias("shown_chars"))


PATHS_SQL = """paths as (select a.doc_id, a.title, max_by(concat_ws(' > ', d.title, c.title, b.title, a.title), a.sort_order) as path from nodes a
    left join nodes b on b.doc_id = a.doc_id and b.node_id = a.parent_id left join nodes c on c.doc_id = a.doc_id and c.node_id = b.parent_id
    left join nodes d on d.doc_id = a.doc_id and d.node_id = c.parent_id where a.level = 'subtopic' group by a.doc_id, a.title)"""


@bound("breadcrumbs", f"with {NODES_SQL}, {PATHS_SQL} select doc_id, title, path from paths")
def breadcrumbs(spark, sf_dir):
    return hierarchy.breadcrumbs(conversation_nodes(spark, sf_dir))


def conversation_hits(spark, sf_dir) -> DataFrame:
    """Each turn as a hit; headings lose their case and spacing now and then."""
    rows = conversation_sections(spark, sf_dir)
    section = F.when(F.col("section_ord") % 3 == 0, F.upper("heading")).when(
        F.col("section_ord") % 7 == 0, F.concat(F.lit("Lost "), "heading")).otherwise(F.col("heading"))
    return rows.select("doc_id", F.col("section_ord").alias("chunk_id"), section.alias("section"), "page")


HITS_SQL = f"""h as (select doc_id, section_ord as chunk_id, page, case when section_ord % 3 = 0 then upper(title) when section_ord % 7 = 0 then 'Lost ' || title else title end as section from s),
subs as (select doc_id, node_id, title, page, sort_order, lower(title) as key from nodes where level = 'subtopic'),
tr as (select doc_id, chunk_id, page, 0 as t, section as want from h union all select doc_id, chunk_id, page, 1, section || ' Details' from h),
f as (select tr.doc_id, tr.chunk_id, arg_min(subs.node_id, (t, (title <> want)::int, (subs.page <> tr.page)::int, sort_order)) as node_id,
    arg_min(subs.title, (t, (title <> want)::int, (subs.page <> tr.page)::int, sort_order)) as ntitle
    from tr join subs on subs.doc_id = tr.doc_id and subs.key = lower(tr.want) group by all)"""


@bound("located_chunks", f"""with {NODES_SQL}, {HITS_SQL} select doc_id, chunk_id, section, coalesce(f.node_id, '') as node_id, coalesce(ntitle, section || ' Details') as node_title
from h left join f using (doc_id, chunk_id)""")
def located_chunks(spark, sf_dir):
    nodes = conversation_nodes(spark, sf_dir)
    return hierarchy.locate_nodes(conversation_hits(spark, sf_dir), nodes).select("doc_id", "chunk_id", "section", "node_id", "node_title")


@bound("decorated_hits", f"""with {NODES_SQL}, {PATHS_SQL}, {HITS_SQL},
r as (select h.*, coalesce(f.node_id, '') as node_id, coalesce(ntitle, section || ' Details') as node_title from h left join f using (doc_id, chunk_id))
select r.doc_id, r.chunk_id, r.node_id, coalesce(a.path, b.path, r.section) as section_path, r.node_title as title, 'conv-' || r.doc_id as filename
from r left join paths a on a.doc_id = r.doc_id and a.title = r.node_title left join paths b on b.doc_id = r.doc_id and b.title = r.section""")
def decorated_hits(spark, sf_dir):
    nodes = conversation_nodes(spark, sf_dir)
    titles = read(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("doc_id"), F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("filename")).distinct()
    return hierarchy.decorate_hits(conversation_hits(spark, sf_dir), nodes, titles).select(
        "doc_id", "chunk_id", "node_id", "section_path", "title", "filename")


@bound("node_chunks", f"""with {NODES_SQL}, {HITS_SQL} select f.doc_id, f.node_id, count(*) as chunks from f group by f.doc_id, f.node_id""")
def node_chunks(spark, sf_dir):
    nodes = conversation_nodes(spark, sf_dir)
    located = hierarchy.locate_nodes(conversation_hits(spark, sf_dir), nodes).where("node_id <> ''")
    return located.groupBy("doc_id", "node_id").agg(F.count("*").alias("chunks"))


@bound("fallback_tree", f"""with {SECTIONS_SQL}, r as (select *, row_number() over (partition by doc_id, title order by section_ord) as i from s where content <> ''),
b as (select doc_id, title, string_agg(content, chr(10) || chr(10) order by section_ord) as content from r where i <= 4 group by all),
o as (select doc_id, title, row_number() over (partition by doc_id order by min(section_ord)) as ord from s group by doc_id, title)
select doc_id, 'n_' || lpad(ord::varchar, 5, '0') as node_id, 'n_00000' as parent_id, title as heading, md5(coalesce(content, '')) as content_md5
from o left join b using (doc_id, title) where ord <= 200""")
def fallback_tree(spark, sf_dir):
    chunks = conversation_sections(spark, sf_dir).select("doc_id", F.col("section_ord").alias("position"), F.col("heading").alias("section"), F.col("content").alias("text"))
    tree = hierarchy.fallback_tree(chunks)
    return tree.select("doc_id", "node_id", "parent_id", "heading", F.md5("content").alias("content_md5"))


@bound("library_tree", f"""with {NODES_SQL} select 'General Studies' as subject, doc_id, doc_id::varchar as document_title, node_id, parent_id, title, level, page, sort_order,
    coalesce(content, '') <> '' as has_content from nodes where level <> 'subject'""")
def library_tree(spark, sf_dir):
    nodes = conversation_nodes(spark, sf_dir)
    titles = nodes.select("doc_id").distinct().withColumn("filename", F.lit(""))
    return hierarchy.library_tree(nodes, titles)


# --- subjects -------------------------------------------------------------------------

# Frequent words of the test languages, standing in for subject keywords.
LANGUAGE_KEYWORDS = {"English": ["the", "and", "of the", "that"], "French": ["les", "des", "de la", "dans"],
                     "German": ["der", "und", "in der", "die"], "Spanish": ["los", "que", "de los", "para"]}
LANGUAGE_BONUS = {"French": [(r"\bles des\b", 2)], "Spanish": [(r"\bque los\b", 2), (r"\bthe\b", -3)]}


def samples(spark, sf_dir) -> DataFrame:
    windows = chunking.sliding_windows(document_sections(spark, sf_dir))
    sampled = chunking.spread_sample(windows, "doc_id", "ord", F.floor(F.col("ord") / 1024))
    return subjects.sample_text(sampled)


def score_sql(keywords, bonus) -> str:
    w = "[^\\p{L}\\p{N}_]"
    parts = []
    for word in keywords:
        if " " in word:
            parts.append(f"(length(t) - length(replace(t, '{word}', ''))) // {len(word)} * 2")
        elif word == "c++":
            parts.append(f"len(regexp_extract_all(' ' || t, '{w}c\\+\\+[\\p{{L}}\\p{{N}}_]'))")
        else:
            parts.append(f"len(list_filter(bag, lambda x: x = '{word}'))")
    for pattern, points in bonus:
        body = pattern.replace(r"\b", "").replace(r"\s+", "[ \\t\\n]+").replace(r"\w*", "[\\p{L}\\p{N}_]*").replace(r"\s*", "[ \\t\\n]*")
        tail = "" if body.endswith("\\(") else w
        parts.append(f"case when regexp_matches(' ' || t || ' ', '{w}{body}{tail}') then {points} else 0 end")
    return " + ".join(parts)


SAMPLE_SQL = f"""{WINDOWS_SQL}, sw as (select doc_id, ord, text, row_number() over (partition by doc_id order by ord) as i, count(*) over (partition by doc_id) as n from windows),
smp as (select doc_id, string_agg('[Section: Document Content]' || chr(10) || text, chr(10) || chr(10) order by i) as sample from sw
    where n <= 8 or i <= 3 or i > n - 3 or i - 1 between n // 2 - 1 and n // 2 + 1 group by doc_id),
low as (select doc_id, lower(sample) as t from smp),
bags as (select *, regexp_split_to_array(t, '[^\\p{{L}}\\p{{N}}_]+') as bag from low)"""


def classify_sql(keywords: dict, bonus: dict) -> str:
    scores = ", ".join(f"({score_sql(words, bonus.get(name, []))})::int" for name, words in keywords.items())
    return f"""with {SAMPLE_SQL}, sc as (select doc_id, [{scores}] as s from bags)
select doc_id, greatest(list_max(s), 0) as score, case when list_max(s) >= 2 then {sql.lst(keywords)}[list_position(s, list_max(s))] else 'General Studies' end as subject,
    case when list_max(s) > 0 then {sql.lst(keywords)}[list_position(s, list_max(s))] else 'General Studies' end as fallback from sc"""


@bound("subject_scores", classify_sql(subjects.SUBJECT_KEYWORDS, subjects.SUBJECT_BONUS))
def subject_scores(spark, sf_dir):
    return subjects.classify(samples(spark, sf_dir)).select("doc_id", "score", "subject", "fallback")


@bound("language_scores", classify_sql(LANGUAGE_KEYWORDS, LANGUAGE_BONUS))
def language_scores(spark, sf_dir):
    """The same classifier with a keyword table that fits the test texts."""
    return subjects.classify(samples(spark, sf_dir), LANGUAGE_KEYWORDS, LANGUAGE_BONUS).select("doc_id", "score", "subject", "fallback")


def noisy_labels(spark, sf_dir) -> DataFrame:
    """A label per document from its language and source, spelled in several ways."""
    d, name = F.col("doc_id"), F.concat("lang", F.lit(" studies "), "source")
    return read(spark, sf_dir, "documents").select("doc_id", (
        F.when(d % 7 == 0, F.concat(F.lit('"'), name, F.lit('.pdf"'))).when(d % 7 == 1, F.upper(name))
        .when(d % 7 == 2, F.concat(name, F.lit("!"))).when(d % 7 == 3, F.lit("ml")).when(d % 7 == 4, F.lit("Notes"))
        .when(d % 7 == 5, F.concat(F.lit("doc_12ab "), "lang", F.lit("-studies"))).otherwise(
            F.concat(F.lit("a b c d "), "source"))).alias("subject"))


@bound("clean_subjects", """with r as (select doc_id, lang, source, doc_id % 7 as m from documents),
t as (select doc_id, m, upper(lang[1]) || lang[2:] as l, upper(source[1]) || source[2:] as s from r)
select doc_id, case when m in (0, 1, 2) then l || ' Studies ' || s when m = 3 then 'Machine Learning' when m = 5 then l || '-Studies' else 'General' end as subject from t""")
def clean_subjects(spark, sf_dir):
    return noisy_labels(spark, sf_dir).select("doc_id", lb.sanitize_subject(F.col("subject")).alias("subject"))


@bound("canonical_subjects")
def canonical_subjects(spark, sf_dir):
    return subjects.canonical_subjects(noisy_labels(spark, sf_dir))


@bound("reclassified_library")
def reclassified_library(spark, sf_dir):
    return subjects.reclassify(samples(spark, sf_dir), LANGUAGE_KEYWORDS, LANGUAGE_BONUS)


def library(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.col("source").alias("subject"), "doc_id", F.col("lang").alias("title"))


@bound("library_subjects", """with l as (select source as subject, doc_id, lang as title from documents union all
    select 'lang ' || lang, doc_id, 'second' from documents union all select source, doc_id, 'again' from documents),
u as (select subject, doc_id from l group by all), k as (select * from u where not (doc_id % 11 = 0) and not (doc_id % 13 = 0 and starts_with(subject, 'src')))
select subject, count(*) as doc_count from k group by subject""")
def library_subjects(spark, sf_dir):
    base = library(spark, sf_dir)
    more = base.select(F.concat(F.lit("lang "), "title").alias("subject"), "doc_id", F.lit("second").alias("title")).unionByName(
        base.withColumn("title", F.lit("again")))
    full = subjects.add_to_library(base, more)
    gone = base.where("doc_id % 11 = 0").select(F.lit(None).cast("string").alias("subject"), "doc_id").unionByName(
        base.where("doc_id % 13 = 0").select("subject", "doc_id"))
    return subjects.library_subjects(subjects.remove_from_library(full, gone))


@bound("subject_of_document", """select doc_id, case when doc_id % 3 = 0 then 'General Studies' else source end as subject from documents""")
def subject_of_document(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id")
    return subjects.subject_of(docs, library(spark, sf_dir).where("doc_id % 3 <> 0")).select("doc_id", "subject")


# --- vocabulary and suggestions ---------------------------------------------------------

@bound("vocabulary", f"""with w as (select source as scope, unnest(regexp_extract_all(lower(text), '[a-zA-Z]{{3,}}')) as term from documents)
select distinct scope, term from (select scope, term from w union all
    select scope, unnest({sql.lst(lexical.COMMON_TERMS)}) from (select distinct source as scope from documents))""")
def vocabulary(spark, sf_dir):
    return lexical.vocabulary(chunks_by_source(spark, sf_dir))


def headed_chunks(spark, sf_dir) -> DataFrame:
    return chunks_by_source(spark, sf_dir).withColumn("section", F.concat(F.lit("Section "), "lang"))


@bound("search_terms", """with w as (select source as scope, lang, regexp_extract_all(lower(text), '[a-zA-Z]{3,}') as w from documents),
g as (select scope, unnest(w) as term, 1 as v from w
    union all select scope, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])), 1 from w where len(w) >= 2
    union all select scope, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])), 1 from w where len(w) >= 3
    union all select scope, 'section ' || lang, 3 from w),
s as (select scope, term, sum(v) as s from g group by all)
select scope, term, (case when s >= 3 then s + 2 else s end)::bigint as weight from s where s >= 2""")
def search_terms(spark, sf_dir):
    return lexical.search_terms(headed_chunks(spark, sf_dir))


def prefixes(spark, sf_dir) -> DataFrame:
    """The first four letters of every benchmark passage's longest word, asked of one source each."""
    longest = F.element_at(F.array_sort(F.transform(lexical.letter_words(F.col("query")), lambda w: F.struct(
        (-F.length(w)).alias("n"), w.alias("w")))), 1)["w"]
    scope = F.concat(F.lit("src"), (F.col("query_id") % 20).cast("string"))
    return queries(spark, sf_dir).select("query_id", scope.alias("scope"), F.substring(longest, 1, 4).alias("prefix"))


@bound("autocomplete_prefixes", """with w as (select source as scope, lang, regexp_extract_all(lower(text), '[a-zA-Z]{3,}') as w from documents),
g as (select scope, unnest(w) as term, 1 as v from w
    union all select scope, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])), 1 from w where len(w) >= 2
    union all select scope, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])), 1 from w where len(w) >= 3
    union all select scope, 'section ' || lang, 3 from w),
s as (select scope, term, sum(v) as s from g group by all),
t as (select scope, term, (case when s >= 3 then s + 2 else s end)::bigint as weight from s where s >= 2),
q as (select item_id as query_id, unnest(regexp_extract_all(lower(text), '[a-zA-Z]{3,}')) as w from benchmark),
p as (select query_id, substr(arg_min(w, (-length(w), w)), 1, 4) as prefix from q group by query_id),
r as (select p.query_id, t.scope, p.prefix, t.term, t.weight, (row_number() over (partition by p.query_id, t.scope order by weight desc, length(term), term))::int as rank
    from p join t on t.scope = 'src' || (p.query_id % 20) and starts_with(t.term, p.prefix))
select query_id, scope, prefix, term, weight, rank from r where rank <= 8""")
def autocomplete_prefixes(spark, sf_dir):
    """The prefix half of autocomplete: a floor above 1 admits no fuzzy term."""
    asked = prefixes(spark, sf_dir)
    return suggest.autocomplete(asked, lexical.search_terms(headed_chunks(spark, sf_dir), only=suggest.completing(asked, 1.01)), 8, 1.01)


@bound("autocomplete")
def autocomplete(spark, sf_dir):
    asked = prefixes(spark, sf_dir)
    return suggest.autocomplete(asked, lexical.search_terms(headed_chunks(spark, sf_dir), only=suggest.completing(asked)), 8)


@bound("autocomplete_by_user")
def autocomplete_by_user(spark, sf_dir):
    """Weights summed over a user's sources; five users own the sources in turn."""
    owner = F.concat(F.lit("user"), (F.substring("scope", 4, 9).cast("int") % 5).cast("string"))
    asked = prefixes(spark, sf_dir).select("query_id", owner.alias("scope"), "prefix").distinct()
    terms = lexical.search_terms(headed_chunks(spark, sf_dir), only=suggest.completing(asked, scope=owner)).groupBy(
        owner.alias("scope"), "term").agg(F.sum("weight").alias("weight"))
    return suggest.autocomplete(asked, terms, 5, max_chars=64)


LANGUAGES = ["de", "en", "es", "fr"]


@bound("spelling_corrections")
def spelling_corrections(spark, sf_dir):
    asked = queries(spark, sf_dir).select("query_id", F.explode(F.array(*[F.lit(x) for x in LANGUAGES])).alias("scope"), "query")
    words = lexical.vocabulary(read(spark, sf_dir, "documents").select(F.col("lang").alias("scope"), "text"))
    found = suggest.corrections(asked, words)
    return found.select("query_id", "scope", "pos", "written", "correction", F.round("ratio", 6).alias("ratio"))


@bound("did_you_mean")
def did_you_mean(spark, sf_dir):
    asked = queries(spark, sf_dir).select("query_id", F.explode(F.array(*[F.lit(x) for x in LANGUAGES])).alias("scope"), "query")
    words = lexical.vocabulary(read(spark, sf_dir, "documents").select(F.col("lang").alias("scope"), "text"))
    fixed = suggest.corrected_queries(asked, suggest.corrections(asked, words))
    # The suggestion shown for a query is that of its first scope with one.
    shown = F.when(F.col("did_you_mean"), F.col("corrected"))
    return fixed.groupBy("query_id").agg(
        F.count_if("did_you_mean").alias("scopes_with_suggestion"),
        F.min_by(shown, F.when(F.col("did_you_mean"), F.col("scope"))).alias("suggestion"))


# --- quizzes and study items -----------------------------------------------------------------

def question_sets(spark, sf_dir, quiz_type: str = "quiz") -> DataFrame:
    count = quiz.EXPECTED_COUNT[quiz_type]
    pool = quiz.facts(F.col("text"), F.concat(F.lit("Source "), "source"), count * 3)
    return documents(spark, sf_dir).select("doc_id", quiz.questions_from_facts(pool, count, quiz_type).alias("questions"))


def quiz_sql(count: int) -> str:
    flat = sql.strip(f"regexp_replace(text, '{sql.SP}+', ' ', 'g')")
    return f"""f as (select doc_id, source, list_filter({sql.sentences(flat)}, lambda s: length(s) between 40 and 180)[1 : {count * 3}] as fs from documents),
q as (select doc_id, source, fs, unnest(range(0, {count})) as i from f where len(fs) > 0),
r as (select *, fs[i % len(fs) + 1] as fact, i % 4 as rot from q),
o as (select *, list_concat([fact], list_filter(fs, lambda t: t <> fact)[1 : 3], ['{quiz.FILLER}', '{quiz.FILLER}', '{quiz.FILLER}'])[1 : 4] as o from r),
t as (select *, list_concat(o[rot + 1 : 4], o[1 : rot]) as options from o)"""


@bound("quiz_questions", f"""with {quiz_sql(5)} select doc_id, i::int as ord, 'Which statement is correct about Source ' || source || '?' as question, array_to_string(options, ' / ') as options,
    substr('ABCD', list_position(options, fact)::int, 1) as correct_answer, fact as explanation,
    len(list_distinct(list_transform(options, lambda x: lower(trim(x))))) = 4 as valid from t""")
def quiz_questions(spark, sf_dir):
    sets = question_sets(spark, sf_dir).select("doc_id", F.posexplode("questions").alias("ord", "q"))
    return sets.select("doc_id", "ord", "q.question", F.array_join("q.options", " / ").alias("options"), "q.correct_answer", "q.explanation",
                       quiz.valid_question(F.col("q"), False).alias("valid"))


@bound("question_set_checks", f"""with {quiz_sql(15)}, v as (select doc_id, i, len(list_distinct(list_transform(options, lambda x: lower(trim(x))))) = 4 as valid from t)
select d.doc_id, coalesce(bool_and(valid) filter (i is not null), false) as mock_ok, coalesce(bool_and(valid) filter (i < 5), false) as first_five_ok
from documents d left join v using (doc_id) group by d.doc_id""")
def question_set_checks(spark, sf_dir):
    sets = question_sets(spark, sf_dir, "mock_test")
    return sets.select("doc_id", quiz.accepted(F.col("questions"), "mock_test").alias("mock_ok"),
                       quiz.accepted(F.slice("questions", 1, 5), "quiz").alias("first_five_ok"))


@bound("shuffled_questions", f"""with {quiz_sql(5)}, k as (select *, 'Which statement is correct about Source ' || source || '?' as question from t),
s as (select *, list_transform(list_sort(list_transform(options, lambda o: {{'h': md5('s1|' || question || '|' || o), 'o': o}})), lambda x: x.o) as so from k)
select doc_id, (row_number() over (partition by doc_id order by md5('s1|' || i || '|' || fact), i) - 1)::int as ord, array_to_string(so, ' / ') as options,
    substr('ABCD', list_position(so, fact)::int, 1) as correct_answer from s""")
def shuffled_questions(spark, sf_dir):
    mixed = question_sets(spark, sf_dir).select("doc_id", F.posexplode(quiz.shuffled(F.col("questions"), F.lit("s1"))).alias("ord", "q"))
    return mixed.select("doc_id", "ord", F.array_join("q.options", " / ").alias("options"), "q.correct_answer")


@bound("study_material_checks", f"""with w as (select doc_id, {sql.words('text')} as w from documents)
select doc_id, len(w) >= 46 and 20 + doc_id % 7 <= 24 as cards_ok, least(len(w), 3 + doc_id % 6) between 5 and 7 and doc_id % 5 <> 0 as summary_ok from w""")
def study_material_checks(spark, sf_dir):
    """Ten cards and a summary cut from each document's words, some too long, too few or unexplained."""
    rows = documents(spark, sf_dir).select("doc_id", tx.words(F.coalesce("text", F.lit(""))).alias("w"))
    part = lambda at, n: F.array_join(F.slice("w", at, n), " ")
    cards = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.struct(
        part(i * 3 + 1, F.lit(3)).alias("front"), part(i * 5 + 1, (F.col("doc_id") % 7 + 20).cast("int")).alias("back")))
    bullets = F.slice("w", F.lit(1), (F.col("doc_id") % 6 + 3).cast("int"))
    return rows.select("doc_id", quiz.accepted_flashcards(cards).alias("cards_ok"),
                       quiz.accepted_summary(bullets, F.when(F.col("doc_id") % 5 != 0, "why").otherwise(" ")).alias("summary_ok"))


# --- responses ---------------------------------------------------------------------------------

def raw_responses(spark, sf_dir) -> DataFrame:
    """Assistant turns wrapped the ways models wrap JSON."""
    turns = read(spark, sf_dir, "conversations").where("role = 'assistant'")
    body = F.to_json(F.struct(F.col("text").alias("answer"), F.lit("high").alias("confidence")))
    m = (F.col("conv_id") + F.col("turn")) % 6
    wrapped = (
        F.when(m == 0, body).when(m == 1, F.concat(F.lit("Sure.\n```json\n"), body, F.lit("\n```\nDone.")))
        .when(m == 2, F.concat(F.lit("<think>let me {see}</think>"), body)).when(m == 3, F.concat(F.lit("The result {is} "), body))
        .when(m == 4, F.concat(F.lit("Here: ["), body, F.lit(", 3]"))).otherwise(F.lit("no json at all")))
    return turns.select("conv_id", "turn", wrapped.alias("response"))


@bound("recovered_json", """with m as (select conv_id, turn, text, (conv_id + turn) % 6 as m from conversations where role = 'assistant')
select conv_id, turn, case m when 0 then 'direct' when 2 then 'direct' when 5 then 'failed' else 'extracted' end as recovered,
    case when m <> 5 then text end as answer from m""")
def recovered_json(spark, sf_dir):
    parsed = responses.parse_json(raw_responses(spark, sf_dir))
    return parsed.select("conv_id", "turn", "recovered", F.get_json_object("json", "$.answer").alias("answer"))


def score_texts(spark, sf_dir) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    value = F.format_number("value", 2)
    m = k % 6
    text = (F.when(m == 0, k.cast("string")).when(m == 1, F.concat(F.lit("Score: "), (k / 10).cast("int").cast("string"), F.lit(".5 of 10")))
            .when(m == 2, F.concat(F.lit("-"), k.cast("string"))).when(m == 3, F.lit("none")).when(m == 4, F.lit("")).otherwise(F.lit(" 7.25 ")))
    return read(spark, sf_dir, "events").select("event_id", text.alias("t"), value.alias("v"))


@bound("rerank_scores", """with e as (select event_id, (props::json ->> '$.k')::int as k from events)
select event_id, case k % 6 when 0 then least(k, 10)::double when 1 then least(k // 10 + 0.5, 10)::double when 2 then 0::double when 5 then 7.25::double else 5::double end as score from e""")
def rerank_scores(spark, sf_dir):
    return score_texts(spark, sf_dir).select("event_id", responses.parse_score(F.col("t")).alias("score"))


@bound("stripped_reasoning", f"""select conv_id, turn, case turn % 4 when 1 then {sql.strip('text')} when 3 then {sql.strip("text || ' tail'")} else {sql.strip('text')} end as cleaned from conversations""")
def stripped_reasoning(spark, sf_dir):
    t = F.col("text")
    wrapped = F.when(F.col("turn") % 4 == 1, F.concat(F.lit("<think>a\nb</think>"), t)).when(
        F.col("turn") % 4 == 3, F.concat(F.lit("</think>"), t, F.lit("<think>x</think> tail"))).otherwise(t)
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", responses.strip_reasoning(wrapped).alias("cleaned"))


@bound("choice_questions", """select p_partkey, 0 as block, p_name as question, 'A) ' || p_brand || ' / B) ' || p_type || ' / C) None of the above / D) None of the above' as options,
    substr('ABCD', p_size % 4 + 1, 1) as answer from part""")
def choice_questions(spark, sf_dir):
    """Each part as a plain-text question with two of four options."""
    text = F.concat(F.lit("Q1) "), "p_name", F.lit("\nA) "), "p_brand", F.lit("\nb. "), "p_type", F.lit("\nAnswer: "),
                    F.substring(F.lit("abcd"), F.col("p_size") % 4 + 1, F.lit(1)), F.lit("\n\nno question here"))
    parsed = responses.parse_choice_text(read(spark, sf_dir, "part").select("p_partkey", text.alias("text")), "p_partkey")
    return parsed.select("p_partkey", "block", "question", F.array_join("options", " / ").alias("options"), "answer")


def layout_sql() -> str:
    lines = f"list_filter(list_transform(string_split(text, chr(10)), lambda s: {sql.strip('s')}), lambda s: s <> '')"

    def q(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    bullet = f"lambda s: '- ' || {sql.strip(chr(114) + 'egexp_replace(s, ' + chr(39) + '^[- ]+' + chr(39) + ', ' + chr(39) * 2 + ')')}"
    return f"""with l as (select conv_id, turn, {lines} as ls from conversations)
select conv_id, turn, case when len(ls) = 0 then {q(responses.NO_RESPONSE)} when turn % 2 = 0 then
    '## Quick Summary' || chr(10) || 'Section: **Part ' || turn || '**' || chr(10) || chr(10) || array_to_string(list_transform(ls[1 : 8], {bullet}), chr(10)) || {q(responses.SUMMARY_TAIL)}
    else '## Concept Overview' || chr(10) || 'Section: **Part ' || turn || '**' || chr(10) || chr(10) || array_to_string(ls[1 : 3], chr(10)) || chr(10) || chr(10)
    || '## Step-by-Step Explanation' || chr(10) || case when len(ls) > 3 then array_to_string(list_transform(ls[4 : 10], {bullet}), chr(10)) else {q(responses.EXPLAIN_DEFAULT)} end
    || {q(responses.EXPLAIN_TAIL)} end as layout from l"""


@bound("course_layouts", layout_sql())
def course_layouts(spark, sf_dir):
    action = F.when(F.col("turn") % 2 == 0, "summarize").otherwise("explain")
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", responses.course_layout(
        F.col("text"), action, F.concat(F.lit("Part "), F.col("turn").cast("string"))).alias("layout"))


# --- catalogue -------------------------------------------------------------------------------------

def catalogue(spark, sf_dir) -> DataFrame:
    d = F.col("doc_id")
    return read(spark, sf_dir, "documents").select(
        "doc_id", (d % 40).alias("user_id"), F.md5("text").alias("file_hash"),
        F.element_at(F.array(*[F.lit(s) for s in ("ready", "ready", "partially_ready", "processing", "failed")]), (d % 5 + 1).cast("int")).alias("status"),
        F.element_at(F.array(*[F.lit(s) for s in (*catalog.STAGES, "odd")]), (d % 6 + 1).cast("int")).alias("processing_stage"),
        (d * 7 % 1000).alias("created_at"))


CATALOGUE_SQL = f"""cat as (select doc_id, doc_id % 40 as user_id, md5(text) as file_hash, ({sql.lst(['ready', 'ready', 'partially_ready', 'processing', 'failed'])})[doc_id % 5 + 1] as status,
    ({sql.lst([*catalog.STAGES, 'odd'])})[doc_id % 6 + 1] as stage, doc_id * 7 % 1000 as created_at from documents)"""


@bound("document_states", f"""with {CATALOGUE_SQL} select doc_id, case status when 'failed' then 'failed' when 'processing' then 'processing' end as reason,
    case status when 'failed' then 0 when 'ready' then 100 when 'partially_ready' then 70 else case stage when 'embedded' then 40 when 'indexed' then 70 when 'uploaded' then 20
    when 'parsed' then 20 when 'structured' then 40 else 0 end end as progress, stage in ('uploaded', 'parsed', 'odd') as must_structure from cat""")
def document_states(spark, sf_dir):
    status, stage = F.col("status"), F.col("processing_stage")
    return catalogue(spark, sf_dir).select("doc_id", catalog.readiness(status).alias("reason"), catalog.progress(status, stage).alias("progress"),
                                           catalog.must_run(stage, F.lit("structured")).alias("must_structure"))


@bound("status_counts", f"""with {CATALOGUE_SQL} select user_id, count(*) filter (status = 'processing') as processing, count(*) filter (status = 'processing' and stage = 'uploaded') as queued,
    count(*) filter (status = 'ready') as completed, count(*) filter (status = 'partially_ready') as partially_ready, count(*) filter (status = 'failed') as failed from cat group by user_id""")
def status_counts(spark, sf_dir):
    return catalog.status_counts(catalogue(spark, sf_dir))


@bound("visible_documents", f"with {CATALOGUE_SQL} select user_id, doc_id, created_at from cat where status in ('ready', 'partially_ready')")
def visible_documents(spark, sf_dir):
    return catalog.visible_documents(catalogue(spark, sf_dir)).select("user_id", "doc_id", "created_at")


@bound("upload_checks", """with u as (select page_id, url, length(html) * 2000 as size, case page_id % 4 when 0 then 'a.PDF' when 1 then 'dir.v2/b.xlsx' when 2 then 'c.docx' else 'noext' end as f from pages)
select page_id, case page_id % 4 when 2 then 'Invalid type: .docx' when 3 then 'Invalid type: ' else case when size > 20971520 then 'File too large (> 20MB)' end end as reason from u""")
def upload_checks(spark, sf_dir):
    name = F.element_at(F.array(*[F.lit(n) for n in ("a.PDF", "dir.v2/b.xlsx", "c.docx", "noext")]), (F.col("page_id") % 4 + 1).cast("int"))
    return read(spark, sf_dir, "pages").select("page_id", catalog.upload_reason(name, F.length("html") * 2000).alias("reason"))


def uploads(spark, sf_dir) -> DataFrame:
    """Every document handed in again by another user; each third one is edited."""
    body = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return read(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("upload_id"), (F.col("doc_id") * 3 % 40).alias("user_id"), F.md5(body).alias("file_hash"))


@bound("upload_decisions", f"""with {CATALOGUE_SQL}, up as (select doc_id as upload_id, doc_id * 3 % 40 as user_id, md5(case when doc_id % 3 = 0 then text || '!' else text end) as file_hash from documents),
own as (select user_id, file_hash, arg_min(doc_id, (created_at, doc_id)) as d from cat where status = 'ready' group by all),
oth as (select file_hash, arg_min(doc_id, (created_at, doc_id)) as d from cat where status = 'ready' group by all)
select upload_id, case when own.d is not null then 'duplicate' when oth.d is not null then 'clone' else 'process' end as decision, coalesce(own.d, oth.d) as source_doc
from up left join own using (user_id, file_hash) left join oth using (file_hash)""")
def upload_decisions(spark, sf_dir):
    return catalog.upload_decisions(uploads(spark, sf_dir), catalogue(spark, sf_dir)).select("upload_id", "decision", "source_doc")


@bound("content_siblings", f"""with {CATALOGUE_SQL}, p as (select a.doc_id, arg_min(b.doc_id, (b.created_at, b.doc_id)) as sibling from cat a join cat b
    on a.file_hash = b.file_hash and a.doc_id <> b.doc_id and b.status = 'ready' group by a.doc_id)
select cat.doc_id, sibling from cat left join p using (doc_id)""")
def content_siblings(spark, sf_dir):
    return catalog.siblings(catalogue(spark, sf_dir)).select("doc_id", "sibling")


@bound("cloned_chunks", f"""with {CATALOGUE_SQL}, {WINDOWS_SQL}, up as (select doc_id + 1000000 as new_id, md5(text) as file_hash from documents where doc_id % 3 <> 0),
oth as (select file_hash, arg_min(doc_id, (created_at, doc_id)) as d from cat where status = 'ready' group by all)
select doc_id, ord, md5(text) as text_md5 from windows union all select new_id, ord, md5(text) from windows join oth on oth.d = windows.doc_id join up using (file_hash)""")
def cloned_chunks(spark, sf_dir):
    windows = chunking.sliding_windows(document_sections(spark, sf_dir)).select("doc_id", "ord", "text")
    new = uploads(spark, sf_dir).select((F.col("upload_id") + 1000000).alias("upload_id"), F.lit(-1).alias("user_id"), "file_hash")
    clones = catalog.upload_decisions(new, catalogue(spark, sf_dir)).where("decision = 'clone' and upload_id % 3 <> 1").select(
        F.col("upload_id").alias("doc_id"), "source_doc")
    return catalog.clone_rows(windows, clones).select("doc_id", "ord", F.md5("text").alias("text_md5"))


@bound("purged_tables", f"""with {WINDOWS_SQL} select 'windows' as name, count(*) as rows_left from windows where doc_id not in (select doc_id from labels where toxic = 1)
union all select 'labels', count(*) from labels where toxic <> 1""")
def purged_tables(spark, sf_dir):
    windows = chunking.sliding_windows(document_sections(spark, sf_dir))
    labels = read(spark, sf_dir, "labels")
    left = catalog.purge({"windows": windows, "labels": labels}, labels.where("toxic = 1"))
    out = None
    for name, table in left.items():
        row = table.agg(F.count("*").alias("rows_left")).withColumn("name", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out
