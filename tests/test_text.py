import re

import pyarrow as pa
from pyspark.sql import functions as F

from quillspark.functions import labels as lb, scoring as sc, text as tx
from quillspark.functions.terms import index_terms
from quillspark.operators import chunking, quiz, responses, sections

TEXTS = ["The Cat-sat on a\nmat, MAT! x", "", "  l'été\tde 2024 ", "it's C++ and C# -- again", "a\nb new\nline"]


def one(spark, value, *exprs):
    df = spark.createDataFrame([(value,)], "t string")
    return df.select(*[e.alias(f"c{i}") for i, e in enumerate(exprs)]).first()


def brute_tokens(text, legacy):
    text = text.lower()
    if not legacy:
        text = re.sub(r"\s", " ", text)
    words = re.sub(r"[^a-z0-9 ]", "", text).split()
    return [w for w in words if len(w) > 1 and w not in tx.STOP_WORDS]


def test_tokenizer_in_both_modes(spark):
    for text in TEXTS:
        row = one(spark, text, tx.tokenize(F.col("t")), tx.tokenize(F.col("t"), legacy=True))
        assert row.c0 == brute_tokens(text, False)
        assert row.c1 == brute_tokens(text, True)


def test_clean_text(spark):
    row = one(spark, " exam-\nple of\nlines\n\n\n\nnext\t  word ", tx.clean_text(F.col("t")))
    assert row.c0 == "example of lines\n\nnext word"


def test_query_sanitising_drops_recent_repeats(spark):
    assert one(spark, " a b A c d a ", tx.sanitize_query(F.col("t"))).c0 == "a b c d a"
    assert one(spark, "  ", tx.sanitize_query(F.col("t"))).c0 is None
    assert len(one(spark, "x" * 600, tx.sanitize_query(F.col("t"))).c0) == 600
    assert len(one(spark, "x" * 600, tx.sanitize_query(F.col("t"), 500)).c0) == 500


def test_query_validity(spark):
    wanted = {"s": False, "aa": False, "xq1": False, "what is ai": True, "  ": False, "123": True}
    for text, valid in wanted.items():
        assert one(spark, text, tx.is_valid_query(F.col("t"))).c0 is valid, text


def test_normalised_query_carries_its_keywords(spark):
    got = one(spark, "What is Gradient Descent", tx.normalize_query(F.col("t"))).c0
    assert got == "what is gradient descent | keywords: gradient descent"


def test_keyword_hits_respect_unicode_boundaries(spark):
    keys = F.array(*[F.lit(k) for k in ("eux", "c++", "mat", "c#", "mat")])
    text = "c++x mat c# deux"
    wanted = sum(bool(re.search(rf"\b{re.escape(k)}\b", text)) for k in ("eux", "c++", "mat", "c#", "mat"))
    assert one(spark, text, tx.keyword_hits(keys, F.col("t"))).c0 == wanted
    assert one(spark, "éeux", tx.keyword_hits(F.array(F.lit("eux")), F.col("t"))).c0 == 0


def test_phrase_match_beats_partial_match(spark):
    keys = F.array(F.lit("binary"), F.lit("search"), F.lit("tree"))

    def score(text):
        return one(spark, text, sc.relevance(F.lit(0.02), tx.keyword_hits(keys, F.col("t")), keys, F.col("t"))).c0

    assert score("a binary search tree is") > score("a tree with binary links and search")
    assert score("nothing here") < 0.5


def test_running_lines_are_removed_at_the_edges_only(spark):
    pages = ["HEAD\nbody one\nmore\nHEAD\nx\ny\nfoot", "HEAD\nbody two\nfoot", "other\nbody three", "last\nfoot"]
    df = spark.createDataFrame([(pages,)], "p array<string>")
    got = df.select(sections.strip_running_lines(F.col("p"))).first()[0]
    assert got == ["body one\nmore\nHEAD\nx\ny", "body two", "other\nbody three", "last"]
    two = spark.createDataFrame([(pages[:2],)], "p array<string>")
    assert two.select(sections.strip_running_lines(F.col("p"))).first()[0] == pages[:2]


MARKDOWN = """lost lead
# Title
intro text
## Part A

#### Deep
deep text
####### not a heading
| a | b |
|---|---|
| 1 | 2 | 3 |
| x |
## Part B
last"""


def test_headings_levels_and_tables(spark):
    docs = spark.createDataFrame([(1, MARKDOWN, None), (2, "plain | text", None)], "doc_id int, content string, pages array<string>")
    got = sections.normalize(docs).orderBy("doc_id", "section_ord").collect()
    assert [(r.doc_id, r.section_ord, r.heading, r.level) for r in got] == [
        (1, 1, "Title", "h1"), (1, 2, "Deep", "h3"), (1, 3, "Part B", "h2"), (2, 1, "Document Content", "h1")]
    assert got[1].tables == [[["a", "b"], ["1", "2", "3"], ["x"]]]
    assert got[0].tables == [] and "not a heading" in got[1].content


def test_table_lines_name_overflow_columns(spark):
    df = spark.createDataFrame([([["Name", "Age"], ["Al", "3", "x"]],)], "t array<array<string>>")
    assert df.select(chunking.eav_lines(F.col("t"))).first()[0].split("\n") == [
        "Entity: Al | Attribute: Name | Value: Al", "Entity: Al | Attribute: Age | Value: 3",
        "Entity: Al | Attribute: Column_3 | Value: x"]


def test_page_estimate(spark):
    pages = F.array(F.lit("alpha beta"), F.lit("gamma delta"), F.lit("gamma delta"))
    assert one(spark, "Gamma delta", sections.estimate_page(F.col("t"), pages)).c0 == 2
    assert one(spark, "nothing", sections.estimate_page(F.col("t"), pages)).c0 == 1


def brute_groups(sents):
    out, cur, n = [], [], 0
    for s in sents:
        cur.append(s)
        n += len(s.split())
        if n >= 350:
            out.append(" ".join(cur))
            cur = cur[-2:] if len(cur) > 2 else []
            n = sum(len(x.split()) for x in cur)
    if cur:
        tail = " ".join(cur)
        if n < 120 and out:
            out[-1] += " " + tail
        else:
            out.append(tail)
    return out


def test_sentence_groups_against_brute_force(spark):
    cases = [[], ["w " * 10 + "."], ["w " * 400 + "."], ["a " * n + "." for n in (100, 90, 80, 90, 40, 10, 200, 150, 30)],
             ["b " * 360 + ".", "c " * 20 + "."], ["d " * 118 + "."] * 7]
    cases = [[s.strip() for s in c] for c in cases]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, s array<string>")
    got = {r.i: r.g for r in df.select("i", chunking.group_sentences(F.col("s")).alias("g")).collect()}
    for i, c in enumerate(cases):
        assert got[i] == brute_groups(c), i


def test_levels_and_advice(spark):
    xs = [0, 99, 100, 299, 300, 700, 1499, 1500, 9000]
    df = spark.createDataFrame([(x,) for x in xs], "x int")
    assert [r[0] for r in df.select(lb.level(F.col("x"))).collect()] == [1, 1, 2, 2, 3, 4, 4, 5, 5]
    assert [r[0] for r in df.select(lb.xp_to_next(F.col("x"))).collect()][-2:] == [1500, 0]
    row = one(spark, "Graphs", *[c.alias(n) for n, c in lb.advice(F.col("t"), F.lit(0.2), F.lit("declining")).items()])
    assert row[3][0] == lb.DECLINING_STEP and row[2] == "critical" and row[5] == "high"


def test_subject_labels(spark):
    wanted = {'"python programming.pdf"': "Python", "ML": "Machine Learning", "doc_ab12 data structures": "Data Structures",
              "notes": "General", "x": "General", "one two three four five": "General", "deep-learning": "Deep-Learning"}
    for label, subject in wanted.items():
        assert one(spark, label, lb.sanitize_subject(F.col("t"))).c0 == subject, label


def test_question_validation(spark):
    base = dict(question="Q?", options=["a", "b", "c", "d"], correct_answer="b", explanation="e", topic="T", difficulty="easy")
    schema = ("i int, q struct<question:string,options:array<string>,correct_answer:string,explanation:string,topic:string,"
              "difficulty:string>")
    cases = [base, {**base, "options": ["a", "A ", "c", "d"]}, {**base, "correct_answer": "E"}, {**base, "explanation": " "},
             {**base, "options": ["a", "b", "c"]}, {**base, "difficulty": "odd"}]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], schema)
    assert [r[0] for r in df.orderBy("i").select(quiz.valid_question(F.col("q"), False)).collect()] == [
        True, False, False, False, False, True]
    assert [r[0] for r in df.orderBy("i").select(quiz.valid_question(F.col("q"), True)).collect()][-1] is False


def test_json_recovery():
    assert responses.recover_one('x ```json\n{"a": 1}\n``` y') == '{"a": 1}'
    assert responses.recover_one('think {not json} then {"a": {"b": 2}}') == '{"b": 2}'
    assert responses.recover_one("list [1, 2] end") == '{"questions": [1, 2]}'
    assert responses.recover_one("nothing") is None


def test_scores_and_reasoning(spark):
    for text, score in {"7": 7.0, "12": 10.0, "-3": 0.0, "Score: 8.5/10": 8.5, "none": 5.0, "": 5.0}.items():
        assert one(spark, text, responses.parse_score(F.col("t"))).c0 == score, text
    assert one(spark, "<think>a\nb</think> ok", responses.strip_reasoning(F.col("t"))).c0 == "ok"
    assert one(spark, "<think>a</think>", responses.strip_reasoning(F.col("t"))).c0 == "<think>a</think>"


def test_index_terms_of_columns_equal_the_expression(spark):
    every = [chr(c) for c in range(1, 0x3100) if not 0xD800 <= c < 0xE000] + ["\u212a", "\U0001f600"]
    texts = ["", None, "  ", "of the a", "Red\nfox,jumps over-fences 42", *[f"ab{c}Cd {c}x{c} the" for c in every]]
    for legacy in (False, True):
        rows = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1).select(tx.tokenize(F.col("text"), legacy).alias("w")).collect()
        found = index_terms(pa.array(["skipped", *texts])[1:], legacy)
        assert found.to_pylist() == [r.w for r in rows]
