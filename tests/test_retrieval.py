import math
import random
from collections import Counter
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.functions.similarity import mmr_order
from quillspark.operators import dense, diversity, evaluation, fusion, lexical, quality, subjects, suggest
from quillspark.plans import ask
from tests.test_text import brute_tokens

CHUNKS = [("a", 1, "red fox jumps\nover fences"), ("a", 2, "red red wine"), ("a", 3, "blue sky"), ("b", 1, "fox den fox"),
          ("b", 2, "empty the of"), ("b", 3, "wine cellar red"), ("c", 1, "x")]
QUERIES = [(1, "red fox fox"), (2, "unknown"), (3, ""), (4, "wine sky")]


@pytest.fixture(scope="module")
def tiny(spark):
    return (spark.createDataFrame(QUERIES, "query_id int, query string"),
            spark.createDataFrame(CHUNKS, "scope string, chunk_id int, text string"))


def brute_bm25(query, docs, k1=1.5, b=0.75):
    toks = {i: brute_tokens(t, False) for i, t in docs}
    n, avg = len(docs), sum(map(len, toks.values())) / len(docs)
    df = Counter(t for ts in toks.values() for t in set(ts))
    out = {}
    for i, ts in toks.items():
        tf = Counter(ts)
        score = sum(math.log((n - df[t] + .5) / (df[t] + .5) + 1) * tf[t] * (k1 + 1) / (tf[t] + k1 * (1 - b + b * len(ts) / avg))
                    for t in brute_tokens(query, False) if tf[t])
        if score > 0:
            out[i] = score
    return out


def test_bm25_matches_brute_force_per_scope(tiny):
    queries, chunks = tiny
    got = {(r.query_id, r.scope, r.chunk_id): r.score for r in lexical.bm25_top(queries, chunks, 10).collect()}
    want = {}
    for q, text in QUERIES:
        for scope in "abc":
            docs = [(c, t) for s, c, t in CHUNKS if s == scope]
            want.update({(q, scope, i): s for i, s in brute_bm25(text, docs).items()})
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_slices_of_queries_give_the_same_hits(monkeypatch):
    rng = np.random.default_rng(4)
    vectors, asked = rng.normal(size=(90, 8)), rng.normal(size=(17, 8))
    scope, ids, query_ids = pa.array([f"s{i % 3}" for i in range(90)]), pa.array(range(90)), pa.array(range(17))
    hits = lambda: sorted(map(str, pa.Table.from_batches(list(dense._block_hits(asked, query_ids, scope, ids, vectors, 4))).to_pylist()))
    whole = hits()
    monkeypatch.setattr(dense, "SCORE_CELLS", 90 * 5)
    assert hits() == whole and len(whole) == 17 * 3 * 4


def test_dense_paths_agree(spark, monkeypatch):
    rng = np.random.default_rng(3)
    vecs = rng.normal(size=(300, 8))
    vecs[100:140] = vecs[0]
    corpus = spark.createDataFrame([("hot" if i % 3 else f"s{i % 5}", i, v.tolist()) for i, v in enumerate(vecs)],
                                   "scope string, chunk_id int, embedding array<double>")
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(20, 8)))],
                                  "query_id int, embedding array<double>")
    rows = lambda df: sorted((r.query_id, r.scope, r.rank, r.chunk_id, round(r.score, 7)) for r in df.collect())
    wide = rows(dense.dense_top(asked, corpus, 4))
    monkeypatch.setattr(dense, "BROADCAST_CELLS", 64 * 5)
    monkeypatch.setattr(dense, "BLOCK_QUERIES", 6)
    monkeypatch.setattr(dense, "BLOCK_ROWS", 70)
    assert rows(dense.dense_top(asked, corpus, 4)) == wide
    unit = vecs / np.linalg.norm(vecs, axis=1, keepdims=True)
    first = asked.where("query_id = 0").first().embedding
    scores = np.round(unit @ (np.array(first) / np.linalg.norm(first)), 8)
    hot = sorted((i for i in range(300) if i % 3), key=lambda i: (-scores[i], i))[:4]
    assert [r[3] for r in wide if r[0] == 0 and r[1] == "hot"] == hot


def test_variant_fold(spark):
    df = spark.createDataFrame([(0.5, 0.6), (0.5, 0.2), (None, 0.2), (0.5, None)], "a double, b double")
    got = [r[0] for r in df.select(fusion.fold_replace_or_add(F.col("a"), F.col("b"))).collect()]
    assert got == [0.6, pytest.approx(0.56), 0.2, 0.5]


def test_fusion_ignores_score_scale(spark):
    rows = [(1, "s", c, float(v), float(b) if b else None) for c, v, b in ((1, 9, 2), (2, 8, 5), (3, 7, None), (4, 6, 9))]
    strategy = spark.createDataFrame([(1, .5, .5, 10, 7)], "query_id int, vector_weight double, bm25_weight double, rrf_k int, top_k int")
    schema = "query_id int, scope string, chunk_id int, vector_score double, bm25_score double"
    base = spark.createDataFrame(rows, schema)
    scaled = base.withColumns({"vector_score": F.col("vector_score") * 100, "bm25_score": F.col("bm25_score") / 7})
    order = lambda df: [(r.rank, r.chunk_id, round(r.rrf_score, 9)) for r in fusion.rank_fusion(df, strategy).orderBy("rank").collect()]
    assert order(base) == order(scaled)
    assert order(base)[0][2] == pytest.approx(.5 / 11 + .5 / 13) or order(base)[0][1] in (2, 4)


def test_mmr_keeps_the_first_and_no_near_copies():
    rng = np.random.default_rng(0)
    v = rng.normal(size=(12, 6))
    v[3] = v[0] * 1.001
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    chosen = mmr_order(np.linspace(.1, .01, 12), v, .7, .85, 10)
    assert chosen[0] == 0 and 3 not in chosen and len(chosen) <= 10
    sims = v[chosen] @ v[chosen].T - np.eye(len(chosen))
    assert sims.max() <= .85


def test_mmr_groups(spark):
    rows = [(g, i + 1, i, 0.1 - i / 100, [1.0, i / 5.0]) for g in ("x", "y") for i in range(6)] + [("z", 1, 0, .1, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "g string, rank int, chunk_id int, rrf_score double, embedding array<double>")
    got = diversity.mmr(df, ["g"], 3).collect()
    assert {(r.g, r.chunk_id) for r in got if r.mmr_rank == 1} == {("x", 0), ("y", 0), ("z", 0)}


def test_budget_cuts_only_the_first_overflow(spark):
    rows = [(1, 1, "text", .9, "w " * 400), (1, 2, "text", .8, "w " * 400), (1, 3, "text", .7, "w " * 500), (1, 4, "text", .6, "w"),
            (1, 5, "parent", .95, "w " * 10), (2, 1, "text", .9, "w " * 1000), (3, 1, "text", .9, "w " * 990), (3, 2, "text", .8, "w " * 50)]
    df = spark.createDataFrame(rows, "q int, rank int, type string, rrf_score double, text string")
    got = {(r.q, r.rank): (r.context_rank, r.truncated, r.used_tokens) for r in diversity.context_budget(df, ["q"], 1500).collect()}
    assert got == {(1, 1): (1, False, 600), (1, 2): (2, False, 600), (1, 3): (3, True, 300), (2, 1): (1, False, 1500), (3, 1): (1, False, 1485)}


def brute_near(rows, keep):
    out = []
    for t in rows:
        if len(out) < keep and not any(SequenceMatcher(None, t, o).ratio() >= .9 for o in out):
            out.append(t)
    return out


def test_near_copies_stream(spark):
    rng = random.Random(1)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(60)) for _ in range(6)]
    texts = [b if rng.random() < .3 else b[:-1] + "z" if rng.random() < .5 else b[10:] for b in base * 6]
    rows = [(1, "s", i, 1.0 - i / 1000, t) for i, t in enumerate(texts)] + [(2, "s", 0, .5, "  "), (2, "s", 1, .4, "one")]
    df = spark.createDataFrame(rows, "query_id int, scope string, chunk_id int, rrf_score double, text string")
    got = diversity.drop_near_copies(df, "query_id", "rrf_score", .9, 5).orderBy("query_id", "pool_rank").collect()
    seen = list(dict.fromkeys(t.strip() for t in texts))
    assert [r.text.strip() for r in got if r.query_id == 1] == brute_near(seen, 5)
    assert [r.text for r in got if r.query_id == 2] == ["one"]


def test_spread_over_scopes(spark):
    rows = [(1, "a", i) for i in (1, 2, 3, 4)] + [(1, "b", 5)] + [(2, "a", 1), (2, "a", 2)]
    df = spark.createDataFrame(rows, "q int, scope string, rank int")
    got = diversity.spread_over_scopes(df, "q", "rank", 3, 1).orderBy("q", "spread_rank").collect()
    assert [(r.q, r.rank) for r in got] == [(1, 1), (1, 5), (1, 2), (2, 1), (2, 2)]


def test_similar_pairs_miss_nothing(spark):
    rng = random.Random(5)
    words = list({"".join(rng.choice("abcdeé1 ") for _ in range(rng.randint(2, 9))).strip() or "q" for _ in range(60)})
    terms = list({"".join(rng.choice("abcdeé1 ") for _ in range(rng.randint(2, 9))).strip() or "q" for _ in range(80)})
    left = spark.createDataFrame([(w,) for w in words], "word string")
    right = spark.createDataFrame([(t,) for t in terms], "term string")
    for floor in (.62, .72):
        got = {(r.word, r.term): r.ratio for r in suggest.similar_pairs(left, right, floor).collect()}
        want = {(w, t): x for w in words for t in terms if (x := SequenceMatcher(None, t, w).ratio()) >= floor}
        assert got == want


def test_corrections(spark):
    vocab = spark.createDataFrame([("s", t) for t in ("machine", "learning", "network", "tree")], "scope string, term string")
    asked = spark.createDataFrame([(1, "s", "Machien lerning of tree zz"), (2, "s", "network")], "query_id int, scope string, query string")
    found = suggest.corrections(asked, vocab)
    fixed = {r.query_id: (r.corrected, r.did_you_mean) for r in suggest.corrected_queries(asked, found).collect()}
    assert fixed == {1: ("machine learning of tree zz", True), 2: ("network", False)}


def test_autocomplete_orders_prefix_before_fuzzy(spark):
    terms = spark.createDataFrame([("s", "graph", 5), ("s", "graph theory", 9), ("s", "grahp", 50), ("s", "tree", 99)],
                                  "scope string, term string, weight int")
    asked = spark.createDataFrame([(1, "s", " Graph "), (2, "s", "g")], "query_id int, scope string, prefix string")
    got = suggest.autocomplete(asked, terms, 8).orderBy("rank").collect()
    assert [r.term for r in got] == ["graph theory", "graph", "grahp"]


def test_near_duplicate_chunks(spark):
    text = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega"
    rows = [(1, 1, "a", text), (1, 2, "b", text + " extra"), (1, 3, "c", " ".join(reversed(text.split()))[:40] + " other words " * 10),
            (2, 1, "d", text), (1, 4, "e", "short alpha")]
    df = spark.createDataFrame(rows, "doc_id int, position int, chunk_id string, text string")
    assert {r.chunk_id for r in quality.near_duplicates(df).collect()} == {"b"}
    assert {r.chunk_id: r.distinct for r in quality.checks(df).collect()}["b"] is False


def test_canonical_subjects(spark):
    rows = [(1, "Machine Learning"), (2, "machine learning basics"), (3, "Machine Learning"), (4, "History"), (5, "")]
    df = spark.createDataFrame(rows, "doc_id int, subject string")
    got = {r.doc_id: r.canonical for r in subjects.canonical_subjects(df).collect()}
    assert got == {1: "Machine Learning", 2: "Machine Learning", 3: "Machine Learning", 4: "History", 5: "General Studies"}


def test_subject_classifier_bonus(spark):
    rows = [(1, "Artificial intelligence and machine learning with ai agents"), (2, "def f(x): python tuple"), (3, "poetry")]
    df = spark.createDataFrame(rows, "doc_id int, sample string")
    got = {r.doc_id: r.subject for r in subjects.classify(df).collect()}
    assert got == {1: "Artificial Intelligence", 2: "Python", 3: "General Studies"}


def test_ask_end_to_end(spark):
    chunks = spark.createDataFrame(
        [("d1", 1, "A binary tree is a tree whose nodes have two children. It is used for searching. More text follows here."),
         ("d1", 2, "Cooking pasta requires water and salt in a pot."), ("d2", 1, "Graph theory studies nodes and edges.")],
        "scope string, chunk_id int, text string")
    asked = spark.createDataFrame([(1, "What is binary"), (2, "quantum chromodynamics"), (3, "xx")], "query_id int, query string")
    got = {r.query_id: r for r in ask.ask(asked, chunks).collect()}
    assert 3 not in got and got[2].status != "ok"
    assert got[1].status == "ok" and got[1].path == "extractive" and got[1].answer.startswith("A binary tree")


def test_bm25_scan_gives_the_hits_of_the_joins(spark, monkeypatch):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(30)]
    texts = [(f"s{i % 3}" if i % 17 else None, i, " ".join(rng.choices(words, k=rng.randint(0, 12))) if i % 13 else None) for i in range(300)]
    chunks = spark.createDataFrame(texts + [("s1", 1000 + i, "w1 w2 w3") for i in range(40)], "scope string, chunk_id int, text string").repartition(3)
    asked = spark.createDataFrame([(i if i else None, " ".join(rng.choices(words, k=4))) for i in range(9)], "query_id int, query string")
    hits = lambda: sorted(map(str, lexical.bm25_top(asked, chunks, 4).withColumn("score", F.round("score", 7)).collect()))
    scanned = hits()
    plan = lexical.bm25_top(asked, chunks, 4)._jdf.queryExecution().toString()
    assert "Join" not in plan  # no row for a pair of a chunk and a query with a word in common
    monkeypatch.setattr(lexical, "BLOCK_CELLS", 200)
    assert hits() == scanned
    monkeypatch.setattr(lexical, "SCAN_CELLS", 0)
    assert hits() == scanned and len(scanned) > 90


def test_terms_filtered_for_prefixes_complete_them_alike(spark):
    rng = random.Random(8)
    words = ["river", "rivet", "ride", "diver", "stone", "store", "alone", "riverside", "rive"]
    rows = [(f"s{i % 2}", i, " ".join(rng.choices(words, k=30)), "River Stone" if i % 3 else None) for i in range(20)]
    chunks = spark.createDataFrame(rows, "scope string, chunk_id int, text string, section string")
    asked = spark.createDataFrame([(1, "s0", " Rive"), (2, "s1", "st"), (3, "s1", "x"), (4, "s9", "ri")], "query_id int, scope string, prefix string")
    every = lexical.search_terms(chunks)
    for floor in (0.65, 0.9, 1.01):
        few = lexical.search_terms(chunks, only=suggest.completing(asked, floor))
        assert 0 < few.count() < every.count()
        found, wanted = (sorted(map(str, suggest.autocomplete(asked, t, 6, floor).collect())) for t in (few, every))
        assert found == wanted and found


def test_passages_are_found_in_place_as_by_the_joins(spark, monkeypatch):
    texts = ["one  two\tthree", "two three", "twofold three", None, "", "x one two\nthree four", " one two three", "one two threes"]
    chunks = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string")
    asked = [(1, "one two three"), (2, " two three "), (3, ""), (4, None), (5, "absent"), (6, "four")]
    passages = spark.createDataFrame(asked, "query_id int, query string")
    wanted = sorted((q, c) for q, p in asked if (p or "").split() for c, t in enumerate(texts)
                    if f" {' '.join(p.split())} " in f" {' '.join((t or '').split())} ")
    found = evaluation.passage_gold(passages, chunks)
    assert sorted(map(tuple, found.collect())) == wanted
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(evaluation, "SENT_PASSAGES", 1)
    assert sorted(map(tuple, evaluation.passage_gold(passages, chunks).collect())) == wanted
