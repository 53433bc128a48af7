"""The operators on awkward rows and against plain versions."""

import collections
import itertools
import os
import random
import zlib
from array import array
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
import tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from quillspark.llm import (bpe, components, language, line_dedup, line_rules, merkle, mixing, negatives, ngram_join, packing, periodic, queries, repeats, secrets, syncmers)
from quillspark.plans.lineage import rewritten, stored
from tests.llm import brute

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables missing")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, _id string, line string, key int, slot double, row int, mark string"

WORDS = "the of and river stone paper light garden window number quick brown letter silver morning ocean market winter".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def awkward():
    """Nulls, empty, short and long texts, copies, near copies, repeated rows and shared passages."""
    rng = random.Random(5)
    passage, base = sentence(rng, 60), sentence(rng, 120)
    edited = base.split()
    edited[50] = "changed"
    line = sentence(rng, 12)
    texts = [None, "", " \n\t ", "One.", "two words", "Über straße größe", base, base, " ".join(edited), base.upper(), passage + "\n" + sentence(rng, 90),
             sentence(rng, 90) + "\n" + passage, line + "\n\n" + line + "\n" + sentence(rng, 30), line[:-1] + "x\n" + sentence(rng, 25), "x" * 900, "y" * 450,
             ("ab " * 400).strip(), sentence(rng, 9000), "token = \"abcdef0123456789abcdef0123\" AKIA" + "Z9" * 9, " \x1c\x85 a b \U0001f600"]
    rows = [(i, t, ["en", None, "de"][i % 3], ["src0", None, "src1"][i % 3], len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[6], rows[12], (None, base, None, None, 1), (None, "lonely words of a row without an id", "en", "src0", 2), (-5, "One.", "fr", "src2", 4)]
    return [(*r, "a", "b", 1, 2.0, 3, "m") for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), COLUMNS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


def texts_of(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


def ordered(rows):
    return sorted(rows, key=repr)


# -- secrets ------------------------------------------------------------------

def test_base_spans_match_plain_scan(spark, docs):
    more = ["token=abcdef token=abc secret: token: abcdefgh", "é" * 5 + "PASSWORD : \"x.y-z_1234\"", "a" * 30, "AKIA" + "B" * 16 + " AKIA" + "B" * 15,
            "apikey='short' API_KEY:longenough", " ".join(f"token=abcdefgh{i}" for i in range(700)), "toKen=abcdefgh ſecret=abcdefgh"]
    rows = spark.createDataFrame(list(enumerate(more)), "doc_id long, text string").union(docs.select("doc_id", "text"))
    model = secrets.learn(rows)
    for row in rows.select("text", *[c.alias(k) for k, c in secrets.base_spans(F.coalesce("text", F.lit(""))).items()]).collect():
        found = sorted((s["start"], secrets.KINDS.index(k), k, s["end"]) for k in ("assign", "access", "hex") for s in row[k])
        assert found == brute.secrets(row["text"])
    scanned = secrets.scan(rows, model, ["doc_id"])
    assert scanned.count() == rows.count() and scanned.columns == ["doc_id", "found"]


def test_markov_spans_tell_random_from_ordinary(spark):
    rng = random.Random(1)
    hexes = ["".join(rng.choices("0123456789abcdef", k=40)) for _ in range(300)]
    keys = ["".join(rng.choices(secrets.ALPHABET[:62], k=32)) for _ in range(300)]
    train = [(f"token = {h} and " + sentence(rng, 10),) for h in hexes] + [(f"secret: {k}",) for k in keys] + [(sentence(rng, 200),) for _ in range(50)]
    model = secrets.learn(spark.createDataFrame(train, "text string"))
    unseen = ["".join(rng.choices(secrets.ALPHABET[:62], k=32)) for _ in range(100)]
    names = ["_".join(rng.choices(WORDS, k=5)) for _ in range(100)]
    rows = spark.createDataFrame([(f"see {t} here", i < 100) for i, t in enumerate(unseen + names)], "text string, random boolean")
    found = secrets.scan(rows, model, ["random", "text"]).collect()
    assert all(all(s["kind"] == "markov" for s in r["found"]) for r in found)
    assert sum(len(r["found"]) == 1 for r in found if r["random"]) >= 95
    assert sum(len(r["found"]) for r in found if not r["random"]) <= 2
    one = next(r for r in found if r["random"] and r["found"])
    assert one["text"][one["found"][0]["start"]:one["found"][0]["end"]] in unseen


def test_scan_without_rows(empty):
    assert secrets.scan(empty, secrets.learn(empty), ["doc_id"]).count() == 0


# -- repeated strings -----------------------------------------------------------

def test_repeats_match_plain_search(spark, docs, empty):
    rows = docs.where("length(text) < 20000 or text is null")
    found = repeats.remove_repeats(rows).collect()
    pairs = texts_of(rows)
    wanted = [(i, *r) for (i, _), r in zip(pairs, brute.repeats([t for _, t in pairs]))]
    assert ordered((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in found) == ordered(wanted)
    assert repeats.remove_repeats(empty).count() == 0


def test_repeats_inside_slabs(spark):
    rng = random.Random(9)
    pool = ["".join(rng.choices("ab", k=rng.randrange(150, 320))) for _ in range(12)]
    texts = ["".join(rng.choices(pool, k=rng.randrange(1, 4))) + "c" * rng.randrange(3) for _ in range(60)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: tuple(r)[1:] for r in repeats.remove_repeats(rows).collect()}
    for i, want in enumerate(brute.repeats(texts)):
        assert (*found[i][:3], bytes(found[i][3])) == want


# -- n-gram join ------------------------------------------------------------------

def test_components_match_all_pairs(spark, docs, empty):
    rng = random.Random(2)
    base = [sentence(rng, rng.randrange(5, 60)).split() for _ in range(25)]
    texts = []
    for _ in range(220):
        words = list(rng.choice(base))
        for _ in range(rng.randrange(0, 3)):
            words[rng.randrange(len(words))] = rng.choice(["swap", "turn", "other"])
        texts.append(" ".join(words[:rng.choice([len(words), len(words), len(words) - 1])]))
    many = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for rows in (docs, many):
        found = ngram_join.join(rows).collect()
        pairs = texts_of(rows)
        wanted = [(i, *c) for (i, _), c in zip(pairs, brute.components(pairs))]
        assert ordered((r["doc_id"], r["n"], r["component_id"]) for r in found) == ordered(wanted)
    assert ngram_join.join(empty).count() == 0


def test_representatives_keep_one_of_each_component(docs):
    pairs = texts_of(docs)
    kept = ngram_join.representatives(docs)
    assert kept.columns == docs.columns
    wanted = {c for (_, t), (n, c) in zip(pairs, brute.components(pairs)) if n}
    with_words = [r for r in kept.collect() if (r["text"] or "").strip()]
    assert ordered({r["doc_id"] for r in with_words}) == ordered(wanted) and len(with_words) == len(wanted)
    assert kept.where("text is null or trim(text, ' \\n\\t') = ''").count() == docs.where("text is null or trim(text, ' \\n\\t') = ''").count()


def test_representatives_tell_components_apart_by_label(spark):
    rng = random.Random(21)
    texts = [sentence(rng, 40) for _ in range(5)]
    near = texts[0] + " tail"
    rows = [(None, texts[0]), (None, near), (None, texts[1]), (None, texts[2]), (7, texts[3]), (7, texts[4]), (7, texts[4]), (8, texts[4]), (None, texts[4])]
    kept = ngram_join.representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = [(r["doc_id"], r["text"]) for r in kept]
    assert sum(r in [(None, texts[0]), (None, near)] for r in found) == 1
    assert ordered(r for r in found if r[1] not in (texts[0], near)) == ordered([(None, texts[1]), (None, texts[2]), (7, texts[3]), (7, texts[4])])


def test_near_duplicate_stage_takes_five_words_and_80_percent(spark):
    rng = random.Random(22)
    rows, edits = [], {100: 1, 46: 1, 60: 1, 200: 3}
    for n, k in edits.items():
        base = [f"w{n}x{i}" for i in range(n)]
        copy = list(base)
        for i in range(k):
            copy[(i + 1) * n // (k + 1)] = "changed"
        rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(copy))]
    base = [f"y{i}" for i in range(70)]
    rows += [(50, " ".join(base)), (51, " ".join(base[:30] + ["a", "b", "c"] + base[33:])), (52, sentence(rng, 40))]
    wide, narrow = brute.components(rows, 5, 80), brute.components(rows)
    assert wide != narrow
    table = spark.createDataFrame(rows, "doc_id long, text string")
    found = ngram_join.join(table, width=5, percent=80).collect()
    assert ordered((r["doc_id"], r["n"], r["component_id"]) for r in found) == ordered((i, *c) for (i, _), c in zip(rows, wide))
    kept = corpus_pipeline.drop_near_duplicates(spark, table, "").collect()
    assert {r["doc_id"] for r in kept} == {c for _, c in wide} != {c for _, c in narrow}


def test_far_is_a_lower_bound():
    import numpy as np
    rng = random.Random(4)
    for _ in range(300):
        x, y = (np.array(sorted(rng.sample(range(60), rng.randrange(1, 30))), np.uint64) for _ in range(2))
        for most in (0, 5, 100):
            assert ngram_join._far(x, y, most, 3) <= len(set(x.tolist()) ^ set(y.tolist()))


def test_star_components(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)]
    found = {r["node"]: r["label"] for r in components.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    label = {n: n for e in edges for n in e}
    for _ in range(400):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert found == {n: x for n, x in label.items() if any(n in e and e[0] != e[1] for e in edges)}


# -- byte-level BPE -----------------------------------------------------------------

def test_bpe_equals_the_public_tokenizer(spark, docs, empty):
    ranks = bpe.load_ranks(public_tokenizers.path(corpus_pipeline.VOCABULARY))
    model = bpe.serialise_model(ranks)
    public = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(3)
    pool = [chr(rng.choice([rng.randrange(128), rng.randrange(0x80, 0x250), rng.randrange(0x400, 0x3000), 0x20, 0x0A, 0x85, 0xA0, 39, 115])) for _ in range(2000)]
    odd = spark.createDataFrame([(i, "".join(rng.choices(pool, k=rng.randrange(60)))) for i in range(800)], "doc_id long, text string")
    for row in bpe.encode(odd.union(docs.select("doc_id", "text")), model, public_tokenizers.PATTERN, ["text"]).collect():
        assert array("I", bytes(row["ids"])).tolist() == public.encode_ordinary(row["text"] or "")
        assert bytes(row["decoded"]).decode() == (row["text"] or "")
    codec = bpe.Codec(model, public_tokenizers.PATTERN)
    assert [codec.decode(array("I", [i]).tobytes()) for i in range(len(ranks))] == sorted(ranks, key=ranks.get)
    assert bpe.encode(empty, model, public_tokenizers.PATTERN, empty.columns).count() == 0


# -- lines ----------------------------------------------------------------------------

def test_bit_parallel_distance(spark):
    rng = random.Random(7)
    rows = []
    for _ in range(1500):
        a = "".join(rng.choices("abé", k=rng.randrange(12)))
        b = list(a)
        for _ in range(rng.randrange(5)):
            at = rng.randrange(len(b) + 1)
            b[at:at + rng.randrange(2)] = rng.choices("abé", k=rng.randrange(2))
        rows.append((a, "".join(b)))
    frame = spark.createDataFrame(rows, "a string, b string")
    for r in frame.select("a", "b", line_dedup.within(F.col("a"), F.col("b")).alias("close"), line_dedup.trimmed(F.col("a"), F.col("b")).alias("t")).collect():
        assert r["close"] == (brute.distance(r["a"], r["b"]) <= line_dedup.EDITS)
        assert brute.distance(r["t"]["a"], r["t"]["b"]) == brute.distance(r["a"], r["b"])


def test_line_states_match_all_pairs(spark, docs, empty):
    rng = random.Random(8)
    base = [sentence(rng, 8) for _ in range(12)]
    texts = []
    for _ in range(60):
        lines = []
        for _ in range(rng.randrange(1, 6)):
            line = list(rng.choice(base))
            for _ in range(rng.randrange(4)):
                at = rng.randrange(len(line))
                line[at:at + rng.randrange(2)] = rng.choices("abc", k=rng.randrange(2))
            lines.append("".join(line))
        texts.append("\n".join(lines))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: [tuple(x) for x in r["lines"]] for r in line_dedup.verdicts(rows).collect()}
    assert found == brute.line_states(list(enumerate(texts)), line_dedup.EDITS, line_dedup.MIN_NEAR)
    kept = line_dedup.deduplicate(docs)
    assert kept.columns == docs.columns and kept.where("text is null").count() == 1
    seen = [x for r in kept.dropDuplicates().collect() for x in (r["text"] or "").split("\n") if x.strip()]
    assert len(seen) == len(set(seen))
    assert line_dedup.deduplicate(empty).count() == 0


def test_allowed_edits_grow_with_the_line(spark):
    rng = random.Random(23)
    lines = []
    for n in [20, 24, 27, 28, 33, 39, 40, 41, 54, 55, 58, 74, 75, 76, 99, 100, 101, 124, 149, 150, 155, 165, 186, 188, 203, 234, 338, 454, 599, 601, 624, 1104]:
        base = (sentence(rng, 3 + n // 4))[:n]
        for _ in range(6 if n < 110 else 2):
            line = list(base)
            for _ in range(max(0, line_dedup.allowed(n) + rng.randrange(-2, 2))):
                at = rng.randrange(len(line) + 1)
                line[at:at + rng.randrange(2)] = rng.choices("abé", k=rng.randrange(2))
            lines.append("".join(line))
    word = sentence(rng, 22)
    lines += [word, word.replace(word.split()[9], "another")]
    rng.shuffle(lines)
    rows = [(i, line) for i, line in enumerate(lines)]
    found = {r["doc_id"]: [tuple(x) for x in r["lines"]] for r in line_dedup.verdicts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    wanted = brute.line_states(rows, None, line_dedup.MIN_NEAR, line_dedup.allowed)
    assert found == wanted
    assert wanted != brute.line_states(rows, 2, 40)


def test_a_repeated_phrase_gives_a_key_once_per_cell(spark):
    lines = spark.createDataFrame([(1, len(line), line) for line in ["Is onhe. " * 200]], "h1 long, n int, line string")
    keys = [r["key"] for r in line_dedup.probe_keys(lines).collect()]
    assert keys and len(keys) == len(set(keys))


def test_a_family_of_near_copies_does_not_meet_in_all_pairs(spark, monkeypatch):
    rng = random.Random(41)
    base = sentence(rng, 120)[:330]
    edits = line_dedup.allowed(len(base))

    def edited(line, places):
        return "".join("#" if i in places else c for i, c in enumerate(line))

    rows = [(0, base)] + [(i, edited(base, rng.sample(range(30, 300), 2))) for i in range(1, 121)]
    # Too far from the leader; close to that one only; as far as the edits reach; an exact copy.
    far = edited(base, range(40, 300, 12))
    rows += [(200, far), (201, edited(far, [35])), (202, edited(base, range(45, 45 + 20 * edits, 20))), (203, base)]
    made, candidates = [], line_dedup.candidates

    def counted(*args):
        found = candidates(*args)
        made.append(found.distinct().count())
        return found

    monkeypatch.setattr(line_dedup, "candidates", counted)
    states = {r["doc_id"]: r["lines"][0]["state"] for r in line_dedup.verdicts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i for i, state in states.items() if state == "first"} == {0, 200}
    assert {i for i, state in states.items() if state == "exact"} == {203}
    assert made[0] < 10 * len(rows)


def test_pairs_of_a_family_are_compared_in_passes(spark, monkeypatch):
    rng = random.Random(43)
    # Near misses: a common middle, other ends; each fifth is a copy of the line before it with a few edits.
    middle, lines = sentence(rng, 60)[:150], []
    for i in range(40):
        line = lines[-1][:40] + "#" + lines[-1][42:] if i % 5 == 4 else sentence(rng, 12)[:25] + middle + sentence(rng, 12)[:25]
        lines.append(line)
    rows, sizes, verified = list(enumerate(lines)), [], line_dedup.verified

    def counted(pairs, texts):
        sizes.append(pairs.count())
        return verified(pairs, texts)

    monkeypatch.setattr(line_dedup, "verified", counted)
    monkeypatch.setattr(line_dedup, "PASS_LEAST", 1 << 16, raising=False)
    found = {r["doc_id"]: [tuple(x) for x in r["lines"]] for r in line_dedup.verdicts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == brute.line_states(rows, None, line_dedup.MIN_NEAR, line_dedup.allowed)
    assert sum(sizes) > 500 > max(sizes)


def test_a_rewritten_table_is_on_disk_once(spark):
    table = stored(spark.range(40).selectExpr("id", "cast(id % 4 as int) as part"), "part")
    seen = []

    def change(rows):
        seen.append(len(list(Path(table.stored_at.removeprefix("file:")).glob("part=*"))))
        return rows.withColumn("twice", F.col("id") * 2)

    new = rewritten(table, "part", [0, 1, 2, 3], change)
    assert sorted(r["twice"] for r in new.where("part = 1").collect()) == [2 * i for i in range(1, 40, 4)]
    assert new.count() == 40 and seen == [4, 4, 3, 2, 1] and not Path(table.stored_at.removeprefix("file:")).exists()


def test_long_lines_of_any_shape(spark):
    rng = random.Random(29)
    shapes = [lambda n: (sentence(rng, n // 4))[:n], lambda n: "".join(rng.choices("abcdefgh", k=n)), lambda n: "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(n)),
              lambda n: " ".join("".join(rng.choices("xyz", k=rng.randrange(1, 25))) for _ in range(n))[:n], lambda n: " " * (n // 3) + "q" * (n - n // 3)]
    lines = []
    for n in (150, 187, 299, 312, 720, 2_000):
        for shape in shapes[:1] if n > 1000 else shapes:
            base = shape(n)
            for spread in (1, 1, n):
                line, start = list(base), rng.randrange(n // 2)
                for _ in range(line_dedup.allowed(n) + rng.randrange(-1, 2)):
                    at = min(start + rng.randrange(max(1, spread)), len(line))
                    line[at:at + rng.randrange(2)] = rng.choices("abé ", k=rng.randrange(1, 2))
                lines.append("".join(line))
    rng.shuffle(lines)
    rows = list(enumerate(lines))
    found = {r["doc_id"]: [tuple(x) for x in r["lines"]] for r in line_dedup.verdicts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == brute.line_states(rows, None, line_dedup.MIN_NEAR, line_dedup.allowed)


# -- quality rules ----------------------------------------------------------------------

def test_counts_match_plain_ones(docs, empty):
    rng = random.Random(11)
    for text in [r["text"] for r in docs.collect()] + [" ".join(rng.choices("ab", k=rng.randrange(60))) for _ in range(200)]:
        if len(text or "") < 20000:
            assert line_rules.count(text) == brute.quality(text)
    assert line_rules.measure(docs, ["doc_id"]).count() == docs.count() and line_rules.depletion(empty).count() == 0


def test_depleted_documents(spark):
    rng = random.Random(12)
    menu, own = "\n".join(sentence(rng, 6) for _ in range(8)), [sentence(rng, 60) for _ in range(30)]
    rows = [(i, "host", menu + f"\nunique{i} end") for i in range(30)] + [(100 + i, "host", t + "\n" + menu.split("\n")[0]) for i, t in enumerate(own)]
    rows += [(200 + i, "copied", own[0]) for i in range(30)] + [(300 + i, None, menu + f"\nnull{i} end") for i in range(30)] + [rows[0]]
    frame = spark.createDataFrame(rows, "doc_id long, source string, text string")
    left = {r["_id"]: r["left"] for r in line_rules.depletion(frame, max_texts=10).collect()}
    assert all(left[i] < line_rules.MIN_LEFT for i in [*range(30), *range(300, 330)])
    assert all(left[100 + i] > 0.8 for i in range(30)) and not any(200 <= i < 300 for i in left)


def test_only_lines_of_crowded_slots_are_counted_exactly(spark, monkeypatch):
    rows = [(i, None if i % 3 else "host", f"Common  line {i:02}\nonly{chr(97 + i % 26)}{chr(97 + i // 26)} here\n\nonly{chr(97 + i % 26)}{chr(97 + i // 26)} here") for i in range(60)]
    frame = spark.createDataFrame(rows + rows[:7], "doc_id long, source string, text string")
    lines = line_rules.line_table(frame, "text", "source", "doc_id")
    # Lines that cannot be frequent leave no row for the exact count; numbers are one line, nulls one host.
    assert lines.count() > 180 and {r["_words"] for r in line_rules.crowded(lines, 10).collect()} == {3}
    found = {r["_id"]: round(r["left"], 9) for r in line_rules.depletion(frame, max_texts=10).collect()}
    assert found == {i: round(4 / 7, 9) for i in range(60)}
    # Lines that share a slot are still told apart.
    monkeypatch.setattr(line_rules, "SLOTS", 2)
    assert found == {r["_id"]: round(r["left"], 9) for r in line_rules.depletion(frame, max_texts=10).collect()}


# -- Merkle trees -------------------------------------------------------------------------

def test_audit_finds_every_difference(spark):
    rows = [(v, 40_000 * i, f"record {v} {i}") for v in [*range(0, 700, 9), None] for i in range(25)]
    bad = {(9, 40_000), (63, 0), (693, 960_000)}
    other = [(v, s, p + "!" if (v, s) in bad else p) for v, s, p in rows if (v, s) not in {(18, 80_000)}] + [(800, 0, "new")]
    make = lambda r: merkle.entries(spark.createDataFrame(r, "volume long, start long, payload string").withColumn("hash", merkle.digest(F.col("payload"))))
    found, roots = merkle.audit(make(rows), make(other))
    assert {tuple(r) for r in found.collect()} == {(v, s, "changed") for v, s in bad} | {(18, 80_000, "missing"), (800, 0, "extra")}
    assert {r["volume"] for r in roots.where(~F.col("left_root").eqNullSafe(F.col("right_root"))).collect()} == {9, 18, 63, 693, 800}
    same, _ = merkle.audit(make(rows), make(rows + rows[:0]))
    assert same.count() == 0
    assert merkle.audit(make([]), make([]))[0].count() == 0


@needs_data
def test_audit_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{DATA}/pages.parquet'")
    assert sorted(map(tuple, queries.op7_merkle_fixity(spark, DATA).collect())) == sorted(con.sql(queries.OP7_SQL).fetchall())


# -- syncmers -------------------------------------------------------------------------------

def test_following_and_fingerprints(spark, docs):
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie"))
    found = syncmers.following(rows, "doc_id", "text", ["text"]).collect()
    order = sorted(rows.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["tie"]))
    wanted = [(r["doc_id"], r["text"], order[(i + 1) % len(order)]["text"]) for i, r in enumerate(order)]
    assert ordered((r["doc_id"], r["text"], r["next_text"]) for r in found) == ordered(wanted)
    sparse = spark.createDataFrame([(i * 1_000_003, str(i)) for i in range(50)], "doc_id long, text string")
    assert {(r["text"], r["next_text"]) for r in syncmers.following(sparse, "doc_id", "text", ["text"]).collect()} == {(str(i), str((i + 1) % 50)) for i in range(50)}


def test_syncmers_are_context_free(spark):
    rng = random.Random(13)
    middle = sentence(rng, 80)
    pairs = [(middle, sentence(rng, 7) + " " + middle + " " + sentence(rng, 9)), (middle, middle), ("", ""), ("", "one"), ("a b", "a b"), (middle, sentence(rng, 80))]
    frame = spark.createDataFrame(pairs, "a string, b string")
    marks = frame.select(syncmers.anchors(F.col("a")).alias("a"), syncmers.anchors(F.col("b")).alias("b"))
    rows = marks.select("a", "b", syncmers.likeness(F.col("a.hash"), F.col("b.hash")).alias("like"), syncmers.shift(F.col("a"), F.col("b")).alias("shift")).collect()
    held = {(x["place"] + 7, x["hash"]) for x in rows[0]["a"] if 0 <= x["place"] <= 80 - syncmers.WORDS}
    assert held <= {(x["place"], x["hash"]) for x in rows[0]["b"]} and rows[0]["shift"] == 7
    assert [r["like"] for r in rows[1:5]] == [1.0, 1.0, 0.0, 1.0] and rows[5]["like"] < 0.2 < rows[0]["like"]
    assert len(rows[0]["a"]) > 20


def test_every_text_with_a_word_has_an_anchor(spark):
    rng = random.Random(24)
    short = [sentence(rng, n) for n in range(1, 10) for _ in range(20)]
    chinese = "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(300))
    frame = spark.createDataFrame([(t, short[(i + 40) % len(short)]) for i, t in enumerate(short)] + [(chinese, chinese[:150] + "x" + chinese[150:]), ("a", "b")], "a string, b string")
    marks = frame.select("a", syncmers.anchors(F.col("a"))["hash"].alias("x"), syncmers.anchors(F.col("b"))["hash"].alias("y"))
    rows = marks.select("a", "x", syncmers.likeness(F.col("x"), F.col("y")).alias("like")).collect()
    assert all(r["x"] for r in rows)
    assert all(r["like"] < 1 for r in rows[:len(short)]) and rows[-2]["like"] > 0.9 and rows[-1]["like"] == 0
    assert len({tuple(r["x"]) for r in rows[:len(short)]}) == len({r["a"] for r in rows[:len(short)]})
    # An edit that takes a short text across the window's width, or a long word's, leaves what is common.
    five, mixed = sentence(rng, 5), sentence(rng, 6) + " " + "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(40))
    near = spark.createDataFrame([(five, five.rsplit(" ", 1)[0]), (mixed, mixed[:-15]), (chinese, "word " + chinese)], "a string, b string")
    likes = near.select(syncmers.likeness(syncmers.anchors(F.col("a"))["hash"], syncmers.anchors(F.col("b"))["hash"]).alias("x")).collect()
    assert all(r["x"] > 0 for r in likes) and likes[1]["x"] > 0.5 and likes[2]["x"] > 0.9


def plain_anchors(text, hashes):
    """Hashes of the anchors of words (none of them long), window by window, with the hash of each word given."""
    h = [2**31 - 1] * 4 + [min(hashes[w], 2**31 - 2) for w in text.split()] + [2**31 - 1] * 4
    return [tuple(h[i:i + 5]) for i in range(len(h) - 4) if min(h[i], h[i + 4]) <= min(h[i + 1:i + 4])] if text.split() else []


@needs_data
def test_syncmer_query_matches_plain_rows(spark):
    rows = sorted((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{DATA}/documents.parquet").collect())
    words = sorted({w for _, t in rows for w in t.split()})
    hashed = {r["w"]: r["h"] for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", F.hash("w").alias("h")).collect()}
    found = {r["doc_id"]: r for r in queries.op8_closed_syncmers(spark, DATA).collect()}
    for (doc_id, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        r, half = found[doc_id], len(text) // 2
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), brute.sha(text[:len(text) - half] + after[:half]))
        if max(map(len, (text + " " + after).split()), default=0) < syncmers.LONG_WORD and (text + after).isprintable():
            a, b = plain_anchors(text, hashed), plain_anchors(after, hashed)
            assert len(r["fingerprint"]) == 8 * len(a)
            assert r["near_next"] == pytest.approx(2 * len(set(a) & set(b)) / (len(set(a)) + len(set(b))) if a or b else 1.0)


# -- language ---------------------------------------------------------------------------------

@needs_data
def test_language_of_held_out_documents(spark, docs, empty):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    learned = language.learn(table)
    found = language.classify(table, learned, ["doc_id", "lang", "text"]).where(language.held_out())
    rows = found.where("length(text) >= 100").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.97
    odd = language.classify(docs, learned, ["text"]).collect()
    assert all((r["lang_pred"] == "und") == (not any(map(str.isalpha, r["text"] or ""))) for r in odd)
    assert all(0 <= r["score"] <= 1 and (r["lang_pred"] != "und" or r["rejected"]) for r in odd)
    assert {r["lang_pred"] for r in language.classify(docs, language.learn(empty), ["doc_id"]).collect()} == {"und"}


# -- mixing -------------------------------------------------------------------------------------

@pytest.mark.parametrize("shares", [{"a": 1}, {"a": 1, "b": 2, None: 7}, mixing.units({str(i): (i + 1) ** 2 for i in range(30)}), mixing.units({"x": 0, "y": 0})])
def test_schedule_stays_within_a_block(shares):
    slots, seen, period = mixing.schedule(shares), dict.fromkeys(shares, 0), sum(shares.values())
    for slot, name in enumerate(slots):
        assert all(abs(seen[n] * period - slot * s) < period for n, s in shares.items())
        assert seen[name] * period // shares[name] <= slot < -(-(seen[name] + 1) * period // shares[name])
        seen[name] += 1
    assert seen == shares


def test_mixing_keeps_every_document(spark, docs, empty):
    shares = mixing.units(mixing.sizes(docs), slots=50)
    mixed = mixing.mix(docs, shares, block_chars=300)
    assert mixed.columns == docs.columns and ordered(map(tuple, mixed.collect())) == ordered(map(tuple, docs.collect()))
    rows = docs.select("doc_id", "source", F.length("text").alias("chars"))
    placed = mixing.place(rows, shares, block_chars=300).collect()
    by_source = itertools.groupby(sorted(placed, key=lambda r: (repr(r["row"]["source"]), r["block"], r["turn"])), key=lambda r: r["row"]["source"])
    for _, group in by_source:
        before, slots = 0, []
        for r in group:
            assert r["release"] <= r["slot"] < r["deadline"]
            slots.append(r["slot"])
            before += r["row"]["chars"] or 0
        assert slots == sorted(slots)
    assert len({(r["slot"], r["row"]["source"]) for r in placed}) == len({r["slot"] for r in placed})
    assert mixing.mix(empty, mixing.units(mixing.sizes(empty))).count() == 0


# -- registered queries, value by value ---------------------------------------------------------

@pytest.fixture(scope="module")
def table_rows(spark):
    return sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect())


def columns_of(frame, *names):
    return ordered(tuple(r) for r in frame.select(*names).collect())


@needs_data
def test_secret_query_matches_plain_rows(spark, table_rows):
    wanted = []
    for doc_id, text in table_rows:
        found = brute.secrets(text)
        wanted.append((doc_id, *[sum(k == kind for _, _, k, _ in found) for kind in ("assign", "access", "hex")],
                       brute.sha(",".join(f"{k}:{a}:{b}" for a, _, k, b in found))))
    assert columns_of(queries.op1_secret_scan(spark, DATA), "doc_id", "n_assign", "n_access", "n_hex", "base_sha256") == ordered(wanted)


@needs_data
def test_repeat_query_matches_plain_rows(spark, table_rows):
    wanted = [(i, *r[:3], brute.sha(r[3])) for (i, _), r in zip(table_rows, brute.repeats([t for _, t in table_rows]))]
    assert columns_of(queries.op2_repeated_bytes(spark, DATA), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == ordered(wanted)


@needs_data
def test_join_query_matches_plain_rows(spark, table_rows):
    wanted = [(i, *r) for (i, _), r in zip(table_rows, brute.components(table_rows))]
    assert columns_of(queries.op3_ngram_join(spark, DATA), "doc_id", "n_shingles", "component_id") == ordered(wanted)


@needs_data
def test_token_query_matches_plain_rows(spark, table_rows):
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    wanted = []
    for doc_id, text in table_rows:
        ids = plain.encode_ordinary(text or "")
        wanted.append((doc_id, len(ids), brute.sha(array("I", ids).tobytes()), brute.sha((text or "").encode())))
    assert columns_of(queries.op4_byte_bpe(spark, DATA), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == ordered(wanted)


@needs_data
def test_quality_query_matches_plain_rows(spark, table_rows):
    counts = [(i, *brute.quality(t)) for i, t in table_rows]
    wanted = [(*c, c[1] < 20 or 100 * c[5] > 30 * c[1]) for c in counts]
    found = queries.op6_line_frequency(spark, DATA).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    assert columns_of(found, *found.columns[:-1]) == ordered(wanted)
    assert found.where("base_failed and kept").count() == 0


@needs_data
def test_line_query_matches_plain_rows(spark, table_rows):
    states, wanted = brute.line_states(table_rows, None, line_dedup.MIN_NEAR, line_dedup.allowed), []
    for doc_id, _ in table_rows:
        of = collections.Counter(s for _, s in states[doc_id])
        wanted.append((doc_id, len(states[doc_id]), of["exact"], of["near"], brute.sha(",".join(str(p) for p, s in states[doc_id] if s == "first"))))
    assert columns_of(queries.op5_segment_lines(spark, DATA), "doc_id", "n_lines", "n_exact", "n_near", "kept_sha256") == ordered(wanted)


# -- periodic runs --------------------------------------------------------------------------------

def test_runs_match_plain_search(spark, docs, empty):
    rng, texts = random.Random(31), []
    for _ in range(400):
        words = [rng.choice("abcde"[:rng.randrange(1, 6)]) for _ in range(rng.randrange(90))]
        for _ in range(rng.randrange(3)):
            turn, at = [rng.choice("abxyz") for _ in range(rng.randrange(1, 14))], rng.randrange(len(words) + 1)
            words[at:at] = [turn[i % len(turn)] for i in range(rng.randrange(5, 70))]
        texts.append(rng.choice([" ", "\n", "\t \r"]).join(words))
    texts.append(sentence(rng, 3000) + (" " + " ".join(f"w{i}" for i in range(700))) * 3 + " a" * 5000)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").union(docs.select("doc_id", "text"))
    found = periodic.find(rows, ["doc_id", "text"]).collect()
    assert len(found) == len(texts) + docs.count()
    for r in found:
        words = [w.decode() for w in (r["text"] or "").encode().split()]
        if len(words) < 1000:
            wanted = brute.runs(words)
            gone = {i for s, length, q in wanted for i in range(s + q, s + length)}
            assert [tuple(x) for x in r["runs"]] == wanted and r["n_words"] == len(words)
            assert r["collapsed"] == " ".join(w for i, w in enumerate(words) if i not in gone)
    long = next(r for r in found if (r["text"] or "").endswith(" a" * 5000))
    assert [(x["length"], x["period"]) for x in long["runs"]] == [(2100, 700), (5000, 1)] and len(long["collapsed"].split()) == 3701
    clashing = docs.selectExpr("text", "doc_id as runs", "key as n_words")
    assert periodic.find(clashing, ["runs", "n_words"], names=("n", "r", "c")).columns == ["runs", "n_words", "n", "r", "c"]
    assert periodic.find(empty, ["doc_id"]).count() == 0


@needs_data
def test_runs_query_matches_plain_rows(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    found = queries.op11_periodic_runs(spark, DATA).drop("n_words").collect()
    short = {r["doc_id"] for r in rows if len(r["text"] or "") < 6000}
    assert ordered(tuple(r) for r in found if r["doc_id"] in short) == ordered(brute.periodic(r["doc_id"], r["text"]) for r in rows if r["doc_id"] in short)
    assert len(found) == len(rows) and any(r["n_runs"] for r in found)


# -- hard negatives -------------------------------------------------------------------------------

def test_negatives_match_all_pairs(spark, monkeypatch):
    for name, size in (("BLOCK", 16), ("PART", 2), ("PAGE", 4), ("SLICE", 8), ("SEEDS", 12)):
        monkeypatch.setattr(negatives, name, size)
    rng = random.Random(37)
    rows = [(i, rng.randrange(4), [rng.randrange(-30, 31) for _ in range(6)]) for i in range(300)]
    rows += [(500 + i, i % 2, [9, 9, 9]) for i in range(40)] + [(600, 1, [9, 9, 9, 0])] * 2 + [(None, 0, [20] * 6), (None, 1, [21] * 6), (700, 3, []), (710, 3, [0] * 6)]
    schema = "vec_id long, label int, vector array<long>, block string, score int"
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], schema).repartition(3)
    found = negatives.mine(frame, F.col("vec_id") % 10 == 0)
    assert ordered(map(tuple, found.collect())) == ordered(brute.hard_negatives(rows, 10))
    assert negatives.mine(spark.createDataFrame([], schema), F.col("vec_id") % 10 == 0).count() == 0
    lonely = spark.createDataFrame([(0, 1, [1], "", 1), (1, 2, [1], "", 1)], schema)
    assert negatives.mine(lonely, F.col("vec_id") == 0).count() == 0


def test_usable_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0]), (None, [1.0]), (1, None), (1, [1.0, None]), (1, [nan]), (1, [-inf]), (1, []), (1, [2.0, -3.5])]
    frame = spark.createDataFrame(rows, "label int, e array<double>").select(negatives.usable(F.col("label"), F.col("e")).alias("ok"))
    assert [r["ok"] for r in frame.collect()] == [True, False, False, False, False, False, True, True]


def test_curve_keeps_neighbours():
    cells = np.array(list(itertools.product(range(8), repeat=3)))
    keys = [k.tobytes() for k in negatives.hilbert(cells, 3)]
    path = cells[sorted(range(len(keys)), key=keys.__getitem__)]
    assert len(set(keys)) == len(keys) and (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_bounds_hold():
    rng = np.random.default_rng(3)
    rows, asked = rng.integers(-50, 50, (40, 9)), rng.integers(-50, 50, (7, 9))
    low, high = negatives.bounds(asked, rows.min(0)[None], rows.max(0)[None])
    scores = asked @ rows.T
    assert (low[:, 0] <= scores.min(1)).all() and (high[:, 0] >= scores.max(1)).all()


@needs_data
def test_negatives_match_sql(spark):
    con = duckdb.connect()
    con.execute("create view embeddings as select * from '/root/testdata/sf0.01/embeddings.parquet'")
    assert sorted(map(tuple, queries.op12_hard_negatives(spark, "/root/testdata/sf0.01").collect())) == sorted(con.sql(queries.OP12_SQL).fetchall())


# -- packing --------------------------------------------------------------------------------------

def test_bin_completion_finds_the_fewest():
    rng = random.Random(41)
    for _ in range(400):
        capacity = rng.choice([10, 20, 50, 100])
        least = rng.choice([1, capacity // 6])
        sizes = collections.Counter(rng.randrange(max(1, least), capacity + 1) for _ in range(rng.randrange(11)))
        best, used = packing.complete(sizes, capacity), collections.Counter()
        for times, pattern in best:
            assert sum(pattern) <= capacity and times > 0
            used.update({n: times * pattern.count(n) for n in set(pattern)})
        assert used == sizes
        fewest = brute.fewest_bins(sizes.elements(), capacity)
        assert sum(t for t, _ in best) == fewest >= packing.lower_bound(sizes, capacity)


def test_many_pieces_are_packed_tightly():
    rng = random.Random(43)
    sizes = collections.Counter(min(1024, max(1, int(rng.lognormvariate(6, 1)))) for _ in range(20_000))
    best = packing.complete({n: 1000 * c for n, c in sizes.items()})
    assert sum(t for t, _ in best) <= 1.001 * packing.lower_bound({n: 1000 * c for n, c in sizes.items()}, 1024)


def check_places(rows, capacity=1024):
    spots = collections.defaultdict(list)
    for r in rows:
        spots[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in spots.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(spots)


def test_packing_keeps_every_token(spark, docs, empty):
    extra = [("<|endoftext|> 中文 text \U0001f600 ſ",), ("long " * 3000,), ("ab" * 1023,)] + [("same text of a few words",)] * 300
    rows = docs.select("text").union(spark.createDataFrame(extra, "text string")).repartition(5)
    found = packing.pack(rows, queries.piece_encoder, ["text"], with_ids=True).cache()
    tokenizer = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    wanted = []
    for (text,) in rows.collect():
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 if len(ids) > 1024 else len(ids)
        cuts = [c for c in range(first, len(ids) + 1, 1024)]
        cuts = ([0] if cuts[0] else []) + cuts
        wanted += [(text, i, a, b - a, zlib.crc32(array("I", ids[a:b]).tobytes())) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    got = found.collect()
    assert ordered((r["text"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == ordered(wanted)
    assert check_places(got) >= packing.lower_bound(collections.Counter(r["length"] for r in got), 1024)
    whole = packing.sequences(found).collect()
    assert sum(r["n_tokens"] for r in whole) == sum(r["length"] for r in got) and all(4 * r["n_tokens"] == len(r["ids"]) for r in whole)
    assert packing.pack(empty, queries.piece_encoder, ["doc_id"]).count() == 0
    clashing = packing.pack(docs.selectExpr("text", "doc_id as _pieces", "key as _rank_"), queries.piece_encoder, ["_pieces", "_rank_"])
    assert clashing.columns[:2] == ["_pieces", "_rank_"] and clashing.count() >= docs.count()


@needs_data
def test_packing_query(spark):
    rows = queries.op13_bin_completion(spark, DATA).collect()
    sizes = collections.Counter(r["length"] for r in rows)
    assert check_places(rows) <= packing.lower_bound(sizes, 1024) + 2
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


# -- pipeline --------------------------------------------------------------------------------------

def test_stages_on_awkward_rows(spark, docs, tmp_path):
    table = docs
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, table, str(tmp_path))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.dtypes == docs.dtypes
        out.write.parquet(f"{tmp_path}/{name}")
        table = spark.read.parquet(f"{tmp_path}/{name}")
    rows = table.collect()
    assert rows and all(r["round_trip"] and r["n_chars"] == len(r["text"]) and 4 * r["n_tokens"] == len(r["token_ids"]) for r in rows)


def test_tokens_carry_the_schedule(spark, tmp_path):
    """The rows of one table in two orders get the positions of the order that mixing wrote."""
    table = spark.createDataFrame([(i, f"text number {i} " * 9, "en", f"s{i % 4}", 9) for i in range(200)], "doc_id long, text string, lang string, source string, n_chars long")
    shares, seen = {f"s{i}": i + 1 for i in range(4)}, []
    for name, shuffled in (("mixed", mixing.mix(table.repartition(3), shares, block_chars=400)), ("turned", table.repartitionByRange(3, F.desc("doc_id")).sortWithinPartitions(F.desc("doc_id")))):
        shuffled.write.parquet(f"{tmp_path}/{name}")
        rows = corpus_pipeline.encode_tokens(spark, spark.read.parquet(f"{tmp_path}/{name}"), "").collect()
        assert sorted(r["position"] for r in rows) == list(range(200))
        seen.append([r["doc_id"] for r in sorted(rows, key=lambda r: r["position"])])
    slots = mixing.place(table.withColumn("chars", F.length("text")), shares, block_chars=400).orderBy("slot", "turn", "row.doc_id").select("row.doc_id")
    assert seen[0] == [r["doc_id"] for r in slots.collect()]
    assert seen[1] == list(range(199, -1, -1))


def test_pipeline_on_an_empty_table(spark, empty, tmp_path):
    empty.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path))
    assert rows.count() == 0 and {"token_ids", "n_tokens", "round_trip"} <= set(rows.columns)


@needs_data
def test_pipeline_against_plain_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    judged = language.classify(docs, language.learn(docs), ["doc_id", "text"]).where("not rejected").collect()
    texts = sorted((r["doc_id"], r["text"]) for r in judged)
    states, left = brute.line_states(texts, None, line_dedup.MIN_NEAR, line_dedup.allowed), []
    for doc_id, text in texts:
        gone, lines = {p for p, s in states[doc_id] if s != "first"}, text.split("\n")
        if len(gone) < len(states[doc_id]):
            left.append((doc_id, "\n".join(x for p, x in enumerate(lines) if p not in gone)))
    firsts = {c for n, c in brute.components(left, corpus_pipeline.NEAR_WORDS, corpus_pipeline.NEAR_PERCENT) if n}
    wanted = {(i, t) for (i, t) in left if i in firsts}
    rows = corpus_pipeline.run(spark, DATA).collect()
    assert {(r["doc_id"], r["text"]) for r in rows} == wanted and len(rows) == len(wanted)


@needs_data
@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n != "pipeline"])
def test_queries_run_over_whole_tables(spark, name):
    rows = queries.QUERIES[name](spark, DATA)
    table = {"op7": "pages", "op12": "embeddings", "op13": "pieces"}.get(name.split("_")[0], "documents")
    if table == "documents":
        assert rows.count() == spark.read.parquet(f"{DATA}/{table}.parquet").count()
    else:
        assert rows.count() > 0
