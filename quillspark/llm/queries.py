"""The registered queries of the subpackage and their DuckDB statements."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quillspark.llm import bpe, language, line_dedup, line_rules, merkle, mixing, negatives, ngram_join, packing, periodic, repeats, secrets, syncmers
from quillspark.functions.text import bind
from quillspark.plans.lineage import cut


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secrets.scan(docs, secrets.learn(docs), ["doc_id"])
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = secrets.listed(F.filter("found", lambda s: s["kind"] != "markov"))
    return found.select("doc_id", *map(count, secrets.KINDS[:3]), F.sha2(base, 256).alias("base_sha256"), secrets.listed(F.col("found")).alias("spans"), count("markov"))


def op2_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.join(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = bpe.serialise_model(bpe.load_ranks(public_tokenizers.path(corpus_pipeline.VOCABULARY)))
    coded = bpe.encode(table(spark, sf_dir, "documents"), model, public_tokenizers.PATTERN, ["doc_id"])
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_segment_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = line_dedup.verdicts(docs).select(F.col("doc_id").alias("_id"), "text_hash", "lines")
    rows = docs.select("doc_id", F.xxhash64("text").alias("_hash")).join(
        found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("text_hash")), "left")
    of = lambda state: F.filter("lines", lambda x: x["state"] == state)
    count = lambda state: F.coalesce(F.size(of(state)), F.lit(0)).cast("long")
    kept = F.array_join(F.transform(of("first"), lambda x: x["place"].cast("string")), ",")
    return rows.select("doc_id", F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"), count("exact").alias("n_exact"),
                       count("near").alias("n_near"), F.sha2(F.coalesce(kept, F.lit("")), 256).alias("kept_sha256"))


def op6_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    counts = line_rules.measure(docs.select("doc_id", "source", "text", F.xxhash64("text").alias("text_hash")), ["doc_id", "source", "text_hash"])
    lost = line_rules.depletion(docs)
    joined = counts.join(lost, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_host"))
                         & (F.col("text_hash") == F.col("_text")), "left")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return joined.select("doc_id", *line_rules.COUNTS, failed.alias("base_failed"),
                         (~failed & (F.coalesce("left", F.lit(1.0)) >= line_rules.MIN_LEFT)).alias("kept"))


def op8_closed_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    marked = docs.withColumn("marks", syncmers.anchors(F.col("text"))["hash"])
    both = syncmers.following(marked, "doc_id", "text", ["text", "marks"])
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half))
    both = both.select("doc_id", F.length("text").cast("long").alias("n_chars"), "marks", "next_marks", edited.alias("edited"))
    both = both.withColumn("edited_marks", syncmers.anchors(F.col("edited"))["hash"])
    return both.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), syncmers.fingerprint(F.col("marks")).alias("fingerprint"),
                       syncmers.fingerprint(F.col("edited_marks")).alias("edited_fingerprint"),
                       syncmers.likeness(F.col("marks"), F.col("edited_marks")).alias("near_edited"),
                       syncmers.likeness(F.col("marks"), F.col("next_marks")).alias("near_next"))


def op9_compression_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    judged = language.classify(docs, language.learn(docs), ["doc_id"])
    return judged.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op7_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volumes of 256 pages against a replica in which Spark changed some records and lost others."""
    pages = table(spark, sf_dir, "pages")
    lot = F.pmod("page_id", F.lit(997))
    body = F.coalesce("html", F.lit(""))
    good, bad = merkle.record(F.col("url"), body), merkle.record(F.col("url"), F.concat(body, F.lit(" ")))
    hashed = pages.select("page_id", F.floor(F.col("page_id") / 256).alias("volume"), F.octet_length(good).alias("size"), merkle.digest(good).alias("left_digest"),
                          F.when(lot == 5, merkle.digest(bad)).otherwise(merkle.digest(good)).alias("right_digest"), (lot != 6).alias("kept"))
    placed = cut(merkle.offsets(hashed, "volume", ["page_id", "left_digest"], "size"))
    found, roots = merkle.audit(merkle.entries(placed, hashed="left_digest"), merkle.entries(placed.where(F.coalesce("kept", F.lit(True))), hashed="right_digest"))
    listed = found.groupBy("volume").agg(
        F.sum((F.col("state") == "changed").cast("long")).alias("n_changed"), F.sum((F.col("state") == "missing").cast("long")).alias("n_missing"),
        F.array_join(F.transform(F.sort_array(F.collect_list("start")), lambda x: x.cast("string")), ",").alias("damaged"))
    return roots.join(listed, ["volume"], "left").select(
        "volume", "left_root", "right_root", F.col("left_root").eqNullSafe(F.col("right_root")).alias("intact"),
        F.coalesce("n_changed", F.lit(0)).alias("n_changed"), F.coalesce("n_missing", F.lit(0)).alias("n_missing"), F.coalesce("damaged", F.lit("")).alias("damaged"))


OP7_SQL = """
with good as (select page_id, page_id // 256 as volume, coalesce(html, '') as body, coalesce(url, '') as url from pages),
rec as (select page_id, volume, 'WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: ' || url || '\r\nContent-Length: ' as head, body from good),
full_rec as (select page_id, volume, replace(head, '\r\n', chr(13) || chr(10)) || strlen(body) || repeat(chr(13) || chr(10), 2) || body || repeat(chr(13) || chr(10), 2) as a,
  replace(head, '\r\n', chr(13) || chr(10)) || (strlen(body) + 1) || repeat(chr(13) || chr(10), 2) || body || ' ' || repeat(chr(13) || chr(10), 2) as b from rec),
placed as (select page_id, volume, sha256(a) as a, case when page_id % 997 = 5 then sha256(b) else sha256(a) end as b,
  coalesce(sum(strlen(a)) over (partition by volume order by page_id rows between unbounded preceding and 1 preceding), 0)::bigint as start from full_rec),
both_sides as (select 'l' as side, volume, start as place, a || 'x1' as hash from placed
  union all select 'r', volume, start, b || 'x1' from placed where page_id % 997 <> 6),
h0 as (select side, volume, place // 65536 as place, sha256(string_agg(volume || ':' || place || ':' || hash, ',' order by place)) as hash from both_sides group by 1, 2, 3),
h1 as (select side, volume, place // 16 as place, sha256(string_agg(volume || ':' || place || ':' || hash, ',' order by place)) as hash from h0 group by 1, 2, 3),
h2 as (select side, volume, place // 16 as place, sha256(string_agg(volume || ':' || place || ':' || hash, ',' order by place)) as hash from h1 group by 1, 2, 3),
h3 as (select side, volume, sha256(string_agg(volume || ':' || place || ':' || hash, ',' order by place)) as hash from h2 group by 1, 2),
roots as (select volume, max(hash) filter (side = 'l') as left_root, max(hash) filter (side = 'r') as right_root from h3 group by 1),
bad as (select volume, count(*) filter (page_id % 997 = 5) as n_changed, count(*) filter (page_id % 997 = 6) as n_missing,
  string_agg(start::varchar, ',' order by start) as damaged from placed where page_id % 997 in (5, 6) group by 1)
select volume, left_root, right_root, left_root is not distinct from right_root as intact, coalesce(n_changed, 0) as n_changed,
  coalesce(n_missing, 0) as n_missing, coalesce(damaged, '') as damaged from roots left join bad using (volume)
"""


def op10_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.length("text").alias("chars"), "text")
    shares = mixing.tempered_units(mixing.sizes(docs))
    placed = mixing.place(docs.select("doc_id", "source", "chars"), shares)
    return placed.select("row.doc_id", "row.source", "block", "release", "deadline", "slot", "turn")


def cycled(text: Column, doc_id: Column) -> Column:
    """The text of every tenth document by hash with its tail made periodic; a null id has hash 0 and no such tail."""
    lot = F.crc32(doc_id.cast("string"))
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))

    def turned(s: Column) -> Column:
        w, n, g = s["w"], F.size(s["w"]), s["g"]
        begin = F.pmod(g, n).cast("int")
        period = (1 + F.floor((n - begin) / (3 + F.pmod(g, F.lit(8))))).cast("int")
        made = bind(F.struct(begin.alias("a"), period.alias("p")), lambda b: F.transform(
            w, lambda x, i: F.when(i < b["a"], x).otherwise(F.get(w, b["a"] + F.pmod(i - b["a"], b["p"])))))
        return F.when(n > 0, F.array_join(made, " ")).otherwise("")

    tenth = doc_id.isNotNull() & (F.pmod(lot, F.lit(10)) == 0)
    return F.when(tenth, bind(F.struct(words.alias("w"), F.floor(lot / 10).alias("g")), turned)).otherwise(text)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", cycled(F.coalesce("text", F.lit("")), F.col("doc_id")).alias("text"))
    found = periodic.find(docs, ["doc_id"])
    more = lambda a, b: a["length"] * b["period"] - b["length"] * a["period"]
    best = F.get(F.array_sort("runs", lambda a, b: F.when(more(a, b) != 0, -F.sign(more(a, b))).when(a["start"] != b["start"], F.sign(a["start"] - b["start"]))
                              .otherwise(F.sign(a["period"] - b["period"])).cast("int")), 0)
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    found = found.withColumns({"best": best, "listed": F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise("")})
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), *[F.col(f"best.{n}").alias(n) for n in ("start", "length", "period")],
                        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
                        F.sha2("listed", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").where(negatives.usable(F.col("label"), F.col("embedding")))
    label = F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    rows = rows.select("vec_id", label.alias("label"), F.transform("embedding", lambda x: F.floor(256 * x.cast("double")).cast("long")).alias("vector"))
    return negatives.mine(rows, F.col("vec_id") % 100 == 0)


OP12_SQL = """
with kept as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
  list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings where label is not null and embedding is not null
  and not list_bool_or(list_transform(embedding, lambda x: x is null or isnan(x) or isinf(x)))),
anchors as (select * from kept where vec_id % 100 = 0),
scores as (select a.vec_id as anchor_id, b.vec_id as id, a.label = b.label as same, list_inner_product(a.v, b.v)::bigint as score
  from anchors a join kept b on a.vec_id <> b.vec_id),
pos as (select anchor_id, id as positive_id, score as positive_score from scores where same
  qualify row_number() over (partition by anchor_id order by score desc, id) <= 5)
select p.anchor_id, p.positive_id, row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.id)::int as rank,
  s.id as negative_id, p.positive_score, s.score as negative_score
from pos p join scores s on s.anchor_id = p.anchor_id and not s.same and 100 * s.score between 80 * p.positive_score and 100 * p.positive_score
qualify rank <= 5
"""


def piece_encoder():
    """The encoder of the packed vocabulary, made in each task."""
    return packing.encoder(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op13_bin_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = packing.pack(table(spark, sf_dir, "documents"), piece_encoder, ["doc_id"])
    return placed.select("doc_id", F.col("piece").cast("int").alias("piece"), "start", "length", "ids_crc32", "sequence_id", "offset")


QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_repeated_bytes": op2_repeated_bytes,
    "op3_ngram_join": op3_ngram_join,
    "op4_byte_bpe": op4_byte_bpe,
    "op6_line_frequency": op6_line_frequency,
    "op5_segment_lines": op5_segment_lines,
    "op7_merkle_fixity": op7_merkle_fixity,
    "op8_closed_syncmers": op8_closed_syncmers,
    "op9_compression_language": op9_compression_language,
    "op10_pfair_mix": op10_pfair_mix,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_bin_completion": op13_bin_completion,
    "pipeline": corpus_pipeline.run,
}
ORACLES = {"op7_merkle_fixity": OP7_SQL, "op12_hard_negatives": OP12_SQL} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
