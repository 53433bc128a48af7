import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from quillspark import schemas
from quillspark.operators import learning, lexical, usage
from quillspark.sources import readers, sinks
from quillspark.streaming import live

EVENTS = "/root/testdata/sf0.001/events.parquet"


@pytest.fixture(scope="module")
def log(spark):
    k = F.get_json_object("props", "$.k").cast("int")
    return spark.read.parquet(EVENTS).withColumn("ts", F.col("ts").cast("timestamp")).withColumn("k", k)


def stream_of(spark, df, schema, path, parts=3):
    """The table as files in time order, one file a trigger."""
    span = df.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    step = (span.b - span.a) / parts
    for i in range(parts):
        low, high = span.a + step * i, span.a + step * (i + 1)
        inside = (F.col("ts") >= low) & ((F.col("ts") < high) if i < parts - 1 else F.lit(True))
        df.where(inside).coalesce(1).write.mode("append").json(str(path))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(path))


def drain(df, name, mode, path):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(path)).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return df.sparkSession.table(name)


def test_daily_experience_equals_batch(spark, log, tmp_path):
    name = F.when(F.col("event_type") == "view", "ask").otherwise("quiz_complete")
    acts = log.select("user_id", name.alias("action"), (F.col("k") % 6).alias("correct"), "ts", "event_id")
    live_rows = drain(live.live_daily_experience(stream_of(spark, acts, schemas.ACTIONS, tmp_path / "in")), "live_xp", "complete", tmp_path / "cp")
    assert sorted(live_rows.collect()) == sorted(learning.daily_experience(acts).select("user_id", "day", "daily_xp").collect())


def test_usage_equals_batch(spark, log, tmp_path):
    calls = log.select(F.col("user_id").cast("string").alias("user_id"), (F.col("k") % 3).cast("string").alias("provider"),
                       F.col("k").cast("bigint").alias("total_tokens"), F.lit(0.5).alias("cost_usd"), "ts")
    rows = drain(live.live_usage(stream_of(spark, calls, schemas.MODEL_CALLS, tmp_path / "in")), "live_usage", "complete", tmp_path / "cp")
    batch = calls.groupBy("user_id", "provider", F.to_date("ts").alias("day")).agg(F.sum("total_tokens").alias("t"), F.sum("cost_usd").alias("c"))
    assert sorted(rows.collect()) == sorted(batch.collect())


def test_quota_equals_batch(spark, log, tmp_path):
    kind = F.when(F.col("event_type") == "view", "rag").when(F.col("event_type") == "error", "other").otherwise("quiz")
    reqs = log.select(F.col("user_id") % 3, F.when(F.col("user_id") % 2 == 0, "premium").otherwise("free").alias("tier"), kind.alias("limit_type"),
                      "ts", "event_id").toDF("user_id", "tier", "limit_type", "ts", "event_id")
    rows = drain(live.live_quota(stream_of(spark, reqs, schemas.QUOTA_REQUESTS, tmp_path / "in")), "live_quota", "append", tmp_path / "cp")
    batch = usage.quota_decisions(reqs, ["ts", "event_id"])
    assert sorted((r.event_id, r.decision) for r in rows.collect()) == sorted((r.event_id, r.decision) for r in batch.collect())


def test_late_answers_take_their_place_in_time(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    first = [(1, "s", "t", i >= 30, start + dt.timedelta(minutes=i + 10), i) for i in range(60)]
    late = [(1, "s", "t", True, start + dt.timedelta(minutes=i), 100 + i) for i in range(8)]
    answers = spark.createDataFrame(first + late, "user_id bigint, subject string, topic string, is_correct boolean, ts timestamp, event_id bigint")
    for part in (answers.where("event_id < 100"), answers.where("event_id >= 100")):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(answers.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    rows = drain(live.live_topics(stream), "late_topics", "update", tmp_path / "cp").collect()
    found = max(rows, key=lambda r: r.total)
    wanted = learning.all_topics(answers, ["ts", "event_id"]).first()
    assert (found.correct, found.total, found.direction, round(found.improvement, 2)) == (wanted.correct, wanted.total, wanted.direction, wanted.improvement)


def test_topics_equal_batch(spark, log, tmp_path):
    answers = log.select(F.col("user_id") % 4, F.lit("s"), (F.col("k") % 2).cast("string"), F.col("k") % 3 > 0, "ts", "event_id").toDF(
        "user_id", "subject", "topic", "is_correct", "ts", "event_id")
    rows = drain(live.live_topics(stream_of(spark, answers, schemas.ANSWER_LOG, tmp_path / "in")), "live_topics", "update", tmp_path / "cp")
    last = {}
    for r in rows.collect():
        key = (r.user_id, r.topic)
        if key not in last or r.total > last[key][1]:
            last[key] = (r.correct, r.total, r.direction, round(r.improvement, 2))
    batch = learning.all_topics(answers, ["ts", "event_id"]).collect()
    assert last == {(r.user_id, r.topic): (r.correct, r.total, r.direction, r.improvement) for r in batch}


def test_ingest_skips_equal_files(spark, tmp_path):
    text = "# Title\n" + "word here is long. " * 40
    rows = [("d1", "h1", text, "2024-01-01 00:00:00"), ("d2", "h1", text, "2024-01-01 00:01:00"), ("d3", "h3", " ", "2024-01-01 00:02:00")]
    spark.createDataFrame(rows, "doc_id string, file_hash string, content string, ts string").withColumn(
        "ts", F.to_timestamp("ts")).coalesce(1).write.json(str(tmp_path / "in"))
    incoming = spark.readStream.schema(schemas.INCOMING).json(str(tmp_path / "in"))
    q = live.ingest(incoming, str(tmp_path / "out"), str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    status = {r.doc_id: (r.stage, r.chunks) for r in spark.read.parquet(str(tmp_path / "out" / "status")).collect()}
    assert len(status) == 2 and status["d3"][0] == "parsed"
    assert {v[0] for v in status.values()} == {"parsed", "indexed"}


def test_stored_index_answers_like_the_direct_search(spark, tmp_path):
    chunks = spark.createDataFrame([("a", 1, "red fox"), ("a", 2, "red wine red"), ("b", 1, "blue fox den")], "scope string, chunk_id int, text string")
    asked = spark.createDataFrame([(1, "red fox"), (2, "wine")], "query_id int, query string")
    sinks.write_keyword_index(chunks, str(tmp_path / "ix"))
    stored = sinks.search_index(asked, readers.keyword_index(spark, str(tmp_path / "ix")), 5)
    pick = lambda df: sorted((r.query_id, r.scope, r.chunk_id, r.rank, round(r.score, 9)) for r in df.collect())
    assert pick(stored) == pick(lexical.bm25_top(asked, chunks, 5))


def test_document_tables_replace_and_purge(spark, tmp_path):
    one, two, three = (str(tmp_path / n) for n in ("one", "two", "three"))
    base = spark.createDataFrame([(f"d{i}", f"v{i}") for i in range(20)], "doc_id string, text string")
    sinks.write_documents(base, one, 4)
    sinks.upsert_documents(spark.createDataFrame([("d3", "new", 1)], "doc_id string, text string, page int"), spark.read.parquet(one), two, 4)
    table = spark.read.parquet(two)
    assert table.count() == 20 and table.where("doc_id = 'd3'").first().text == "new"
    sinks.purge_documents(table, spark.createDataFrame([("d3",)], "doc_id string"), three, 4)
    wanted = spark.createDataFrame([("d3",), ("d4",)], "doc_id string")
    assert [r.doc_id for r in readers.document_rows(spark, three, wanted, 4).collect()] == ["d4"]


def test_uploads_dataset_and_reports(spark, tmp_path):
    (tmp_path / "up").mkdir()
    (tmp_path / "up" / "a.pdf").write_bytes(b"x")
    (tmp_path / "up" / "b.txt").write_bytes(b"y")
    good, bad = readers.uploads(spark, str(tmp_path / "up"))
    assert good.count() == 1 and bad.first().reason == "Invalid type: .txt"
    (tmp_path / "d.json").write_text(json.dumps([{"question": "q1", "expected_answer": "e", "relevant_chunks": [], "type": "factual"},
                                                 {"id": "x", "query": "q2", "key_terms": ["k"], "type": "adversarial"}], indent=1))
    assert {r.query for r in readers.eval_dataset(spark, str(tmp_path / "d.json")).collect()} == {"q1", "q2"}
    path = str(tmp_path / "reports")
    for i in (1, 2):
        sinks.append_report(spark.createDataFrame([("d", i, i / 10)], "doc_id string, ts int, recall double"), path)
    assert readers.latest_report(spark, path).first().ts == 2
    sinks.export_report(spark.read.parquet(path), str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 2
