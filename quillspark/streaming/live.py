"""Streaming forms of the running learner and usage state.

Event time and UTC days replace the request clock. Rows later than the
watermark are dropped, which is the one difference to the batch operators.
"""

from __future__ import annotations

import datetime as dt
from bisect import insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillspark.functions import labels as lb
from quillspark.operators import chunking, lexical, sections
from quillspark.operators.usage import FREE_LIMITS

DAY = "1 day"


def live_daily_experience(actions: DataFrame, lateness: str = DAY) -> DataFrame:
    """Points per user and UTC day; partial sums combine before the shuffle."""
    gained = lb.xp_gained(F.col("action"), F.col("correct"))
    windows = actions.withWatermark("ts", lateness).groupBy(F.window("ts", DAY).alias("w"), "user_id")
    return windows.agg(F.sum(gained).alias("daily_xp")).select("user_id", F.to_date("w.start").alias("day"), "daily_xp")


def live_usage(calls: DataFrame, lateness: str = DAY) -> DataFrame:
    """Tokens and cost per user, provider and UTC day."""
    windows = calls.withWatermark("ts", lateness).groupBy(F.window("ts", DAY).alias("w"), "user_id", "provider")
    return windows.agg(F.sum("total_tokens").alias("total_tokens"), F.sum("cost_usd").alias("cost_usd")).select(
        "user_id", "provider", F.to_date("w.start").alias("day"), "total_tokens", "cost_usd")


DECISIONS = "user_id bigint, limit_type string, day date, event_id bigint, decision string"


def _decide(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Count the admitted requests of one (user, type, day); the state is one number."""
    user, kind, day = key
    if state.hasTimedOut:
        state.remove()
        return
    used = state.get[0] if state.exists else 0
    limit = FREE_LIMITS.get(kind)
    # The earliest requests that still fit, the latest of them on top; a batch at a time.
    room, first, out = (limit or 0) - used, [], []
    for batch in batches:
        for tier, ts, event in zip(batch["tier"], batch["ts"], batch["event_id"]):
            if limit is None or (tier or "free").strip().lower() != "free":
                out.append((event, "uncounted"))
                continue
            insort(first, (ts, event))
            if len(first) > max(room, 0):
                out.append((first.pop()[1], "denied"))
    used += len(first)
    out += [(event, "allowed") for _, event in first]
    state.update((used,))
    end = dt.datetime.combine(day, dt.time(), dt.timezone.utc) + dt.timedelta(days=1)
    state.setTimeoutTimestamp(max(int(end.timestamp() * 1000), state.getCurrentWatermarkMs() + 1))
    if out:
        yield pd.DataFrame({"user_id": user, "limit_type": kind, "day": day,
                            "event_id": [e for e, _ in out], "decision": [d for _, d in out]})


def live_quota(requests: DataFrame, lateness: str = DAY) -> DataFrame:
    """Admit or deny requests as they arrive; the state of a day expires with it.

    A request is decided in the order of its trigger, so a late one can find
    the day's quota used where the batch operator would have admitted it.
    """
    keyed = requests.withWatermark("ts", lateness).withColumns({
        "limit_type": F.lower(F.trim("limit_type")), "day": F.to_date("ts")})
    return keyed.groupBy("user_id", "limit_type", "day").applyInPandasWithState(
        _decide, DECISIONS, "used int", "append", GroupStateTimeout.EventTimeTimeout)


TOPIC_STATE = "correct bigint, total bigint, history array<struct<ts: timestamp, event_id: bigint, ok: boolean>>"
TOPIC_ROWS = "user_id bigint, subject string, topic string, correct bigint, total bigint, direction string, improvement double"


def trend_of(history: list[bool]) -> tuple[str, float]:
    if len(history) < 4:
        return "stable", 0.0
    mid = len(history) // 2
    change = sum(history[mid:]) / (len(history) - mid) - sum(history[:mid]) / mid
    return ("improving" if change > 0.1 else "declining" if change < -0.1 else "stable"), round(change, 2)


def _topic(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Counters and the last fifty answers of one (user, subject, topic)."""
    correct, total, history = state.get if state.exists else (0, 0, [])
    # A late answer takes its place in time, whichever trigger brings it.
    recent = [(h["ts"], h["event_id"], h["ok"]) for h in history]
    for batch in batches:
        correct += int(batch["is_correct"].sum())
        total += len(batch)
        recent = sorted([*recent, *zip(batch["ts"].dt.to_pydatetime() if len(batch) else [], map(int, batch["event_id"]), map(bool, batch["is_correct"]))])[-50:]
    state.update((correct, total, recent))
    history = [ok for _, _, ok in recent]
    direction, change = trend_of(history)
    yield pd.DataFrame([(*key, correct, total, direction, change)], columns=[
        "user_id", "subject", "topic", "correct", "total", "direction", "improvement"])


def live_topics(answers: DataFrame) -> DataFrame:
    """Running accuracy and trend of every topic touched by a trigger."""
    return answers.groupBy("user_id", "subject", "topic").applyInPandasWithState(
        _topic, TOPIC_ROWS, TOPIC_STATE, "update", GroupStateTimeout.NoTimeout)


def ingest(incoming: DataFrame, out_dir: str, checkpoint: str, lateness: str = DAY):
    """Queued documents to chunks and postings, one status row per finished stage.

    Equal files within the watermark are taken once. Every batch writes under
    its own id, so a retried batch replaces what it wrote before.
    """
    fresh = incoming.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["file_hash"])

    def store(batch: DataFrame, batch_id: int) -> None:
        docs = batch.select("doc_id", "content", F.expr("cast(null as array<string>)").alias("pages"))
        kept = chunking.chunk_sections(sections.normalize(docs)).where("kept")
        chunk_dir, index_dir = f"{out_dir}/chunks/batch={batch_id}", f"{out_dir}/postings/batch={batch_id}"
        kept.write.mode("overwrite").parquet(chunk_dir)
        stored = batch.sparkSession.read.parquet(chunk_dir)
        lexical.postings(stored.select(F.col("doc_id").alias("scope"), "chunk_id", "text")).write.mode("overwrite").parquet(index_dir)
        done = stored.groupBy("doc_id").agg(F.count("*").alias("chunks")).withColumn("stage", F.lit("indexed"))
        empty = batch.join(done, "doc_id", "left_anti").select("doc_id", F.lit(0).cast("bigint").alias("chunks"), F.lit("parsed").alias("stage"))
        done.unionByName(empty).write.mode("overwrite").parquet(f"{out_dir}/status/batch={batch_id}")

    return fresh.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
