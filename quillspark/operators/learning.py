"""Learner analytics over answer and activity logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillspark.functions import labels as lb, text as tx
from quillspark.operators.ordered import top_k

TOPIC = ["user_id", "subject", "topic"]
HISTORY = 50

# Wording of the adaptive query.
FOCUS_HEAD = "Generate quiz questions focusing on these weak areas: "
FOCUS_TAIL = ". Also include general topics."


def grade(attempts: DataFrame) -> DataFrame:
    """Each question of each attempt against the given answer.

    ``attempts(attempt_id, questions, answers)``; unanswered questions count in
    the total but are not graded rows. Stays inside the row.
    """
    n = F.least(F.size("questions"), F.size("answers"))
    zipped = F.arrays_zip(F.slice("questions", 1, n).alias("q"), F.slice("answers", 1, n).alias("a"))
    rows = attempts.select("*", F.size("questions").alias("_total"), F.posexplode_outer(zipped).alias("ordinal", "_z"))
    key = F.upper(tx.strip(F.coalesce("_z.q.correct_answer", F.lit(""))))
    given = F.upper(tx.strip(F.coalesce("_z.a", F.lit(""))))

    def option_text(letter: Column) -> Column:
        place = F.position(letter, F.lit("ABCD"))
        inside = (F.length(letter) == 1) & (place >= 1)
        return F.when(inside, F.coalesce(tx.strip(F.get(F.col("_z.q.options"), place - 1)), F.lit(""))).otherwise("")

    return rows.withColumns({
        "question_id": F.concat(F.lit("q"), F.col("ordinal").cast("string")),
        "given_letter": given, "key_letter": key, "given_text": option_text(given), "key_text": option_text(key),
        "is_correct": (key != "") & (given == key) & F.col("_z").isNotNull(),
        "topic": F.coalesce(F.nullif(tx.strip("_z.q.topic"), F.lit("")), F.lit("General")),
        "question": F.col("_z.q.question"), "total": F.col("_total"),
    }).drop("questions", "answers", "_z", "_total")


def attempt_scores(graded: DataFrame, keys: list[str]) -> DataFrame:
    correct = F.sum(F.col("is_correct").cast("int"))
    return graded.groupBy(*keys).agg(
        correct.alias("correct"), F.max("total").alias("total"),
        F.round(correct / F.greatest(F.max("total"), F.lit(1)), 2).alias("accuracy"))


def topic_scores(answers: DataFrame) -> DataFrame:
    """``correct, total`` per user, subject and topic."""
    return answers.groupBy(*TOPIC).agg(
        F.sum(F.col("is_correct").cast("int")).alias("correct"), F.count("*").alias("total"))


def topic_trends(answers: DataFrame, order: list[str]) -> DataFrame:
    """Second-half minus first-half accuracy of the last fifty answers of a topic."""
    recent = top_k(answers, TOPIC, [F.desc(c) for c in order], HISTORY, "_r")
    n = F.count("*").over(Window.partitionBy(*TOPIC))
    placed = recent.withColumn("_n", n).withColumn("_early", F.col("_n") - F.col("_r") < F.floor(F.col("_n") / 2))
    hit = F.col("is_correct").cast("int")

    def share(early: bool) -> Column:
        part = F.col("_early") if early else ~F.col("_early")
        return F.sum(F.when(part, hit)) / F.sum(F.when(part, 1))

    grouped = placed.groupBy(*TOPIC).agg(F.max("_n").alias("_n"), (share(False) - share(True)).alias("_d"))
    change = F.when(F.col("_n") >= 4, F.col("_d")).otherwise(0.0)
    return grouped.select(
        *TOPIC,
        F.when(change > 0.1, "improving").when(change < -0.1, "declining").otherwise("stable").alias("direction"),
        F.round(change, 2).alias("improvement"))


def all_topics(answers: DataFrame, order: list[str]) -> DataFrame:
    """Accuracy, status and trend of every topic."""
    scored = topic_scores(answers).join(topic_trends(answers, order), TOPIC)
    accuracy = F.col("correct") / F.col("total")
    return scored.withColumn("raw_accuracy", accuracy).withColumns({
        "accuracy": F.round("raw_accuracy", 2), "status": lb.mastery(F.col("raw_accuracy"))})


def weak_topics(topics: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Topics below ``threshold`` with at least two answers, and what to do about them."""
    weak = topics.where((F.col("total") >= 2) & (F.col("raw_accuracy") < threshold))
    return weak.withColumn("recommendation", lb.recommendation(F.col("topic"), F.col("raw_accuracy"), F.col("direction")))


def study_plan(weak: DataFrame) -> DataFrame:
    """Weakest topic first, with sessions and advice."""
    w = Window.partitionBy("user_id").orderBy("accuracy", "subject", "topic")
    advice = lb.advice(F.col("topic"), F.col("accuracy"), F.col("direction"))
    return weak.withColumns({
        "plan_order": F.row_number().over(w), "sessions": lb.sessions_needed(F.col("accuracy")), **advice})


def quiz_focus(weak: DataFrame, limit: int = 3) -> DataFrame:
    """The weakest topics of each user joined into an adaptive query."""
    first = top_k(weak, ["user_id"], [F.asc("accuracy"), F.asc("subject"), F.asc("topic")], limit, "_r")
    names = F.array_sort(F.collect_list(F.struct("_r", "topic")))
    joined = F.array_join(F.transform(names, lambda x: x["topic"]), ", ")
    return first.groupBy("user_id").agg(joined.alias("weak_topics")).select(
        "user_id", "weak_topics", F.concat(F.lit(FOCUS_HEAD), F.col("weak_topics"), F.lit(FOCUS_TAIL)).alias("focus_query"))


def subject_summary(topics: DataFrame) -> DataFrame:
    return topics.groupBy("user_id", "subject").agg(
        F.count("*").alias("total"), F.count_if(F.col("status") == "weak").alias("weak"),
        F.count_if(F.col("status") == "moderate").alias("moderate"), F.count_if(F.col("status") == "strong").alias("strong"))


def plan_summary(plan: DataFrame, users: DataFrame) -> DataFrame:
    """One row per user: whether work is needed and how much of it is critical."""
    counts = plan.groupBy("user_id").agg(
        F.count("*").alias("total_weak"), F.count_if(F.col("severity") == "critical").alias("critical_count"))
    return users.select("user_id").distinct().join(counts, "user_id", "left").fillna(
        {"total_weak": 0, "critical_count": 0}).withColumn(
        "status", F.when(F.col("total_weak") == 0, "all_clear").otherwise("needs_work"))


def experience(actions: DataFrame) -> DataFrame:
    """Points, level and distance to the next level per user."""
    gained = lb.xp_gained(F.col("action"), F.col("correct"))
    total = actions.groupBy("user_id").agg(F.sum(gained).alias("xp"))
    return total.withColumns({"level": lb.level(F.col("xp")), "xp_to_next": lb.xp_to_next(F.col("xp"))})


def daily_experience(actions: DataFrame) -> DataFrame:
    gained = lb.xp_gained(F.col("action"), F.col("correct"))
    return actions.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.sum(gained).alias("daily_xp"))


def leaderboard(daily: DataFrame, users: DataFrame, limit: int = 20) -> DataFrame:
    """Best users of every day; each day starts from zero."""
    best = top_k(daily, ["day"], [F.desc("daily_xp"), F.asc("user_id")], limit)
    named = best.join(users.select("user_id", "username"), "user_id", "left")
    return named.withColumn("username", F.coalesce("username", F.col("user_id").cast("string")))


def streaks(actions: DataFrame) -> DataFrame:
    """Runs of consecutive active days; a user has at most one row per day."""
    days = actions.select("user_id", F.to_date("ts").alias("day")).distinct()
    w = Window.partitionBy("user_id").orderBy("day")
    island = F.date_sub("day", F.row_number().over(w))
    runs = days.withColumn("_i", island).groupBy("user_id", "_i").agg(
        F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("*").alias("days"))
    return runs.drop("_i")


def mentor_context(turns: DataFrame, last: int = 4) -> DataFrame:
    """The last turns of every conversation with speaker labels, oldest first."""
    recent = top_k(turns, ["conv_id"], [F.desc("turn")], last, "_r")
    said = F.concat(F.when(F.col("role") == "user", "Student").otherwise("Mentor"), F.lit(": "), F.col("text"))
    rows = F.array_sort(F.collect_list(F.struct("turn", said.alias("s"))))
    return recent.groupBy("conv_id").agg(F.array_join(F.transform(rows, lambda r: r["s"]), "\n").alias("history"))
