import random

import pytest
from pyspark.sql import Window, functions as F

from quillspark.operators import evaluation as ev, learning, usage
from quillspark.operators.ordered import last_before, order_statistics, running


@pytest.fixture(scope="module")
def hot(spark):
    """One key holds most of the rows; slices are ten wide and some are empty."""
    rng = random.Random(2)
    rows = [("hot" if rng.random() < .7 else f"k{i % 4}", t, rng.choice([None, 1.0, 2.0, 2.0, 5.5])) for i, t in enumerate(
        sorted(rng.sample(range(2000), 300)))]
    return spark.createDataFrame(rows, "k string, t int, v double").cache()


def test_running_equals_plain_window(hot):
    w = Window.partitionBy("k").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    plain = hot.select("k", "t", F.count("*").over(w).alias("n"), F.count("*").over(Window.partitionBy("k")).alias("all"))
    mine = running(hot, ["k"], ["t"], F.floor(F.col("t") / 10), {"n": F.lit(1)}, {"all": F.lit(1)}).select("k", "t", "n", "all")
    assert sorted(plain.collect()) == sorted(mine.collect())


@pytest.mark.parametrize("only", [None, 2.0])
def test_last_before_equals_plain_window(hot, only):
    w = Window.partitionBy("k").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    keep = None if only is None else F.coalesce(F.col("v") == only, F.lit(False))
    held = F.struct("t", "v") if keep is None else F.when(keep, F.struct("t", "v"))
    plain = hot.select("k", "t", F.last(held, ignorenulls=True).over(w).alias("p")).select("k", "t", "p.t", "p.v").toDF("k", "t", "pt", "pv")
    mine = last_before(hot, ["k"], ["t"], F.floor(F.col("t") / 10), {"pt": F.col("t"), "pv": F.col("v")}, keep).select("k", "t", "pt", "pv")
    key = lambda r: (r.k, r.t)
    assert sorted(plain.collect(), key=key) == sorted(mine.collect(), key=key)


def test_order_statistics_are_exact(hot):
    got = {r.k: (r.n, r.p50, r.p95) for r in order_statistics(
        hot, ["k"], "v", F.floor("v"), {"p50": F.floor(F.col("n") / 2), "p95": F.floor(F.col("n") * 0.95)}).collect()}
    values = {}
    for r in hot.where("v is not null").collect():
        values.setdefault(r.k, []).append(r.v)
    for k, vs in values.items():
        vs.sort()
        assert got[k] == (len(vs), vs[len(vs) // 2], vs[int(len(vs) * .95)])


def test_samples_have_the_wanted_size(spark):
    q = spark.range(37).withColumnRenamed("id", "query_id")
    counts = {r.run: r["count"] for r in ev.sampled_runs(q).groupBy("run").count().collect()}
    assert counts == {1: 29, 2: 29, 3: 29}


def test_trend_uses_the_last_fifty(spark):
    def answers(user, flags):
        return [(user, "s", "t", bool(f), i) for i, f in enumerate(flags)]
    rows = answers(1, [1, 0, 1]) + answers(2, [0, 0, 1, 1]) + answers(3, [1, 1, 0, 0]) + answers(4, [1] * 10 + [0] * 25 + [1] * 25)
    df = spark.createDataFrame(rows, "user_id int, subject string, topic string, is_correct boolean, i int")
    got = {r.user_id: (r.direction, r.improvement) for r in learning.topic_trends(df, ["i"]).collect()}
    assert got == {1: ("stable", 0.0), 2: ("improving", 1.0), 3: ("declining", -1.0), 4: ("improving", 1.0)}


def test_quota_contract(spark):
    rows = [(1, "free", "quiz", f"2024-01-01 10:0{i}:00", i) for i in range(4)] + [(1, "free", "quiz", "2024-01-02 00:00:01", 9)] + \
        [(2, "premium", "quiz", f"2024-01-01 10:0{i}:00", 10 + i) for i in range(4)] + [(1, "free", "unknown", "2024-01-01 11:00:00", 20)]
    df = spark.createDataFrame(rows, "user_id int, tier string, limit_type string, ts string, event_id int").withColumn("ts", F.to_timestamp("ts"))
    got = {r.event_id: r.decision for r in usage.quota_decisions(df, ["ts", "event_id"]).collect()}
    assert [got[i] for i in range(4)] == ["allowed", "allowed", "denied", "denied"]
    assert got[9] == "allowed" and {got[i] for i in (10, 11, 12, 13, 20)} == {"uncounted"}


def test_ledger_contract(spark):
    rows = [("userlib:u1", "OpenAI", "gpt-4o-mini", "a" * 40, "b" * 3, None, None), ("u1", "", "x-gpt-5-nano", "", "", 1000, 2000),
            ("", "p", None, "abcd", "", None, None)]
    df = spark.createDataFrame(rows, "user_key string, provider string, model string, prompt string, response string, prompt_tokens int, completion_tokens int")
    got = sorted((r.user_id, r.provider, r.in_tokens, r.out_tokens, round(r.cost_usd, 9)) for r in usage.ledger(df).collect())
    assert got == [("default_user", "p", 1, 0, 1.5e-07), ("u1", "openai", 10, 1, 2.1e-06), ("u1", "unknown", 1000, 2000, 0.00085)]


def test_provider_cooldown(spark):
    rows = [("a", 10, 0, 20.0, None), ("b", 5, 5, 50.0, "2024-01-01 00:00:00"), ("c", 0, 0, None, None), ("d", 9, 1, 9.0, "2024-01-01 00:00:30")]
    df = spark.createDataFrame(rows, "provider string, successes int, failures int, total_latency double, lf string").withColumn(
        "last_failure", F.to_timestamp("lf"))
    got = {r.provider: round(r.health, 4) for r in usage.provider_health(df, F.to_timestamp(F.lit("2024-01-01 00:01:00"))).collect()}
    assert got == {"a": 1.0, "b": 0.4, "c": 1.0, "d": 0.5}
