"""Learner, usage and quota analytics over ``events`` and ``conversations``."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quillspark.functions import labels as lb, text as tx
from quillspark.operators import learning, usage
from quillspark.operators.ordered import last_before
from quillspark.plans import ask
from quillspark.workloads import sql
from quillspark.workloads.retrieval import ALL_QUESTIONS_SQL, all_questions
from quillspark.workloads.tables import read

QUERIES, ORACLES = {}, {}
ORDER = ["ts", "event_id"]


def bound(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return add


def hour_slice():
    return F.date_trunc("hour", F.col("ts"))


def events(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))


def answers(spark, sf_dir) -> DataFrame:
    """Clicks are correct answers, errors wrong ones."""
    k = F.col("k")
    return events(spark, sf_dir).where(F.col("event_type").isin("click", "error")).select(
        "user_id", F.concat(F.lit("Subject "), (k % 3).cast("string")).alias("subject"),
        F.concat(F.lit("Topic "), (k % 10).cast("string")).alias("topic"),
        (F.col("event_type") == "click").alias("is_correct"), "ts", "event_id")


def actions(spark, sf_dir) -> DataFrame:
    name = (F.when(F.col("event_type") == "signup", "upload").when(F.col("event_type") == "view", "ask")
            .when(F.col("event_type") == "purchase", "quiz_complete").when(F.col("event_type") == "click", "correct_answer")
            .otherwise("other"))
    return events(spark, sf_dir).select("user_id", name.alias("action"), (F.col("k") % 6).alias("correct"), "ts", "event_id")


def users(spark, sf_dir) -> DataFrame:
    ids = read(spark, sf_dir, "events").select("user_id").distinct()
    return ids.select("user_id", F.when(F.col("user_id") % 3 > 0, F.concat(F.lit("user"), F.col("user_id").cast("string")))
                      .alias("username"), F.when(F.col("user_id") % 10 == 0, "premium").otherwise("free").alias("tier"))


EVENTS_SQL = "e as (select *, (props::json ->> '$.k')::int as k from events)"
ANSWERS_SQL = f"""{EVENTS_SQL}, answers as (select user_id, 'Subject ' || (k % 3) as subject, 'Topic ' || (k % 10) as topic,
    (event_type = 'click')::int as ok, ts, event_id from e where event_type in ('click', 'error'))"""
TOPICS_SQL = f"""{ANSWERS_SQL},
score as (select user_id, subject, topic, sum(ok)::bigint as correct, count(*) as total from answers group by all),
rec as (select *, row_number() over (partition by user_id, subject, topic order by ts desc, event_id desc) as r from answers),
rec2 as (select *, count(*) over (partition by user_id, subject, topic) as n from rec where r <= 50),
tr as (select user_id, subject, topic, max(n) as n,
    sum(case when not (n - r < n // 2) then ok end) / sum(case when not (n - r < n // 2) then 1 end)
    - sum(case when n - r < n // 2 then ok end) / sum(case when n - r < n // 2 then 1 end) as d from rec2 group by all),
tr2 as (select user_id, subject, topic, case when n >= 4 then d else 0 end as d from tr),
topics as (select s.*, correct / total as raw, round(correct / total, 2) as accuracy,
    case when d > 0.1 then 'improving' when d < -0.1 then 'declining' else 'stable' end as direction,
    round(d, 2) as improvement from score s join tr2 using (user_id, subject, topic)),
weak as (select * from topics where total >= 2 and raw < 0.6)"""


@bound("topic_scores", f"""with {ANSWERS_SQL}
select user_id, subject, topic, sum(ok)::bigint as correct, count(*) as total from answers group by all""")
def topic_scores(spark, sf_dir):
    return learning.topic_scores(answers(spark, sf_dir))


@bound("topic_overview", f"""with {TOPICS_SQL}
select user_id, subject, topic, correct, total, accuracy, direction, improvement,
    case when raw >= 0.8 then 'strong' when raw >= 0.6 then 'moderate' else 'weak' end as status from topics""")
def topic_overview(spark, sf_dir):
    return learning.all_topics(answers(spark, sf_dir), ORDER).drop("raw_accuracy")


def recommendation_sql() -> str:
    def fill(key) -> str:
        a, b = lb.RECOMMENDATIONS[key].split("{t}")
        return f"'{a}' || topic || '{b}'"
    return f"""case when raw < 0.3 then case when direction = 'declining' then {fill(('low', 'declining'))} else {fill(('low', 'other'))} end
    when raw < 0.5 then case when direction = 'improving' then {fill(('middle', 'improving'))} else {fill(('middle', 'other'))} end
    else case when direction = 'improving' then {fill(('upper', 'improving'))} else {fill(('upper', 'other'))} end end"""


@bound("weak_topics", f"""with {TOPICS_SQL}
select user_id, subject, topic, correct, total, accuracy, direction, improvement, {recommendation_sql()} as recommendation
from weak""")
def weak_topics(spark, sf_dir):
    weak = learning.weak_topics(learning.all_topics(answers(spark, sf_dir), ORDER))
    return weak.drop("raw_accuracy", "status")


def advice_sql() -> str:
    def esc(s: str) -> str:
        return s.replace("'", "''")

    def fill(s: str) -> str:
        return "'" + esc(s).replace("{t}", "' || topic || '") + "'"

    sev = "case when accuracy < 0.3 then 'critical' when accuracy < 0.5 then 'high' when accuracy < 0.6 then 'medium' else 'low' end"
    issue = "case sev " + " ".join(f"when '{k}' then {fill(v[0])}" for k, v in lb.ADVICE.items()) + " end"
    reason = "case sev " + " ".join(f"when '{k}' then '{esc(v[1])}'" for k, v in lb.ADVICE.items()) + " end"
    steps = "case sev " + " ".join(
        f"when '{k}' then " + " || '; ' || ".join(fill(x) for x in v[2]) for k, v in lb.ADVICE.items()) + " end"
    notes = "case direction " + " ".join(f"when '{k}' then '{esc(v)}'" for k, v in lb.TREND_NOTES.items()) + " end"
    return f"""adv as (select *, {sev} as sev from weak),
plan as (select user_id, topic, subject, accuracy, (row_number() over (partition by user_id order by accuracy, subject, topic))::int
    as plan_order, case when accuracy < 0.3 then 3 when accuracy < 0.5 then 2 else 1 end as sessions, sev as severity,
    {issue} as issue, {reason} as reason,
    case when direction = 'declining' then '{lb.DECLINING_STEP}; ' else '' end || {steps} as steps,
    {notes} as trend_note, case when accuracy < 0.4 then 'high' when accuracy < 0.6 then 'medium' else 'low' end as priority
    from adv)"""


@bound("study_plan", f"with {TOPICS_SQL}, {advice_sql()} select * from plan")
def study_plan(spark, sf_dir):
    plan = learning.study_plan(learning.weak_topics(learning.all_topics(answers(spark, sf_dir), ORDER)))
    return plan.select("user_id", "topic", "subject", "accuracy", "plan_order", "sessions", "severity", "issue", "reason",
                       F.array_join("steps", "; ").alias("steps"), "trend_note", "priority")


@bound("study_plan_summary", f"""with {TOPICS_SQL}, {advice_sql()},
c as (select user_id, count(*) as total_weak, count(*) filter (severity = 'critical') as critical_count from plan group by user_id)
select user_id, coalesce(total_weak, 0) as total_weak, coalesce(critical_count, 0) as critical_count,
    case when total_weak is null then 'all_clear' else 'needs_work' end as status
from (select distinct user_id from events) left join c using (user_id)""")
def study_plan_summary(spark, sf_dir):
    plan = learning.study_plan(learning.weak_topics(learning.all_topics(answers(spark, sf_dir), ORDER)))
    return learning.plan_summary(plan, users(spark, sf_dir))


@bound("quiz_focus", f"""with {TOPICS_SQL},
f as (select user_id, topic, row_number() over (partition by user_id order by accuracy, subject, topic) as r from weak),
g as (select user_id, string_agg(topic, ', ' order by r) as weak_topics from f where r <= 3 group by user_id)
select *, '{learning.FOCUS_HEAD}' || weak_topics || '{learning.FOCUS_TAIL}' as focus_query from g""")
def quiz_focus(spark, sf_dir):
    return learning.quiz_focus(learning.weak_topics(learning.all_topics(answers(spark, sf_dir), ORDER)))


@bound("subject_summary", f"""with {TOPICS_SQL}
select user_id, subject, count(*) as total, count(*) filter (raw < 0.6) as weak,
    count(*) filter (raw >= 0.6 and raw < 0.8) as moderate, count(*) filter (raw >= 0.8) as strong from topics group by all""")
def subject_summary(spark, sf_dir):
    return learning.subject_summary(learning.all_topics(answers(spark, sf_dir), ORDER))


ACTIONS_SQL = f"""{EVENTS_SQL}, acts as (select user_id, ts, case event_type when 'signup' then 20 when 'view' then 5
    when 'purchase' then 50 + 10 * (k % 6) when 'click' then 10 else 0 end as xp from e)"""


@bound("experience_levels", f"""with {ACTIONS_SQL}, s as (select user_id, sum(xp)::bigint as xp from acts group by user_id)
select user_id, xp, case when xp < 100 then 1 when xp < 300 then 2 when xp < 700 then 3 when xp < 1500 then 4 else 5 end as level,
    case when xp < 100 then 100 - xp when xp < 300 then 300 - xp when xp < 700 then 700 - xp when xp < 1500 then 1500 - xp
    when xp < 3000 then 3000 - xp else 0 end as xp_to_next from s""")
def experience_levels(spark, sf_dir):
    return learning.experience(actions(spark, sf_dir))


@bound("daily_leaderboard", f"""with {ACTIONS_SQL},
d as (select user_id, ts::date as day, sum(xp)::bigint as daily_xp from acts group by all),
r as (select *, (row_number() over (partition by day order by daily_xp desc, user_id))::int as rank from d)
select user_id, day, daily_xp, rank, case when user_id % 3 > 0 then 'user' || user_id else user_id::varchar end as username
from r where rank <= 20""")
def daily_leaderboard(spark, sf_dir):
    daily = learning.daily_experience(actions(spark, sf_dir))
    return learning.leaderboard(daily, users(spark, sf_dir), 20)


@bound("activity_streaks", """with d as (select distinct user_id, ts::date as day from events),
i as (select *, day - (row_number() over (partition by user_id order by day))::int as isl from d)
select user_id, min(day) as first_day, max(day) as last_day, count(*) as days from i group by user_id, isl""")
def activity_streaks(spark, sf_dir):
    return learning.streaks(actions(spark, sf_dir))


# --- graded attempts -------------------------------------------------------------

def attempts(spark, sf_dir) -> DataFrame:
    """Every purchase is a five-question attempt with ``k % 7`` answers, some padded or lower case."""
    k = F.col("k")

    def question(i):
        key = F.substring(F.lit("ABCD"), ((k + i) % 4 + 1).cast("int"), F.lit(1))
        return F.struct(
            F.concat(F.lit("Question about overfitting "), i.cast("string")).alias("question"),
            F.transform(F.array(*[F.lit(x) for x in "wxyz"]), lambda o: F.concat(F.lit(" "), o, i.cast("string"))).alias("options"),
            key.alias("correct_answer"), F.lit("").alias("explanation"),
            F.when(i % 2 == 0, F.lit("")).otherwise(F.concat(F.lit(" Topic "), i.cast("string"))).alias("topic"))

    def given(i):
        letter = F.substring(F.lit("ABCD"), ((k * 3 + i * F.col("event_id")) % 4 + 1).cast("int"), F.lit(1))
        return F.when(i % 3 == 0, F.concat(F.lit(" "), F.lower(letter))).otherwise(letter)

    five = F.sequence(F.lit(0), F.lit(4))
    answered = F.slice(F.transform(F.sequence(F.lit(0), F.lit(6)), given), 1, k % 7)
    return events(spark, sf_dir).where("event_type = 'purchase'").select(
        F.col("event_id").alias("attempt_id"), "user_id", F.transform(five, question).alias("questions"),
        answered.alias("answers"))


GRADED_SQL = f"""{EVENTS_SQL},
att as (select event_id as attempt_id, user_id, k, least(5, k % 7) as n, unnest(range(0, 5)) as i from e where event_type = 'purchase'),
gr as (select *, substr('ABCD', (k + i) % 4 + 1, 1) as key_letter, substr('ABCD', (k * 3 + i * attempt_id) % 4 + 1, 1) as given_letter
    from att)"""


@bound("graded_answers", f"""with {GRADED_SQL}
select attempt_id, user_id, 'q' || i as question_id, given_letter, key_letter,
    substr('wxyz', (k * 3 + i * attempt_id)::bigint % 4 + 1, 1) || i as given_text, substr('wxyz', (k + i) % 4 + 1, 1) || i as key_text,
    given_letter = key_letter as is_correct, case when i % 2 = 0 then 'General' else 'Topic ' || i end as topic,
    case when i % 2 = 0 then 'Regularization' else 'Topic ' || i end as logged_topic from gr where i < n""")
def graded_answers(spark, sf_dir):
    graded = learning.grade(attempts(spark, sf_dir)).where("ordinal is not null")
    return graded.select("attempt_id", "user_id", "question_id", "given_letter", "key_letter", "given_text", "key_text",
                         "is_correct", "topic", lb.answered_topic(F.col("topic"), F.col("question")).alias("logged_topic"))


@bound("attempt_scores", f"""with {GRADED_SQL}
select attempt_id, user_id, coalesce(sum((given_letter = key_letter)::int) filter (i < n), 0)::bigint as correct, 5 as total,
    round(coalesce(sum((given_letter = key_letter)::int) filter (i < n), 0) / 5, 2) as accuracy from gr group by attempt_id, user_id""")
def attempt_scores(spark, sf_dir):
    return learning.attempt_scores(learning.grade(attempts(spark, sf_dir)), ["attempt_id", "user_id"])


@bound("topic_keys", f"""with {EVENTS_SQL}, raw as (select event_id, case k % 5 when 0 then 'Subject ' || k || '::Topic ' || k when 1 then 'Topic ' || k
    when 2 then '::' when 3 then ' S ::  T::U ' else '' end as raw from e),
s as (select event_id, raw, position('::' in trim(raw)) as cut, trim(raw) as t from raw),
p as (select event_id, case when cut > 0 then coalesce(nullif(trim(substr(t, 1, cut - 1)), ''), 'General Studies') else 'General Studies' end as subject,
    case when cut > 0 then coalesce(nullif(trim(substr(t, cut + 2)), ''), 'General') else coalesce(nullif(t, ''), 'General') end as topic from s)
select *, subject || '::' || topic as topic_key from p""")
def topic_keys(spark, sf_dir):
    k = F.col("k")
    text = k.cast("string")
    raw = (F.when(k % 5 == 0, F.concat(F.lit("Subject "), text, F.lit("::Topic "), text))
           .when(k % 5 == 1, F.concat(F.lit("Topic "), text)).when(k % 5 == 2, "::").when(k % 5 == 3, " S ::  T::U ").otherwise(""))
    subject, topic = lb.split_topic_key(F.col("raw"))
    split = events(spark, sf_dir).select("event_id", raw.alias("raw")).select(
        "event_id", subject.alias("subject"), topic.alias("topic"))
    return split.withColumn("topic_key", lb.topic_key(F.col("subject"), F.col("topic")))


# --- usage ---------------------------------------------------------------------------

MODELS = ["gpt-4o-mini", "openai/GPT-5-nano-2025", "gemini-2.5-flash-lite-preview", "claude-local", ""]
PROVIDERS = ["OpenAI", " gemini ", ""]


def model_calls(spark, sf_dir) -> DataFrame:
    """An assistant turn and the user turn right before it are one call."""
    turns = read(spark, sf_dir, "conversations")
    prior = last_before(turns, ["conv_id"], ["turn"], F.floor(F.col("turn") / 1024),
                        {"prompt": F.col("text"), "_role": F.col("role")})
    conv = F.col("conv_id")
    return prior.where("role = 'assistant' and _role = 'user'").select(
        F.concat(F.when(conv % 2 == 0, "userlib:").otherwise(""), (conv % 40).cast("string")).alias("user_key"),
        F.element_at(F.array(*[F.lit(p) for p in PROVIDERS]), (conv % 3 + 1).cast("int")).alias("provider"),
        F.element_at(F.array(*[F.lit(m) for m in MODELS]), (conv % 5 + 1).cast("int")).alias("model"),
        "prompt", F.col("text").alias("response"), "conv_id", "turn",
        F.when(F.col("turn") % 4 == 3, F.col("turn").cast("int") * 7).alias("prompt_tokens"),
        F.lit(None).cast("int").alias("completion_tokens"))


LEDGER_SQL = f"""c as (select *, lag(text) over w as prompt, lag(role) over w as prole from conversations
    window w as (partition by conv_id order by turn)),
calls as (select conv_id, turn, (conv_id % 40)::varchar as user_id, ({sql.lst(['openai', 'gemini', 'unknown'])})[conv_id % 3 + 1] as provider,
    (case when turn % 4 = 3 then turn * 7 else greatest(1, length(prompt) // 4) end)::int as in_tokens,
    greatest(1, length(text) // 4)::int as out_tokens,
    ([0.15, 0.05, 0.10, 0.15, 0.15]::double[])[conv_id % 5 + 1] as ri, ([0.60, 0.40, 0.40, 0.60, 0.60]::double[])[conv_id % 5 + 1] as ro
    from c where role = 'assistant' and prole = 'user'),
led as (select *, in_tokens + out_tokens as total_tokens, (in_tokens * ri + out_tokens * ro) / 1000000.0 as cost from calls)"""


@bound("usage_ledger", f"""with {LEDGER_SQL}
select conv_id, turn, user_id, provider, in_tokens, out_tokens, total_tokens, round(cost, 9) as cost_usd from led""")
def usage_ledger(spark, sf_dir):
    rows = usage.ledger(model_calls(spark, sf_dir))
    return rows.select("conv_id", "turn", "user_id", "provider", "in_tokens", "out_tokens", "total_tokens",
                       F.round("cost_usd", 9).alias("cost_usd"))


@bound("usage_totals", f"""with {LEDGER_SQL},
p as (select user_id, provider, sum(in_tokens)::bigint as i, sum(out_tokens)::bigint as o, sum(total_tokens)::bigint as t, sum(cost) as c
    from led group by all)
select user_id, sum(i)::bigint as prompt_tokens, sum(o)::bigint as completion_tokens, sum(t)::bigint as total_tokens,
    round(sum(c), 8) as cost_usd, string_agg(provider || '=' || t, ',' order by provider) as provider_usage from p group by user_id""")
def usage_totals(spark, sf_dir):
    totals = usage.usage_totals(usage.ledger(model_calls(spark, sf_dir)))
    pairs = F.transform(F.array_sort(F.map_entries("provider_usage")), lambda x: F.concat_ws("=", x["key"], x["value"].cast("string")))
    return totals.withColumns({"cost_usd": F.round("cost_usd", 8), "provider_usage": F.array_join(pairs, ",")})


@bound("usage_spikes", f"""with {LEDGER_SQL},
r as (select conv_id, turn, user_id, total_tokens, (row_number() over (partition by user_id order by conv_id desc, turn desc))::int as recency
    from led where total_tokens > 200) select * from r where recency <= 50""")
def usage_spikes(spark, sf_dir):
    """Heavy calls; the threshold is lowered to the size of the test texts."""
    heavy = usage.spikes(usage.ledger(model_calls(spark, sf_dir)), ["conv_id", "turn"], 200)
    return heavy.select("conv_id", "turn", "user_id", "total_tokens", "recency")


def requests(spark, sf_dir) -> DataFrame:
    kind = (F.when(F.col("event_type") == "view", " RAG").when(F.col("event_type") == "purchase", "quiz")
            .when(F.col("event_type") == "click", "flashcard").when(F.col("event_type") == "signup", "summary").otherwise("other"))
    return events(spark, sf_dir).select(
        "user_id", F.when(F.col("user_id") % 10 == 0, "premium").otherwise("free").alias("tier"), kind.alias("limit_type"),
        "ts", "event_id", "event_type", "k")


REQUESTS_SQL = f"""{EVENTS_SQL}, rq as (select user_id, event_id, ts, ts::date as day, k,
    case when user_id % 10 = 0 then 'premium' else 'free' end as tier,
    case event_type when 'view' then 'rag' when 'purchase' then 'quiz' when 'click' then 'flashcard' when 'signup' then 'summary'
        else 'other' end as limit_type from e),
lim as (select *, case limit_type when 'rag' then 5 when 'other' then null else 2 end as quota from rq)"""
DECIDED_SQL = REQUESTS_SQL + """,
dec as (select *, case when tier <> 'free' or quota is null then 'uncounted'
    when row_number() over (partition by user_id, day, limit_type order by ts, event_id) <= quota then 'allowed' else 'denied' end
    as decision from lim)"""


@bound("quota_decisions", f"with {DECIDED_SQL} select user_id, event_id, day, tier, limit_type, decision from dec")
def quota_decisions(spark, sf_dir):
    decided = usage.quota_decisions(requests(spark, sf_dir), ORDER)
    return decided.select("user_id", "event_id", "day", "tier", "limit_type", "decision")


@bound("quota_exhaustions", f"""with {DECIDED_SQL}
select user_id, limit_type, count(*) as hits from dec where decision = 'denied' group by all""")
def quota_exhaustions(spark, sf_dir):
    return usage.exhaustions(usage.quota_decisions(requests(spark, sf_dir), ORDER))


@bound("quota_remaining", f"""with {DECIDED_SQL},
u as (select user_id, day, tier, limit_type, any_value(quota) as quota, count(*) filter (decision = 'allowed') as used from dec
    where quota is not null group by user_id, day, tier, limit_type)
select user_id, day, tier, limit_type, used, quota, case when tier = 'free' then greatest(0, quota - used) else 999999 end as remaining
from u""")
def quota_remaining(spark, sf_dir):
    return usage.remaining(usage.quota_decisions(requests(spark, sf_dir), ORDER), ["user_id", "day"])


@bound("quota_after_tier_change", f"""with {REQUESTS_SQL},
p as (select *, sum((k % 20 = 7 and limit_type = 'other')::int) over (partition by user_id order by ts, event_id) as period from lim),
d as (select *, case when tier <> 'free' or quota is null then 'uncounted' when row_number() over (
    partition by user_id, day, limit_type, period order by ts, event_id) <= quota then 'allowed' else 'denied' end as decision
    from p where not (k % 20 = 7 and limit_type = 'other'))
select user_id, event_id, limit_type, period::bigint as period, decision from d""")
def quota_after_tier_change(spark, sf_dir):
    """Errors with ``k % 20 = 7`` stand for a subscription change."""
    rows = requests(spark, sf_dir)
    change = (F.col("event_type") == "error") & (F.col("k") % 20 == 7)
    periods = usage.quota_periods(rows.where(~change), rows.where(change).select("user_id", *ORDER), ORDER, hour_slice())
    decided = usage.quota_decisions(periods, ORDER)
    return decided.select("user_id", "event_id", "limit_type", "period", "decision")


@bound("feature_gates", f"""with {EVENTS_SQL}, g as (select event_id, case when user_id % 10 = 0 then 'premium' else 'free' end as tier,
    {sql.lst(['library_ask', 'mentor', 'mock_test', 'flashcards', 'summary', 'rapid_fire', 'slides'])}[k % 7 + 1] as feature from e)
select event_id, feature, case when feature in ('library_ask', 'mentor', 'mock_test') and tier <> 'premium' then 'premium_only' end as reason,
    case feature when 'flashcards' then 'flashcard' when 'summary' then 'summary' when 'mock_test' then 'quiz' when 'rapid_fire' then 'quiz' end
    as quota_type from g""")
def feature_gates(spark, sf_dir):
    features = ["library_ask", "mentor", "mock_test", "flashcards", "summary", "rapid_fire", "slides"]
    rows = requests(spark, sf_dir).withColumn(
        "feature", F.element_at(F.array(*[F.lit(f) for f in features]), F.col("k") % 7 + 1))
    return rows.select("event_id", "feature", usage.feature_gate(F.col("feature"), F.col("tier")).alias("reason"),
                       usage.content_quota_type(F.col("feature")).alias("quota_type"))


@bound("provider_health", f"""with {EVENTS_SQL},
c as (select 'p' || (k % 4) as provider, event_type <> 'error' as ok, value / 10 as latency, ts from e
    where ts <= timestamp '2024-01-30 23:50:00'),
t as (select provider, count(*) filter (ok) as successes, count(*) filter (not ok) as failures, sum(latency) filter (ok) as lat,
    max(ts) filter (not ok) as lf from c group by provider),
h as (select *, date_diff('microsecond', lf, timestamp '2024-01-30 23:50:00') / 1e6 as since, lat / nullif(successes, 0) as av from t)
select provider, successes, failures, round(lat, 4) as total_latency, round(case when since >= 0 and since < 60 then greatest(0.1, since / 60)
    when successes + failures = 0 then 1 else greatest(0.1, 1 - failures / (successes + failures) * 0.8
    - case when av > 5 then least(0.2, (av - 5) * 0.04) else 0 end) end, 6) as health from h""")
def provider_health(spark, sf_dir):
    moment = F.lit("2024-01-30 23:50:00")
    calls = events(spark, sf_dir).where(F.col("ts") <= moment.cast("timestamp_ntz")).select(
        F.concat(F.lit("p"), (F.col("k") % 4).cast("string")).alias("provider"), (F.col("event_type") != "error").alias("ok"),
        (F.col("value") / 10).alias("latency"), "ts")
    health = usage.provider_health(usage.provider_totals(calls), moment.cast("timestamp_ntz").cast("timestamp"))
    return health.select("provider", "successes", "failures", F.round("total_latency", 4).alias("total_latency"),
                         F.round("health", 6).alias("health"))


@bound("call_gaps", """with g as (select event_id, user_id, date_diff('microsecond', lag(ts) over (partition by user_id order by ts, event_id), ts) / 1e6
    as gap from events) select event_id, user_id, round(gap, 6) as gap_seconds, coalesce(gap < 60, false) as too_soon from g""")
def call_gaps(spark, sf_dir):
    gaps = usage.call_gaps(read(spark, sf_dir, "events"), "user_id", ORDER, hour_slice(), 60.0)
    return gaps.select("event_id", "user_id", F.round("gap_seconds", 6).alias("gap_seconds"), "too_soon")


@bound("confidence_swings", """with s as (select event_id, user_id, least(value / 50, 1) as score, lag(least(value / 50, 1)) over (
    partition by user_id order by ts, event_id) as prev from events)
select event_id, user_id, round(prev, 6) as previous, round(abs(score - prev), 6) as delta, coalesce(abs(score - prev) > 0.4, false) as unstable
from s""")
def confidence_swings(spark, sf_dir):
    scores = read(spark, sf_dir, "events").withColumn("score", F.least(F.col("value") / 50, F.lit(1.0)))
    swings = usage.confidence_swings(scores, "user_id", ORDER, hour_slice())
    return swings.select("event_id", "user_id", F.round("previous", 6).alias("previous"), F.round("delta", 6).alias("delta"), "unstable")


@bound("followup_questions", f"""with u as (select conv_id, turn, case when turn % 4 = 2 then 'Please explain this in detail' else text end as q
    from conversations where role = 'user'),
f as (select *, regexp_matches({sql.strip('q')}, '(?i)^(?:pls|please)?\\s*(?:can you\\s*)?(?:explain|simplify|describe|rephrase)(?:\\s+this|\\s+it)?(?:\\s+in\\s+detail)?\\s*$') as fu,
    case when not (contains(lower(q), 'explain') or contains(lower(q), 'simplify') or contains(lower(q), 'describe') or contains(lower(q), 'rephrase'))
        or starts_with(lower({sql.strip('q')}), 'what is') or starts_with(lower({sql.strip('q')}), 'define') then nullif({sql.strip('q')}, '') end as held from u),
p as (select *, last_value(held ignore nulls) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding) as prev from f)
select conv_id, turn, fu and prev is not null as is_followup,
    case when fu and prev is not null then 'Explain this topic from my documents in simple terms: ' || prev else {sql.strip('q')} end as resolved from p""")
def followup_questions(spark, sf_dir):
    """Every third user turn is replaced by a bare follow-up."""
    turns = read(spark, sf_dir, "conversations").where("role = 'user'").withColumn(
        "query", F.when(F.col("turn") % 4 == 2, "Please explain this in detail").otherwise(F.col("text")))
    resolved = ask.resolve_followups(turns, "conv_id", ["turn"], F.floor(F.col("turn") / 1024))
    return resolved.select("conv_id", "turn", "is_followup", "resolved")


def normalized_sql(x: str) -> str:
    return f"case when len({sql.keywords(x)}) > 0 then {x} || ' | keywords: ' || array_to_string({sql.keywords(x)}, ' ') else {x} end"


@bound("memoised_questions", f"""with {ALL_QUESTIONS_SQL},
w as (select query_id, {sql.words(sql.strip('query'))} as ws from asked),
s as (select query_id, lower(array_to_string(list_reduce(list_transform(ws, lambda x: [x]),
    lambda acc, x: case when len(list_filter(list_slice(acc, greatest(len(acc) - 2, 1), len(acc)),
        lambda y: lower(y) = lower(x[1]))) > 0 then acc else list_concat(acc, x) end, cast([] as varchar[])), ' ')) as q from w),
n as (select query_id, {normalized_sql('q')} as normalized from s where q <> ''),
k as (select query_id, sha256('v2' || chr(10) || 'u1' || chr(10) || normalized) as cache_key from n)
select query_id, cache_key, cache_key in (select cache_key from k where query_id like 'b%') as hit from k""")
def memoised_questions(spark, sf_dir):
    """Which questions already have a stored answer; those of the benchmark do."""
    asked = all_questions(spark, sf_dir).withColumn("normalized", tx.normalize_query(F.col("query"))).where(
        "normalized is not null").withColumn("cache_key", ask.cache_key(F.lit("u1"), F.col("normalized")))
    hits, misses = ask.split_memoised(asked, asked.where(F.col("query_id").startswith("b")))
    return hits.select("query_id", "cache_key", F.lit(True).alias("hit")).unionByName(
        misses.select("query_id", "cache_key", F.lit(False).alias("hit")))


@bound("mentor_history", """with r as (select *, row_number() over (partition by conv_id order by turn desc) as r from conversations)
select conv_id, string_agg(case role when 'user' then 'Student: ' else 'Mentor: ' end || text, chr(10) order by turn) as history
from r where r <= 4 group by conv_id""")
def mentor_history(spark, sf_dir):
    return learning.mentor_context(read(spark, sf_dir, "conversations"))


@bound("tenants", """with docs as (select doc_id::varchar as key, (doc_id % 200)::varchar as owner from documents),
u as (select distinct user_id::varchar as id, case when user_id % 10 = 0 then 'premium' else 'free' end as tier from events),
k as (select event_id, case event_id % 4 when 0 then 'userlib:' || user_id when 1 then event_id::varchar when 2 then 'x' || user_id else '' end as key
    from events),
r as (select event_id, k.key, case when k.key = '' then 'default_user' when starts_with(k.key, 'userlib:') then substr(k.key, 9)
    else coalesce(d.owner, k.key) end as user_id from k left join docs d using (key))
select event_id, key, user_id, coalesce(u.tier, 'free') as tier from r left join u on u.id = r.user_id""")
def tenants(spark, sf_dir):
    keys = read(spark, sf_dir, "events").select("event_id", (
        F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("userlib:"), F.col("user_id").cast("string")))
        .when(F.col("event_id") % 4 == 1, F.col("event_id").cast("string"))
        .when(F.col("event_id") % 4 == 2, F.concat(F.lit("x"), F.col("user_id").cast("string"))).otherwise("")).alias("key"))
    docs = read(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 200).alias("user_id"))
    return usage.resolve_tenants(keys, docs, users(spark, sf_dir)).select("event_id", "key", "user_id", "tier")
