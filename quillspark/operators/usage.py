"""Usage ledger, quotas, gates and provider health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quillspark.functions import text as tx
from quillspark.operators.ordered import join_keys, last_before, running, top_k

# USD per million tokens, looked up exactly, then by containment in this order.
MODEL_RATES = [
    ("gpt-5-nano", 0.05, 0.40), ("gemini-flash-lite", 0.10, 0.40), ("gemini-2.5-flash-lite", 0.10, 0.40),
    ("gemini-3.1-flash-lite", 0.25, 1.50), ("gpt-4o-mini", 0.15, 0.60), ("default", 0.15, 0.60),
]
# Daily requests of the free tier.
FREE_LIMITS = {"rag": 5, "quiz": 2, "flashcard": 2, "summary": 2}
UNLIMITED = 999999
SPIKE_TOKENS, SPIKES_KEPT = 4000, 50


def owner_of(key: Column) -> Column:
    """User id of a ledger key, the ``userlib:`` prefix removed."""
    bare = F.regexp_replace(key, "^userlib:", "")
    return F.when(F.coalesce(key, F.lit("")) == "", "default_user").otherwise(bare)


def rates_of(model: Column) -> Column:
    name = F.lower(tx.strip(F.coalesce(F.nullif(model, F.lit("")), F.lit("default"))))
    exact = contained = None
    for key, inp, out in MODEL_RATES:
        value = F.struct(F.lit(inp).alias("input"), F.lit(out).alias("output"))
        exact = F.when(name == key, value) if exact is None else exact.when(name == key, value)
        hit = name.contains(key)
        contained = F.when(hit, value) if contained is None else contained.when(hit, value)
    _, inp, out = MODEL_RATES[-1]
    return F.coalesce(exact, contained, F.struct(F.lit(inp).alias("input"), F.lit(out).alias("output")))


def ledger(calls: DataFrame) -> DataFrame:
    """Tokens and cost of every call.

    ``calls(user_key, provider, model, prompt, response, prompt_tokens,
    completion_tokens)``; missing counts are estimated from the texts.
    """
    rows = calls.withColumns({
        "user_id": owner_of(F.col("user_key")),
        "provider": F.lower(tx.strip(F.coalesce(F.nullif("provider", F.lit("")), F.lit("unknown")))),
        "in_tokens": F.coalesce("prompt_tokens", tx.ledger_tokens(F.col("prompt"))),
        "out_tokens": F.coalesce("completion_tokens", tx.ledger_tokens(F.col("response"))),
        "_rate": rates_of(F.col("model")),
    })
    cost = (F.col("in_tokens") * F.col("_rate.input") + F.col("out_tokens") * F.col("_rate.output")) / 1_000_000.0
    return rows.withColumns({"total_tokens": F.col("in_tokens") + F.col("out_tokens"), "cost_usd": cost}).drop("_rate")


def usage_totals(entries: DataFrame) -> DataFrame:
    """Per user: token sums, cost and tokens by provider as a map."""
    by_provider = entries.groupBy("user_id", "provider").agg(
        F.sum("in_tokens").alias("i"), F.sum("out_tokens").alias("o"), F.sum("total_tokens").alias("t"),
        F.sum("cost_usd").alias("c"))
    pairs = F.array_sort(F.collect_list(F.struct("provider", "t")))
    return by_provider.groupBy("user_id").agg(
        F.sum("i").alias("prompt_tokens"), F.sum("o").alias("completion_tokens"), F.sum("t").alias("total_tokens"),
        F.sum("c").alias("cost_usd"), F.map_from_entries(pairs).alias("provider_usage"))


def spikes(entries: DataFrame, order: list[str], tokens: int = SPIKE_TOKENS, last: int = SPIKES_KEPT) -> DataFrame:
    """The latest heavy calls of every user, newest ranked first."""
    heavy = entries.where(F.col("total_tokens") > tokens)
    return top_k(heavy, ["user_id"], [F.desc(c) for c in order], last, "recency")


def quota_limit(limit_type: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in FREE_LIMITS.items() for x in kv]), limit_type)


def content_quota_type(content_type: Column) -> Column:
    return (
        F.when(content_type == "flashcards", "flashcard").when(content_type == "summary", "summary")
        .when(content_type.isin("mock_test", "rapid_fire", "true_false", "fill_blanks"), "quiz")
    )


def quota_periods(requests: DataFrame, changes: DataFrame, order: list[str], slice_by: Column) -> DataFrame:
    """Number the tier changes before each request; a change starts a new count.

    ``requests`` and ``changes`` share ``user_id`` and the order columns.
    """
    both = requests.withColumn("_change", F.lit(0)).unionByName(
        changes.select("user_id", *order).withColumn("_change", F.lit(1)), allowMissingColumns=True)
    counted = running(both, ["user_id"], order, slice_by, {"period": F.col("_change")})
    return counted.where("_change = 0").drop("_change")


def quota_decisions(requests: DataFrame, order: list[str]) -> DataFrame:
    """Admit or deny every request of the free tier per user, UTC day and type.

    ``requests(user_id, tier, limit_type, ts, ...)`` with an optional
    ``period``. Only the first few requests of a group are ranked; every other
    one is compared with the last admitted one, so a hot user-day is joined,
    not sorted in one task.
    """
    keys = ["user_id", "day", "limit_type"] + (["period"] if "period" in requests.columns else [])
    rows = requests.withColumns({
        "limit_type": F.lower(tx.strip("limit_type")), "day": F.to_date("ts"),
    }).withColumn("_limit", F.when(F.lower(tx.strip(F.coalesce("tier", F.lit("free")))) == "free",
                                   quota_limit(F.col("limit_type"))))
    counted = rows.where(F.col("_limit").isNotNull())
    most = max(FREE_LIMITS.values())
    admitted = top_k(counted, keys, [F.asc(c) for c in order], most, "_r").where(F.col("_r") <= F.col("_limit"))
    last = admitted.groupBy(*keys).agg(F.max(F.struct(*order)).alias("_last"))
    decided = join_keys(counted, last, keys).withColumn(
        "decision", F.when(F.struct(*order) <= F.col("_last"), "allowed").otherwise("denied")).drop("_last")
    free_pass = rows.where(F.col("_limit").isNull()).withColumn("decision", F.lit("uncounted"))
    return decided.unionByName(free_pass).drop("_limit")


def exhaustions(decisions: DataFrame) -> DataFrame:
    return decisions.where("decision = 'denied'").groupBy("user_id", "limit_type").agg(F.count("*").alias("hits"))


def remaining(decisions: DataFrame, keys: list[str]) -> DataFrame:
    """Used and remaining requests per group and limit type."""
    used = decisions.groupBy(*keys, "tier", "limit_type").agg(F.count_if(F.col("decision") == "allowed").alias("used"))
    limit = quota_limit(F.col("limit_type"))
    return used.where(limit.isNotNull()).withColumns({
        "quota": limit,
        "remaining": F.when(F.lower("tier") == "free", F.greatest(F.lit(0), limit - F.col("used"))).otherwise(UNLIMITED)})


def feature_gate(feature: Column, tier: Column) -> Column:
    """Reason a request is refused, null when it may run."""
    premium = F.lower(tx.strip(F.coalesce(tier, F.lit("free")))) == "premium"
    return F.when(feature.isin("library_ask", "mentor", "mock_test") & ~premium, "premium_only")


def provider_totals(calls: DataFrame) -> DataFrame:
    """``calls(provider, ok, latency, ts)`` to counters per provider."""
    return calls.groupBy("provider").agg(
        F.count_if("ok").alias("successes"), F.count_if(~F.col("ok")).alias("failures"),
        F.sum(F.when(F.col("ok"), F.col("latency"))).alias("total_latency"),
        F.max(F.when(~F.col("ok"), F.col("ts"))).alias("last_failure"))


def provider_health(totals: DataFrame, as_of: Column, cooldown: float = 60.0) -> DataFrame:
    """Health between 0.1 and 1 at a given moment."""
    since = (F.unix_micros(as_of) - F.unix_micros(F.col("last_failure").cast("timestamp"))) / 1e6
    calls = F.col("successes") + F.col("failures")
    latency = F.col("total_latency") / F.nullif(F.col("successes"), F.lit(0))
    slow = F.when(latency > 5.0, F.least(F.lit(0.2), (latency - 5.0) * 0.04)).otherwise(0.0)
    score = F.when((since >= 0) & (since < cooldown), F.greatest(F.lit(0.1), since / cooldown)).when(
        calls == 0, 1.0).otherwise(F.greatest(F.lit(0.1), 1.0 - F.col("failures") / calls * 0.8 - slow))
    return totals.withColumn("health", score)


def call_gaps(calls: DataFrame, key: str, order: list[str], slice_by: Column, floor: float = 0.5) -> DataFrame:
    """Seconds since the previous call of a key, and whether that is too soon."""
    prior = last_before(calls, [key], order, slice_by, {"_before": F.unix_micros(F.col("ts").cast("timestamp"))})
    gap = (F.unix_micros(F.col("ts").cast("timestamp")) - F.col("_before")) / 1e6
    return prior.withColumn("gap_seconds", gap).withColumn("too_soon", F.coalesce(gap < floor, F.lit(False))).drop("_before")


def confidence_swings(scores: DataFrame, key: str, order: list[str], slice_by: Column, limit: float = 0.4) -> DataFrame:
    """Change against the previous score of a key and whether it is unstable."""
    prior = last_before(scores, [key], order, slice_by, {"previous": F.col("score")})
    delta = F.abs(F.col("score") - F.col("previous"))
    return prior.withColumn("delta", delta).withColumn("unstable", F.coalesce(delta > limit, F.lit(False)))


def resolve_tenants(keys: DataFrame, documents: DataFrame, users: DataFrame) -> DataFrame:
    """User and tier behind a key: ``userlib:<user>``, a document id or a user id.

    The lookup of the last two starts from the same string, so each is one
    left join; precedence is applied afterwards.
    """
    base = keys.withColumn("_uid", F.when(F.col("key").startswith("userlib:"), F.substring("key", 9, 1_000_000)))
    docs = documents.select(F.col("doc_id").cast("string").alias("key"), F.col("user_id").cast("string").alias("_owner"))
    people = users.select(F.col("user_id").cast("string").alias("_id"), F.lower(tx.strip("tier")).alias("_tier"))
    named = base.join(docs, "key", "left").join(
        people.select(F.col("_id").alias("key"), F.lit(True).alias("_is_user")), "key", "left")
    resolved = named.withColumn("user_id", F.when(F.coalesce("key", F.lit("")) == "", "default_user").otherwise(
        F.coalesce("_uid", "_owner", F.col("key"))))
    tiers = resolved.join(people, resolved["user_id"] == people["_id"], "left")
    return tiers.withColumn("tier", F.coalesce(F.nullif("_tier", F.lit("")), F.lit("free"))).drop(
        "_uid", "_owner", "_id", "_tier", "_is_user")
