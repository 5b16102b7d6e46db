"""Usage metering, reconciliation, billing and service levels (O-MT-01..11)."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weatherlake.operators.windows import running

# Bookkeeping actions that are never billed.
INTERNAL_ACTIONS = (
    "metering.rollup",
    "metering.suspend",
    "metering.unsuspend",
    "metering.s1",
    "metering.block_invoice",
    "metering.cleared",
    "feed.connect",
    "feed.disconnect",
    "trial.started",
    "trial.expiring",
    "trial.expired",
    "trial.converted",
    "trial.denied",
    "billing.subscription_created",
    "billing.subscription_removed",
    "billing.tier_upgrade",
    "billing.tier_downgrade",
    "onboarding.tenant_provisioned",
)
# Error classes that are never billed.
NEVER_BILLED = ("4xx incl 429", "5xx", "503")
TOLERANCE, HARD_LIMIT = 1.0, 10.0  # Fixed values: per cent of drift.
# Severity keywords, the first matching severity wins.
SEVERITY_KEYWORDS = {
    "S1": ("down", "outage", "unavailable", "data integrity", "corrupt", "breach", "suspended", "incident"),
    "S2": ("degraded", "blocking", "bug", "error", "slow", "timeout", "fail"),
    "S3": ("question", "minor", "typo", "docs", "feature", "request", "how", "why"),
}


def _tenant(default: str) -> Column:
    return F.coalesce("tenant_id", F.lit(default))


def api_calls(
    audit: DataFrame, start: str, end: str, default: str = "internal", excluded: Sequence[str] = (*INTERNAL_ACTIONS, *NEVER_BILLED)
) -> DataFrame:
    """Billable calls and all chain events per tenant in [start, end)."""
    x = audit.filter((F.col("ts") >= F.lit(start).cast("timestamp")) & (F.col("ts") < F.lit(end).cast("timestamp")))
    calls = F.count_if(~F.coalesce(F.col("action").isin(*excluded), F.lit(False)))
    return x.groupBy(_tenant(default).alias("tenant_id")).agg(calls.alias("api_calls"), F.count("*").alias("chain_events"))


def feed_sessions(
    events: DataFrame, keys: Sequence[str], tie: str, connect: str = "feed.connect", disconnect: str = "feed.disconnect"
) -> DataFrame:
    """First-in first-out connect/disconnect pairs per key, ignoring disconnects with nothing open.

    The open count is a walk of +1 / -1 steps that cannot fall under zero. With S its free sum and M the
    running minimum of S, max(0, -M) disconnects have been ignored so far, so the matched number of a
    disconnect is (disconnects so far) - max(0, -M); an ignored one repeats the number before it. Two
    range scans and an equality join on the number replace the per-session queue.
    """
    up = F.col("action") == connect
    x = events.filter(F.col("action").isin(connect, disconnect)).select(*keys, "ts", tie, "action")
    order = ["ts", tie]
    x = running(
        x,
        keys,
        order,
        {
            "_s": ("sum", F.when(up, 1).otherwise(-1)),
            "_c": ("sum", F.when(up, 1).otherwise(0)),
            "_d": ("sum", F.when(up, 0).otherwise(1)),
        },
        keep_ranges=True,
    )
    x = running(x, keys, order, {"_m": ("min", F.col("_s"))}, ranged=True)
    opened = x.filter(up).select(*keys, F.col("_c").alias("n"), F.col("ts").alias("connected"))
    number = F.col("_d") - F.greatest(-F.col("_m"), F.lit(0))
    closed = (
        x.filter(~up).withColumn("n", number).filter("n >= 1").groupBy(*keys, "n").agg(F.min("ts").alias("disconnected"))
    )
    return opened.join(closed, [*keys, "n"])


def _overlap_hours(a: Column, b: Column, start: str, end: str) -> Column:
    lo = F.greatest(a, F.lit(start).cast("timestamp"))
    hi = F.least(b, F.lit(end).cast("timestamp"))
    return (F.unix_micros(hi) - F.unix_micros(lo)) / 3.6e9


def feed_hours(sessions: DataFrame, start: str, end: str, default: str = "internal") -> DataFrame:
    """Whole hours of each session inside the period; sessions under one hour count nothing."""
    h = F.floor(F.greatest(_overlap_hours(F.col("connected"), F.col("disconnected"), start, end), F.lit(0.0)))
    g = sessions.groupBy(_tenant(default).alias("tenant_id")).agg(F.sum(h).cast("double").alias("feed_hours"))
    return g.filter("feed_hours > 0")


def backtest_hours(jobs: DataFrame, start: str, end: str, default: str = "internal") -> DataFrame:
    h = _overlap_hours(F.col("started_at"), F.col("finished_at"), start, end)
    x = jobs.filter((F.col("status") == "done") & (F.col("finished_at") > F.col("started_at"))).withColumn("_h", h)
    return x.filter("_h > 0").groupBy(_tenant(default).alias("tenant_id")).agg(F.sum("_h").alias("backtest_hours"))


def usage(calls: DataFrame, feeds: DataFrame, backs: DataFrame, tenants: DataFrame) -> DataFrame:
    """Outer combination of the three meters with the tenant's tier (free when unknown)."""
    billed = calls.filter("api_calls > 0").select("tenant_id", "api_calls")
    chain = calls.select("tenant_id", "chain_events")
    j = billed.join(feeds, "tenant_id", "full").join(backs, "tenant_id", "full").join(chain, "tenant_id", "left")
    return j.join(tenants.select("tenant_id", "tier"), "tenant_id", "left").select(
        "tenant_id",
        F.coalesce("tier", F.lit("free")).alias("tier"),
        F.coalesce("api_calls", F.lit(0)).alias("api_calls"),
        F.round(F.coalesce("feed_hours", F.lit(0.0)), 3).alias("feed_hours"),
        F.round(F.coalesce("backtest_hours", F.lit(0.0)), 3).alias("backtest_hours"),
        F.coalesce("chain_events", F.lit(0)).alias("chain_events"),
    )


def reconcile(chain: DataFrame, rollup: DataFrame, log: DataFrame) -> DataFrame:
    """Chain recount against meter and access log: drift per cent, state and actions per tenant.

    Inputs have one row per tenant: (tenant_id, chain_calls), (tenant_id, rollup_calls), (tenant_id, log_calls).
    """
    j = chain.join(log, "tenant_id", "full").join(rollup, "tenant_id", "left").fillna(0, ["chain_calls", "rollup_calls", "log_calls"])
    c, lg = F.col("chain_calls"), F.col("log_calls")
    pct = F.when(c != 0, F.round(F.abs(c - lg) / c * 100.0, 4))
    j = j.withColumns({"chain_ok": F.col("rollup_calls") == c, "log_drift_percent": pct})
    p = F.col("log_drift_percent")
    mismatch = F.when(p.isNull() | (p > TOLERANCE), "extreme").otherwise("drift")
    plain = (
        F.when(c == 0, F.when(lg > 0, "extreme").otherwise("normal"))
        .when(p > HARD_LIMIT, "extreme")
        .when(p > TOLERANCE, "drift")
        .otherwise("normal")
    )
    acts = F.array_compact(F.array(F.when(~F.col("chain_ok"), "rollup-mismatch"), F.when(p > TOLERANCE, "log-drift")))
    return j.withColumns({"state": F.when(F.col("chain_ok"), plain).otherwise(mismatch), "actions": acts})


def drift_actions(reports: DataFrame, blocks: DataFrame, suspensions: DataFrame, keys: DataFrame) -> DataFrame:
    """Actions to take as rows (tenant_id, action, target); nothing is mutated.

    Normal tenants: clear open invoice blocks, lift open suspensions and restore exactly the keys revoked
    at the suspension's own time. Drift: incident and block. Extreme: also suspend and revoke live keys,
    unless a suspension is already open or no key is live.
    """
    open_blocks = blocks.filter(F.col("cleared_at").isNull()).select("tenant_id", "block_id")
    open_susp = suspensions.filter(F.col("lifted_at").isNull()).select("tenant_id", "suspension_id", "suspended_at", "key_ids")
    live = keys.filter(F.col("revoked_at").isNull()).select("tenant_id", "key_id")
    normal, bad, extreme = (
        reports.filter(c).select("tenant_id")
        for c in ("state = 'normal'", "state <> 'normal'", "state = 'extreme'")
    )

    def rows(df: DataFrame, action: str, target: Column) -> DataFrame:
        return df.select("tenant_id", F.lit(action).alias("action"), target.cast("string").alias("target"))

    none = F.lit(None)
    lifted = normal.join(open_susp, "tenant_id")
    revoked = lifted.select("tenant_id", "suspended_at", F.explode("key_ids").alias("key_id")).join(
        keys.select("tenant_id", "key_id", "revoked_at"), ["tenant_id", "key_id"]
    )
    to_suspend = extreme.join(open_susp, "tenant_id", "left_anti").join(live, "tenant_id", "left_semi")
    out = rows(normal.join(open_blocks, "tenant_id"), "clear_block", F.col("block_id"))
    for part in (
        rows(lifted, "lift_suspension", F.col("suspension_id")),
        rows(revoked.filter(F.col("revoked_at") == F.col("suspended_at")), "restore_key", F.col("key_id")),
        rows(bad, "incident", none),
        rows(bad, "block_invoice", none),
        rows(to_suspend, "suspend", none),
        rows(to_suspend.join(live, "tenant_id"), "revoke_key", F.col("key_id")),
    ):
        out = out.unionByName(part)
    return out


def usage_batches(metered: DataFrame, tenants: DataFrame, day: str) -> DataFrame:
    """Daily billing rows: zero quantities and free tenants without an item are left out; paid ones stay NULL."""
    q = F.col("api_calls") + F.floor(F.col("feed_hours") * 1000) + F.floor(F.col("backtest_hours") * 1000)
    item = tenants.select("tenant_id", F.nullif("subscription_item", F.lit("")).alias("subscription_item"), F.col("tier").alias("_tier"))
    j = metered.join(item, "tenant_id").withColumn("quantity", q.cast("long")).filter("quantity > 0")
    j = j.filter(F.col("subscription_item").isNotNull() | (F.col("_tier") != "free"))
    batch = F.concat(F.lit(f"usage-{day}-"), F.col("tenant_id"))
    return j.select(batch.alias("batch_id"), "tenant_id", "tier", "subscription_item", F.lit(day).alias("period"), "quantity")


def sync_stale(syncs: DataFrame, audit: DataFrame, jobs: DataFrame, tenants: DataFrame, asof: Column, max_hours: int = 24) -> DataFrame:
    """One row: last successful sync and whether it is too old; without one, any paid activity is stale."""
    paid = tenants.filter("tier <> 'free'").select("tenant_id")
    feed = F.col("action").isin("feed.connect", "feed.disconnect")
    active = audit.filter(~F.col("action").isin(*INTERNAL_ACTIONS) | feed).select("tenant_id")
    done = jobs.filter("status = 'done'").select("tenant_id")
    n = active.unionByName(done).join(paid, "tenant_id", "left_semi").limit(1).agg(F.count("*").alias("_active"))
    last = syncs.filter("status = 'submitted'").agg(F.max("submitted_at").alias("last_sync"))
    age = (F.unix_micros(asof) - F.unix_micros("last_sync")) / 3.6e9
    one = last.unionByName(n, allowMissingColumns=True).agg(
        F.max("last_sync").alias("last_sync"), F.max("_active").alias("_active")
    )
    return one.select(
        "last_sync", F.when(F.col("last_sync").isNull(), F.col("_active") > 0).otherwise(age > max_hours).alias("stale")
    )


def trial_states(tenants: DataFrame, trials: DataFrame, asof: Column) -> DataFrame:
    """State and days left per tenant; tenants without a trial are ``none``."""
    t = trials.select("tenant_id", "expires_at", "converted_at", "downgraded_at", F.lit(True).alias("_trial"))
    j = tenants.select("tenant_id", F.coalesce("tier", F.lit("free")).alias("tier")).join(t, "tenant_id", "left")
    state = (
        F.when(F.col("_trial").isNull(), "none")
        .when(F.col("converted_at").isNotNull(), "converted")
        .when(F.col("downgraded_at").isNotNull(), "downgraded")
        .when(asof >= F.col("expires_at"), "expired")
        .otherwise("active")
    )
    days = F.floor((F.unix_micros("expires_at") - F.unix_micros(asof)) / 8.64e10)
    return j.select("tenant_id", "tier", state.alias("state"), F.greatest(days, F.lit(0)).alias("days_left"))


def trial_work(tenants: DataFrame, trials: DataFrame, outbox: DataFrame, asof: Column, notice_days: int = 2) -> DataFrame:
    """Due trials with their outcome, and expiring ones whose notice is not queued yet."""
    live = trials.filter(F.col("converted_at").isNull() & F.col("downgraded_at").isNull())
    outcome = F.when(F.col("tier") == F.col("tier_at_trial"), "downgraded_to_free").otherwise("kept_paid_tier")
    due = live.filter(F.col("expires_at") <= asof).join(tenants, "tenant_id").select("tenant_id", outcome.alias("work"))
    soon = live.filter((F.col("expires_at") > asof) & (F.col("expires_at") <= asof + F.make_dt_interval(days=F.lit(notice_days))))
    told = outbox.filter("kind = 'trial.expiring'").select("tenant_id")
    return due.unionByName(soon.join(told, "tenant_id", "left_anti").select("tenant_id", F.lit("notify_expiring").alias("work")))


def severity(text: Column, default: str = "S3") -> Column:
    """First severity with a whole-word keyword in the text."""
    low = F.lower(text)
    out = None
    for name, words in SEVERITY_KEYWORDS.items():
        # plain substring tests are far cheaper than the regex, which only settles word boundaries
        some = reduce(lambda a, b: a | b, [low.contains(w) for w in words])
        hit = some & low.rlike(r"(?U)\b(" + "|".join(words) + r")\b")
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(default)


def error_budget(log: DataFrame, keys: Sequence[Column | str], target: float = 0.999) -> DataFrame:
    """Remaining share of the error budget; deliberate fail-closed responses do not spend it."""
    bad = (F.col("status") >= 500) & ~F.coalesce("fail_closed", F.lit(False))
    g = log.groupBy(*keys).agg(
        F.count("*").alias("observed_requests"),
        F.count_if(bad).alias("real_5xx"),
        F.count_if((F.col("status") >= 500) & F.col("fail_closed")).alias("fail_closed_5xx"),
    )
    left = F.greatest(F.lit(1.0) - F.col("real_5xx") / F.col("observed_requests") / F.lit(1 - target), F.lit(0.0))
    return g.withColumn("remaining_fraction", left)
