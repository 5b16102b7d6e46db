"""Point-in-time research: calendars, rolls, episodes, ledgers and leakage checks (O-PIT-01..17).

Cycles and sessions are daily frames per key (instrument or site), so windows over a key are bounded by
the calendar. Raw forecast cells are reduced to one row per cycle before they get here. Leakage
violations and rejects are rows with a reason, never exceptions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weatherlake.operators.asof import asof
from weatherlake.operators.ranks import exact_quantiles

COST = 0.0030  # Fixed value: 30 bps round trip.
EMBARGO = 5
HOLD = 2
Fold = tuple[str, str, str]  # name, first day, last day


def _d(x: str) -> Column:
    return F.lit(x).cast("date")


def session_calendar(prices: DataFrame, keys: Sequence[str], session: str = "session", close: str = "close") -> DataFrame:
    """Sessions with position and the next closes and sessions, per key."""
    w = Window.partitionBy(*keys).orderBy(session)
    return prices.filter(F.col(close).isNotNull()).select(
        *keys,
        F.col(session).alias("session"),
        F.col(close).alias("close"),
        (F.row_number().over(w) - 1).alias("pos"),
        F.lead(close, 1).over(w).alias("next_close"),
        F.lead(close, 2).over(w).alias("next2_close"),
        F.lead(session, HOLD).over(w).alias("exit_session"),
    )


def fill_session(cycles: DataFrame, calendar: DataFrame, keys: Sequence[str], columns: Sequence[str] = ("session",)) -> DataFrame:
    """First session on or after each cycle date (NULL when there is none)."""
    return asof(cycles, calendar, keys, F.col("date"), F.col("session"), columns, forward=True)


def realised_close(cycles: DataFrame, calendar: DataFrame, keys: Sequence[str], max_days: int = 7) -> DataFrame:
    """Last close on or before each cycle date, with its age; older than ``max_days`` is marked stale."""
    right = calendar.select(*keys, F.col("session").alias("close_date"), F.col("close").alias("realised"))
    j = asof(cycles, right, keys, F.col("date"), F.col("close_date"), ["close_date", "realised"])
    age = F.datediff("date", "close_date")
    status = F.when(F.col("close_date").isNull(), "missing").when(age > max_days, "stale").otherwise("ok")
    return j.withColumn("stale_days", age).withColumn("close_status", status)


def build_pit(features: DataFrame, calendar: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cycle features with the fill close and one- and two-session outcomes.

    Cycles without a fill session or without any later session are left out, as in the source data.
    """
    j = fill_session(features, calendar, keys, ["session", "pos", "close", "next_close", "next2_close", "exit_session"])
    return j.filter(F.col("next_close").isNotNull()).withColumns(
        {
            "fwd_return": F.col("next_close") / F.col("close") - 1,
            "fwd2_return": F.col("next2_close") / F.col("close") - 1,
        }
    )


# Contract rolls.


def front_month(
    sessions: DataFrame, contracts: DataFrame, keys: Sequence[str], trigger: str, rule: str = "FND"
) -> DataFrame:
    """Active contract per session: first trigger after the day (LTD: on or after), else the last one."""
    at = F.date_sub(trigger, 1) if rule == "FND" else F.col(trigger)
    j = asof(sessions, contracts, keys, F.col("session"), at, ["month_name"], forward=True)
    last = contracts.groupBy(*keys).agg(F.max_by("month_name", trigger).alias("_last"))
    return j.join(last, list(keys), "left").withColumn("contract_month", F.coalesce("month_name", "_last")).drop(
        "month_name", "_last"
    )


def _with_sigma(prices: DataFrame, keys: Sequence[str], close: str, window: int = 30) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("session")
    r = F.col(close) / F.lag(close).over(w) - 1
    x = prices.withColumn("_ret", r)
    f = w.rowsBetween(-(window - 1), 0)
    s = F.when(F.count("_ret").over(f) >= 10, F.stddev_samp("_ret").over(f))
    x = x.withColumn("_s", s)
    return x.withColumns({"_sigma": F.lag("_s").over(w), "_prev": F.lag(close).over(w)}).drop("_s")


def roll_table(
    prices: DataFrame, contracts: DataFrame, keys: Sequence[str], trigger: str, close: str = "close", n_sigma: float = 5.0
) -> DataFrame:
    """Gap of every contract roll that falls on a session, flagged when it exceeds n sigma."""
    w = Window.partitionBy(*keys).orderBy(trigger)
    c = contracts.select(
        *keys,
        F.col(trigger).alias("session"),
        F.coalesce(F.lag("month_name").over(w), F.lit("")).alias("contract_from"),
        F.col("month_name").alias("contract_to"),
    )
    x = _with_sigma(prices, keys, close).filter(F.col("_prev").isNotNull())
    j = x.join(c, [*keys, "session"])
    gap = F.when(F.col("_prev") != 0, F.col(close) / F.col("_prev")).otherwise(1.0)
    limit = F.when(F.col("_sigma") > 1e-6, F.col("_sigma") * n_sigma + 1).otherwise(1.5)
    flagged = (gap >= limit) | (gap <= 1 / limit)
    return j.select(
        *keys,
        F.col("session").alias("roll_date"),
        "contract_from",
        "contract_to",
        F.when(flagged, "none").otherwise("back").alias("adjustment_type"),
        gap.alias("factor"),
        flagged.alias("flagged"),
        F.when(flagged, F.lit(f"gap>{n_sigma}x daily sigma")).otherwise("").alias("flag_reason"),
    )


def back_adjust(prices: DataFrame, rolls: DataFrame, keys: Sequence[str], close: str = "close") -> DataFrame:
    """Continuous series: closes before an unflagged roll are multiplied by its gap.

    A gap depends on raw closes only, so the factor of a row is the product of all later gaps.
    """
    f = rolls.filter(~F.col("flagged")).select(*keys, F.col("roll_date").alias("session"), F.col("factor").alias("_g"))
    # newest first: a growing frame costs linear time, a shrinking one quadratic
    w = Window.partitionBy(*keys).orderBy(F.col("session").desc()).rowsBetween(Window.unboundedPreceding, -1)
    x = prices.join(f, [*keys, "session"], "left").withColumn("_g", F.coalesce("_g", F.lit(1.0)))
    x = x.withColumn("adjustment_factor", F.coalesce(F.product("_g").over(w), F.lit(1.0)))
    return x.withColumn("close_adj", F.col(close) * F.col("adjustment_factor")).drop("_g")


def roll_jumps(
    prices: DataFrame,
    roll_dates: DataFrame,
    keys: Sequence[str],
    close: str = "close",
    n_sigma: float = 5.0,
    days: int = 3,
) -> DataFrame:
    """Extreme returns within ``days`` of a roll: each roll yields its few dates, joined by equality."""
    near = F.explode(F.sequence(F.date_sub("roll_date", days), F.date_add("roll_date", days)))
    c = roll_dates.select(*keys, F.col("roll_date").alias("near_roll"), F.col("roll_date")).withColumn("session", near)
    x = _with_sigma(prices, keys, close).join(c.drop("roll_date"), [*keys, "session"])
    limit = F.when(F.col("_sigma") > 1e-6, F.col("_sigma") * n_sigma).otherwise(1.5)
    return x.filter(F.abs("_ret") >= limit).select(
        *keys,
        "session",
        F.col("_ret").alias("return"),
        F.col("_sigma").alias("daily_sigma"),
        F.try_divide(F.abs("_ret"), F.col("_sigma")).alias("ratio"),
        "near_roll",
    )


# Episodes and schedules.


def episodes(pit: DataFrame, calendar: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Freeze rows joined while their fill positions are at most two apart.

    Rows without a fill session start alone and break the chain; other rows have episode 0.
    """
    x = pit if "pos" in pit.columns else fill_session(pit, calendar, keys, ["session", "pos"])
    w = Window.partitionBy(*keys).orderBy("date")
    freeze = F.coalesce(F.col("freeze_prob") > 0, F.lit(False))
    x = x.withColumn("is_freeze", freeze)
    seen = F.when(F.col("is_freeze"), F.struct(F.col("pos").alias("p")))
    prev = F.last(seen, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    x = x.withColumn("_prev", prev["p"])
    joined = F.coalesce(F.col("pos") - F.col("_prev") <= HOLD, F.lit(False))
    x = x.withColumn("episode_start", F.col("is_freeze") & ~joined)
    n = F.sum(F.col("episode_start").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return x.withColumn("episode_id", F.when(F.col("is_freeze"), n).otherwise(0)).drop("_prev")


def episode_summary(ep: DataFrame, keys: Sequence[str]) -> DataFrame:
    return (
        ep.filter(F.col("episode_id") > 0)
        .groupBy(*keys, "episode_id")
        .agg(
            F.min("date").alias("start_date"),
            F.count("*").alias("n_rows"),
            F.count_if("is_freeze").alias("n_freezing"),
            F.max("freeze_prob").alias("entry_freeze_prob"),
        )
    )


def fold_label(day: Column, folds: Sequence[Fold], outside: str = "seed") -> Column:
    """Fold name of a day; folds are a short fixed list, so no join is needed."""
    out = F.lit(outside)
    for name, first, last in reversed(folds):
        out = F.when(day.between(_d(first), _d(last)), name).otherwise(out)
    return out


def fold_thresholds(pit: DataFrame, keys: Sequence[str], folds: Sequence[tuple[str, str]]) -> DataFrame:
    """Median positive freeze_prob of all rows up to each fold's training end (fold, train_end)."""
    ends = F.array(*[F.struct(F.lit(n).alias("fold"), _d(e).alias("train_end")) for n, e in folds])
    x = pit.filter(F.col("freeze_prob") > 0).select(*keys, "date", "freeze_prob", F.inline(ends))
    x = x.filter(F.col("date") <= F.col("train_end"))
    return exact_quantiles(x, [*keys, "fold", "train_end"], "freeze_prob", {"theta_p": 0.5})


def firing(pit: DataFrame, thresholds: DataFrame, keys: Sequence[str], folds: Sequence[Fold], theta_t: float = 0.0) -> DataFrame:
    """Add ``fold`` and ``candidate_fire``: p >= theta_p and T <= theta_t; without history nothing fires."""
    x = pit.withColumn("fold", fold_label(F.col("date"), folds))
    j = x.join(thresholds.select(*keys, "fold", "theta_p"), [*keys, "fold"], "left")
    fire = (F.col("freeze_prob") >= F.col("theta_p")) & (F.col("temperature_min") <= theta_t)
    return j.withColumn("candidate_fire", F.coalesce(fire, F.lit(False)))


def candidate_entries(ep: DataFrame, keys: Sequence[str]) -> DataFrame:
    """First firing row of every episode."""
    w = Window.partitionBy(*keys, "episode_id").orderBy("date")
    x = ep.filter((F.col("episode_id") > 0) & F.col("candidate_fire"))
    return x.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") == 1).drop("_n")


def hold_schedule(entries: DataFrame, calendar: DataFrame, keys: Sequence[str], hold: int = HOLD) -> DataFrame:
    """Position 1.0 on every session held after an entry (overlaps merge), 0.0 elsewhere."""
    held = (
        entries.filter(F.col("pos").isNotNull())
        .select(*keys, F.explode(F.sequence(F.col("pos"), F.col("pos") + (hold - 1))).alias("pos"))
        .distinct()
        .withColumn("_h", F.lit(1.0))
    )
    return calendar.join(held, [*keys, "pos"], "left").withColumn("position", F.coalesce("_h", F.lit(0.0))).drop("_h")


def cycle_id(date: Column, cycle: Column) -> Column:
    return F.concat(F.date_format(date, "yyyyMMdd"), F.lit("_"), F.lpad(cycle.cast("string"), 2, "0"), F.lit("z"))


def provenance(
    starts: DataFrame, rolls: DataFrame, keys: Sequence[str], model: str, archive: str, hold: int = HOLD, rule: str = "FND"
) -> DataFrame:
    """Provenance struct per held session; where holds overlap the later episode wins.

    ``rolls`` has one row per session with contract_month and adjustment_factor (entry session's state).
    """
    s = starts.filter(F.col("pos").isNotNull()).join(
        rolls.select(*keys, "session", "contract_month", "adjustment_factor"), [*keys, "session"], "left"
    )
    p = F.struct(
        cycle_id(F.col("date"), F.col("cycle")).alias("forecast_cycle_id"),
        F.col("publish_time").alias("publication_ts"),
        F.lit(model).alias("model_version"),
        F.lit(archive).alias("archive"),
        F.struct(
            "contract_month",
            "adjustment_factor",
            F.lit("back").alias("adjustment_type"),
            F.lit(rule).alias("roll_rule"),
        ).alias("roll_state"),
    )
    held = F.sequence(F.col("pos"), F.col("pos") + (hold - 1))
    each = s.select(*keys, "date", p.alias("provenance"), held.alias("_held")).withColumn("pos", F.explode("_held"))
    return each.groupBy(*keys, "pos").agg(F.max_by("provenance", "date").alias("provenance"))


def embargoed_sessions(calendar: DataFrame, keys: Sequence[str], folds: Sequence[Fold]) -> DataFrame:
    """First sessions of every test fold."""
    x = calendar.withColumn("_fold", fold_label(F.col("session"), folds)).filter(F.col("_fold") != "seed")
    w = Window.partitionBy(*keys, "_fold").orderBy("session")
    return x.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= EMBARGO).select(*keys, "session")


def event_ledger(
    entries: DataFrame,
    calendar: DataFrame,
    benchmark: DataFrame,
    keys: Sequence[str],
    folds: Sequence[Fold],
    cost: float = COST,
) -> DataFrame:
    """One scored event per entry: gross, net and net-of-benchmark returns with fold and fill facts.

    ``entries`` carry the PIT columns; ``benchmark`` has one ``benchmark`` value per key. Entries
    without a fill session are left out.
    """
    emb = embargoed_sessions(calendar, keys, folds).withColumn("embargoed", F.lit(True))
    x = entries.filter(F.col("session").isNotNull()).join(benchmark, list(keys), "left").join(
        emb, [*keys, "session"], "left"
    )
    in_oos = F.col("date").between(_d(folds[0][1]), _d(folds[-1][2]))
    gross = F.col("fwd2_return")
    out = x.select(
        *keys,
        "episode_id",
        F.col("date").alias("entry_cycle"),
        F.col("session").alias("entry_session"),
        "exit_session",
        gross.alias("gross"),
        (gross - cost).alias("net"),
        (gross - cost - F.col("benchmark")).alias("net_of_benchmark"),
        fold_label(F.col("date"), folds).alias("fold"),
        in_oos.alias("in_oos"),
        F.coalesce("embargoed", F.lit(False)).alias("embargoed"),
        (F.weekday("date") >= 5).alias("entry_weekend"),
        (F.col("session") > F.col("date")).alias("next_close_fill"),
        F.datediff("session", "date").alias("fill_days_after_cycle"),
        F.col("freeze_prob").alias("entry_freeze_prob"),
        F.col("temperature_min").alias("entry_temperature_min"),
    )
    return out.withColumn("scored", F.col("in_oos") & ~F.col("embargoed"))


def cross_validate(ledger: DataFrame, trades: DataFrame, calendar: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Engine trades against the ledger by entry session: errors, price mismatches, unmatched events."""
    px = calendar.select(*keys, F.col("session"), F.col("close"))
    e = ledger.filter(F.col("in_oos"))
    t = trades.select(
        *keys, F.col("entry_time").alias("entry_session"), F.col("return").alias("_r"), "entry_price", "exit_price"
    )
    x = (
        e.join(t, [*keys, "entry_session"], "left")
        .join(px.withColumnsRenamed({"session": "entry_session", "close": "_pe"}), [*keys, "entry_session"], "left")
        .join(px.withColumnsRenamed({"session": "exit_session", "close": "_px"}), [*keys, "exit_session"], "left")
    )
    usable = F.col("exit_session").isNotNull()
    hit = usable & F.col("_r").isNotNull()
    wrong = hit & ((F.col("entry_price") != F.col("_pe")) | (F.col("exit_price") != F.col("_px")))
    return x.groupBy(*keys).agg(
        F.count_if(hit).alias("matched_trades"),
        F.count("*").alias("n_oos_events"),
        F.count_if(usable & F.col("_r").isNull()).alias("unmatched_events"),
        F.coalesce(F.max(F.when(hit, F.abs(F.col("_r") - F.col("gross")))), F.lit(0.0)).alias("max_return_abs_error"),
        F.count_if(wrong).alias("price_mismatches"),
    )


# Leakage checks.


def decision_cutoff(session: Column, hour: int = 14, zone: str = "America/New_York") -> Column:
    """UTC instant of the local decision time on a session day."""
    return F.to_utc_timestamp(session.cast("timestamp") + F.make_dt_interval(hours=F.lit(hour)), zone)


def timestamp_violations(pit: DataFrame, horizon_hours: int = 48) -> DataFrame:
    """Rows with their publish margin and reasons: published after cutoff, peak outside the horizon."""
    end = F.col("publish_time") + F.make_dt_interval(hours=F.lit(horizon_hours))
    margin = (F.unix_micros(decision_cutoff(F.col("session"))) - F.unix_micros("publish_time")) / 3.6e9
    late = F.when(margin < 0, "publish_after_cutoff")
    peak = F.col("event_peak_time")
    off = F.when((peak < F.col("publish_time")) | (peak > end), "peak_outside_horizon")
    return pit.filter(F.col("session").isNotNull()).withColumns(
        {"margin_hours": margin, "reasons": F.array_compact(F.array(late, off))}
    )


def timestamp_report(violations: DataFrame, keys: Sequence[str]) -> DataFrame:
    def has(reason: str) -> Column:
        return F.count_if(F.array_contains("reasons", reason))
    return violations.groupBy(*keys).agg(
        F.count("*").alias("n_rows"),
        has("publish_after_cutoff").alias("publish_after_cutoff"),
        has("peak_outside_horizon").alias("event_peak_outside_horizon"),
        F.min("margin_hours").alias("min_publish_margin_hours"),
    )


def signal_lookahead(signals: DataFrame) -> DataFrame:
    """Signals (session, ts, forecast_cycle_id, publication_ts) that use information from after the session."""
    cyc = F.to_date(F.split_part("forecast_cycle_id", F.lit("_"), F.lit(1)), "yyyyMMdd")
    reasons = F.array_compact(
        F.array(
            F.when(F.col("ts") > F.col("session").cast("timestamp"), "future_timestamp"),
            F.when(cyc > F.col("session"), "future_cycle"),
            F.when(F.col("publication_ts") > decision_cutoff(F.col("session")), "published_after_cutoff"),
        )
    )
    return signals.withColumn("reasons", reasons).filter(F.size("reasons") > 0)


def vintage_manifest(files: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Digest per cycle of a ``binaryFile`` frame (path, length, content plus keys).

    Each file is hashed where it is read; only digests are gathered, in path order.
    """
    f = files.select(*keys, "path", "length", F.sha2("content", 256).alias("_h"))
    return f.groupBy(*keys).agg(
        F.count("*").alias("n_files"),
        F.sum("length").alias("nbytes"),
        F.sha2(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "_h"))), lambda s: s["_h"]), ""), 256
        ).alias("sha256"),
    )


def vintage_violations(
    cycles: DataFrame, pinned: DataFrame, current: DataFrame | None, keys: Sequence[str]
) -> DataFrame:
    """Cycles missing from the pinned manifest, or whose content digest drifted from it."""
    want = cycles.select(*keys).distinct()
    out = want.join(pinned.select(*keys), list(keys), "left_anti").withColumn("reason", F.lit("missing"))
    if current is not None:
        j = want.join(current.select(*keys, F.col("sha256").alias("_now")), list(keys)).join(
            pinned.select(*keys, F.col("sha256").alias("_pin")), list(keys), "left"
        )
        drift = j.filter(~F.col("_now").eqNullSafe(F.col("_pin")))
        out = out.unionByName(drift.select(*keys, F.lit("hash_drift").alias("reason")))
    return out


def unmodelled_rolls(rolls: DataFrame, starts: DataFrame, calendar: DataFrame, keys: Sequence[str], sessions: int = 3) -> DataFrame:
    """Flagged rolls with ``near_episode``: an episode start fills within a few sessions of the roll."""
    pos = calendar.select(*keys, F.col("session").alias("roll_date"), F.col("pos").alias("_p"))
    f = rolls.filter(F.col("flagged")).join(pos, [*keys, "roll_date"], "left")
    near = f.select(
        *keys, "roll_date", F.explode(F.sequence(F.col("_p") - sessions, F.col("_p") + sessions)).alias("pos")
    )
    hits = near.join(starts.select(*keys, "pos").distinct(), [*keys, "pos"], "left_semi").select(*keys, "roll_date").distinct()
    return f.drop("_p").join(hits.withColumn("_hit", F.lit(True)), [*keys, "roll_date"], "left").withColumn(
        "near_episode", F.coalesce("_hit", F.lit(False))
    ).drop("_hit")
