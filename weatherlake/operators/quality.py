"""Dataset gates, cycle validation and set-based replay (O-DQ-01..04). Failures are rows with a reason."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weatherlake.operators import pit as P


def missing_units(
    cells: DataFrame, keys: Sequence[str], first: str, last: str, cycles: Sequence[str], leads: Sequence[int]
) -> DataFrame:
    """Expected (date, cycle, lead) units per key that have no rows."""
    have = cells.select(*keys, "date", "cycle", "lead").distinct()
    want = (
        have.select(*keys)
        .distinct()
        .withColumn("date", F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))))
        .withColumn("cycle", F.explode(F.array(*map(F.lit, cycles))))
        .withColumn("lead", F.explode(F.array(*map(F.lit, leads))))
    )
    return want.join(have, [*keys, "date", "cycle", "lead"], "left_anti")


def unit_inventory(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per unit: cells, distinct latitudes and rows with a missing or impossible temperature."""
    bad = F.coalesce(~F.col("t2m").between(200.0, 330.0), F.lit(True))
    return cells.groupBy(*keys, "date", "cycle", "lead").agg(
        F.count("*").alias("cells"),
        F.count_distinct("latitude").alias("latitudes"),
        F.count_if(bad).alias("bad_t2m"),
        F.count("t2m").alias("present_t2m"),
    )


def dataset_gates(
    cells: DataFrame, pit: DataFrame, keys: Sequence[str], first: str, last: str, cycles: Sequence[str], leads: Sequence[int], min_latitudes: int = 8
) -> DataFrame:
    """Gate rows (gate, ok, failures): completeness, schema, point-in-time plausibility, staleness."""
    inv = unit_inventory(cells, keys)
    broken = (F.col("bad_t2m") > 0) | (F.col("latitudes") < min_latitudes)
    huge = (F.abs("fwd_return") > 0.5) | (F.abs("fwd2_return") > 0.5) | F.col("fwd2_return").isNull()
    last_day = F.lit(last).cast("date")
    gates = {
        "completeness": missing_units(cells, keys, first, last, cycles, leads).agg(F.count("*").alias("f")),
        "schema": inv.agg(F.count_if(broken).alias("f")),
        "pit": pit.agg((F.count_if(huge) + F.when(F.count("*") == 0, 1).otherwise(0)).alias("f")),
        "staleness": cells.agg(F.when(F.max("date") == last_day, 0).otherwise(1).cast("long").alias("f")),
    }
    rows = [g.select(F.lit(n).alias("gate"), (F.col("f") == 0).alias("ok"), F.col("f").cast("long").alias("failures")) for n, g in gates.items()]
    return reduce(DataFrame.unionByName, rows)


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once; ordered operators require none."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > 1)


def validate_cycles(cells: DataFrame, keys: Sequence[str], leads: Sequence[int], cells_per_lead: int) -> DataFrame:
    """Verdict per cycle: every required lead, the exact cell count on each, and some temperature."""
    inv = unit_inventory(cells, keys)
    need = F.array(*[F.lit(int(x)) for x in leads])
    g = inv.groupBy(*keys, "date", "cycle").agg(
        F.array_sort(F.collect_set("lead")).alias("leads"),
        F.sum("cells").alias("grid_cells"),
        F.count_if(F.col("cells") != cells_per_lead).alias("_bad"),
        F.sum("present_t2m").alias("_t"),
    )
    gone = F.size(F.array_except(need, "leads"))
    reason = (
        F.when(gone > 0, "missing_leads").when(F.col("_bad") > 0, "wrong_cell_count").when(F.col("_t") == 0, "no_temperature")
    )
    return g.withColumn("reason", reason).drop("_bad", "_t")


def latest_cycle_date(now: Column, hour: int = 12, latency_minutes: int = 210) -> Column:
    """Date of the latest cycle published by ``now``."""
    return F.to_date(now - F.make_dt_interval(hours=F.lit(hour), mins=F.lit(latency_minutes)))


def staleness(cycle_date: Column, now: Column, tolerance_days: int = 1) -> Column:
    """NULL when acceptable, else ``not_published`` or ``stale``."""
    latest = latest_cycle_date(now)
    return F.when(cycle_date > latest, "not_published").when(F.datediff(latest, cycle_date) > tolerance_days, "stale")


def replay(
    features: DataFrame,
    verdicts: DataFrame,
    calendar: DataFrame,
    thresholds: DataFrame,
    benchmark: DataFrame,
    keys: Sequence[str],
    ledger: DataFrame | None = None,
    max_close_age: int = 7,
    theta_t: float = 0.0,
) -> DataFrame:
    """All cycles in one plan: status, reject reason, decision and ledger return per cycle.

    A fired cycle needs a fill and an exit session, or it is rejected. Episode ids of new ledger rows
    continue after the highest existing one in cycle order; known cycles keep theirs.
    """
    x = features.join(verdicts.select(*keys, "date", "cycle", F.col("reason").alias("_bad")), [*keys, "date", "cycle"], "left")
    x = P.realised_close(x, calendar, keys, max_close_age)
    x = P.fill_session(x, calendar, keys, ["session", "close", "next2_close", "exit_session"])
    x = x.join(thresholds, list(keys), "left").join(benchmark, list(keys), "left")
    fires = F.coalesce((F.col("freeze_prob") >= F.col("theta_p")) & (F.col("temperature_min") <= theta_t), F.lit(False))
    reject = F.coalesce(
        F.col("_bad"),
        F.when(F.col("close_status") != "ok", F.concat(F.lit("close_"), "close_status")),
        F.when(fires & F.col("session").isNull(), "no_fill_session"),
        F.when(fires & F.col("exit_session").isNull(), "no_exit_session"),
    )
    x = x.withColumns({"reason": reject, "fires": fires})
    booked = F.col("fires") & F.col("reason").isNull()
    gross = F.col("next2_close") / F.col("close") - 1
    x = x.withColumn("forecast_cycle_id", P.cycle_id(F.col("date"), F.col("cycle")))
    if ledger is not None:
        x = x.join(ledger.select(*keys, "forecast_cycle_id", F.col("episode_id").alias("_known")), [*keys, "forecast_cycle_id"], "left")
        top = ledger.groupBy(*keys).agg(F.max("episode_id").alias("_top"))
        x = x.join(top, list(keys), "left")
    else:
        x = x.withColumns({"_known": F.lit(None).cast("long"), "_top": F.lit(None).cast("long")})
    fresh = (booked & F.col("_known").isNull()).cast("int")
    n = F.sum(fresh).over(Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, 0))
    return x.select(
        *keys,
        "date",
        "forecast_cycle_id",
        F.when(F.col("reason").isNull(), "ok").otherwise("rejected").alias("status"),
        "reason",
        booked.alias("booked"),
        F.when(booked, F.coalesce(F.col("_known"), F.coalesce(F.col("_top"), F.lit(0)) + n)).alias("episode_id"),
        F.when(booked, gross).alias("gross"),
        F.when(booked, gross - P.COST - F.col("benchmark")).alias("net_of_benchmark"),
    )
