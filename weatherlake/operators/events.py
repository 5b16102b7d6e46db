"""Event-study statistics (O-EV-01..05)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weatherlake.operators.ranks import exact_quantiles

N_MIN, N_FULL, SHARPE_GATE = 8, 30, 1.0


def _event_sharpe(x: Column, years: float) -> Column:
    sd = F.stddev_samp(x)
    ok = (F.count(x) >= 2) & (sd >= 1e-15) & F.lit(years > 0)
    return F.when(ok, F.avg(x) / sd * F.sqrt(F.count(x) / F.lit(years))).otherwise(0.0)


def event_metrics(ledger: DataFrame, keys: Sequence[str], years: float) -> DataFrame:
    nb = F.col("net_of_benchmark")
    sd = F.stddev_samp(nb)
    t = F.when((F.count(nb) >= 2) & (sd >= 1e-15), F.avg(nb) / (sd / F.sqrt(F.count(nb)))).otherwise(0.0)
    return ledger.groupBy(*keys).agg(
        F.count("*").alias("n_events"),
        F.avg("gross").alias("mean_gross"),
        F.avg("net").alias("mean_net"),
        F.avg(nb).alias("mean_net_of_benchmark"),
        _event_sharpe(F.col("gross"), years).alias("gross_sharpe"),
        _event_sharpe(F.col("net"), years).alias("net_sharpe"),
        _event_sharpe(nb, years).alias("net_of_benchmark_sharpe"),
        t.alias("t_stat"),
        F.avg((F.col("net") > 0).cast("double")).alias("win_rate"),
    )


def numbered(ledger: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """Events as (key, idx, x, n); an event ledger has at most one row per key and cycle day."""
    w = Window.partitionBy(*keys).orderBy(order)
    return ledger.filter(F.col(value).isNotNull()).select(
        *keys,
        (F.row_number().over(w) - 1).alias("idx"),
        F.col(value).alias("x"),
        F.count("*").over(Window.partitionBy(*keys)).alias("n"),
    )


def bootstrap_sharpes(
    events: DataFrame, keys: Sequence[str], years: float, resamples: int = 10_000, seed: int = 42
) -> DataFrame:
    """Annualised event Sharpe of every resample.

    Draws are a hash of (resample, draw, seed), so any lost task repeats the same draws. The stream
    differs from other generators: only distributions are comparable.
    """
    point = events.groupBy(*keys).agg(
        F.max("n").cast("int").alias("n"), F.when(F.stddev_samp("x") > 1e-15, F.avg("x") / F.stddev_samp("x")).otherwise(0.0).alias("_p")
    )
    boots = point.filter("n >= 2").withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))))
    draws = boots.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    draws = draws.withColumn("idx", F.pmod(F.xxhash64("b", "k", F.lit(seed)), F.col("n")).cast("int"))
    j = draws.join(events.select(*keys, "idx", "x"), [*keys, "idx"])
    g = j.groupBy(*keys, "b").agg(
        F.avg("x").alias("_m"), F.stddev_samp("x").alias("_s"), F.max("n").alias("n"), F.max("_p").alias("_p")
    )
    ratio = F.when(F.col("_s") >= 1e-15, F.col("_m") / F.col("_s")).otherwise(F.col("_p"))
    return g.select(*keys, "b", (ratio * F.sqrt(F.col("n") / F.lit(years))).alias("sharpe"))


def bootstrap_summary(boot: DataFrame, keys: Sequence[str]) -> DataFrame:
    """95 % interval, one-sided p-value and percentiles of the resampled Sharpes."""
    qs = {"ci_lower": 0.025, "ci_upper": 0.975, "p1": 0.01, "p5": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}
    p = boot.groupBy(*keys).agg(((F.count_if(F.col("sharpe") <= 0) + 1) / (F.count("*") + 1)).alias("p_value"))
    return exact_quantiles(boot, keys, "sharpe", qs).join(p, list(keys))


def newey_west(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bartlett-weighted long-run variance, standard error and t; the lag depends on n only."""
    n = F.col("n")
    lag = F.greatest(F.lit(1), F.least(F.floor(F.pow(n / 100.0, F.lit(2.0 / 9.0)) * 4), F.greatest(F.lit(1), F.floor(n / 2))))
    mean = F.avg("x").over(Window.partitionBy(*keys))
    e = events.withColumn("_d", F.col("x") - mean).withColumn("lag", lag.cast("int"))
    back = e.withColumn("_j", F.explode(F.sequence(F.lit(1), F.col("lag")))).select(
        *keys, (F.col("idx") + F.col("_j")).alias("idx"), "_j", F.col("_d").alias("_b")
    )
    cross = e.join(back, [*keys, "idx"]).groupBy(*keys).agg(
        (F.sum((1 - F.col("_j") / (F.col("lag") + 1)) * F.col("_d") * F.col("_b")) * 2).alias("_c")
    )
    own = e.groupBy(*keys).agg(
        F.max("n").alias("n"), F.max("lag").alias("lag"), F.avg("x").alias("mean"), F.sum(F.col("_d") * F.col("_d")).alias("_g")
    )
    j = own.join(cross, list(keys), "left")
    var = (F.col("_g") + F.coalesce("_c", F.lit(0.0))) / F.col("n")
    se = F.when((F.col("n") >= 2) & (var >= 0), F.sqrt(var / F.col("n")))
    j = j.withColumn("se", se)
    t = F.when(F.col("se") >= 1e-15, F.col("mean") / F.col("se")).otherwise(0.0)
    return j.select(*keys, "n", "lag", "se", t.alias("t_stat"))


def overlaps(ledger: DataFrame, keys: Sequence[str], hold: int = 2) -> DataFrame:
    """Events whose entry falls before the previous one has ended."""
    w = Window.partitionBy(*keys).orderBy("entry_session", "entry_cycle")
    prev = F.lag("entry_session").over(w)
    x = ledger.withColumn("_o", F.coalesce(F.col("entry_session") < F.date_add(prev, hold + 1), F.lit(False)))
    return x.groupBy(*keys).agg(F.count_if("_o").alias("n_overlapping"), F.max("_o").alias("purging_needed"))


def decision(n: Column, sharpe: Column, ci_lower: Column) -> Column:
    return (
        F.when(n == 0, "ZERO_TRADES")
        .when(n < N_MIN, "UNDER_POWERED")
        .when((sharpe > SHARPE_GATE) & (ci_lower > 0), "PASS")
        .otherwise("FAIL_PIVOT")
    )


def power_class(n: Column) -> Column:
    return F.when(n == 0, "no trades").when(n >= N_FULL, "full-power").when(n >= N_MIN, "shrunk edge claim").otherwise(
        "under-powered"
    )


def oos_benchmark(pit: DataFrame, keys: Sequence[str], first: str, last: str) -> DataFrame:
    """Mean two-session return over the out-of-sample cycles."""
    x = pit.filter(F.col("date").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    return x.groupBy(*keys).agg(F.avg("fwd2_return").alias("benchmark"))


def live_benchmark(calendar: DataFrame, fallback: DataFrame, keys: Sequence[str], since: str) -> DataFrame:
    """Mean two-session return of sessions since a date; with under three sessions, the locked value."""
    live = calendar.filter(F.col("session") >= F.lit(since).cast("date"))
    g = live.groupBy(*keys).agg(
        F.count("*").alias("_n"), F.avg(F.col("next2_close") / F.col("close") - 1).alias("_live")
    )
    j = fallback.join(g, list(keys), "left")
    use = (F.col("_n") >= 3) & F.col("_live").isNotNull()
    return j.select(
        *keys,
        F.when(use, F.col("_live")).otherwise(F.col("benchmark")).alias("benchmark"),
        F.when(use, "live_window").otherwise("locked_fallback").alias("source"),
    )
