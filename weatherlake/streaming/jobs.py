"""Structured Streaming jobs (O-STR-01..07): the batch operators behind watermarks, state and foreachBatch."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator, Sequence
from datetime import date, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructField, StructType

EPOCH = date(1970, 1, 1)
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def file_stream(spark: SparkSession, folder: str, schema: str, name_glob: str = "*.parquet", per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema).option("pathGlobFilter", name_glob)
    if per_trigger:
        r = r.option("maxFilesPerTrigger", per_trigger)
    return r.parquet(folder)


def fresh_cycles(cycles: DataFrame, ts: str, cycle_id: str, tolerance: str = "1 day") -> DataFrame:
    """Drop repeated cycle ids and cycles older than the tolerance behind the newest one seen."""
    return cycles.withWatermark(ts, tolerance).dropDuplicatesWithinWatermark([cycle_id])


def run_batches(
    stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True
) -> StreamingQuery:
    """foreachBatch with a checkpoint; the handler must be idempotent per batch id."""
    w = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()


class WaitForCycle(StatefulProcessor):
    """Rows of a cycle wait in state until it is complete and then leave together, once.

    A cycle is complete when every one of the ``expected`` parts has come, or a row that ends it. When the watermark
    passes its deadline first, it leaves as one row with the reason, or, with ``release``, with the rows it has. Until
    then it is remembered, so rows after completion leave as one row with a reason too. State is the open cycles' rows.
    """

    def __init__(self, expected: Sequence[str], release: bool):
        self.expected, self.release = frozenset(expected), release

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "body string")
        self.parts = handle.getMapState("parts", "part string", "n long")
        self.status = handle.getValueState("status", "due long, left boolean")

    @staticmethod
    def out(key, bodies: Sequence[str | None], reason: str | None = None) -> pd.DataFrame:
        return pd.DataFrame({"cycle_key": [key[0]] * len(bodies), "body": list(bodies), "reason": [reason] * len(bodies)}, dtype=object)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        due, left = self.status.get() if self.status.exists() else (None, False)
        ended, repeats = False, 0
        for b in rows:
            if left:
                repeats += len(b)
                continue
            self.rows.appendList([(x,) for x in b.body])
            for part, n in b.part.value_counts().items():
                self.parts.updateValue((part,), ((self.parts.getValue((part,))[0] if self.parts.containsKey((part,)) else 0) + int(n),))
            ended = ended or bool(b.ends.any())
            if due is None:
                due = int(b.due.min())
                self.handle.registerTimer(due)
        if repeats:
            yield self.out(key, [None], "arrived after completion")
        elif ended or (self.expected and self.expected <= {k[0] for k in self.parts.keys()}):
            yield self.out(key, [r[0] for r in self.rows.get()])
            self.rows.clear()
            left = True
        self.status.update((due, left))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.status.get()[1]:
            if self.release:
                yield self.out(key, [r[0] for r in self.rows.get()])
            else:
                missing = sorted(self.expected - {k[0] for k in self.parts.keys()})
                yield self.out(key, [None], "missing parts: " + ", ".join(missing))
        for state in (self.rows, self.parts, self.status):
            state.clear()

    def close(self) -> None:
        pass


def whole_cycles(
    stream: DataFrame,
    keys: Sequence[str],
    ts: str,
    due: Column,
    part: Column | None = None,
    expected: Sequence[str] = (),
    ends: Column | None = None,
    release: bool = False,
    delay: str = "1 hour",
) -> DataFrame:
    """The stream with ``reason``: rows of a cycle in the micro-batch that completes it, and one row of keys and reason
    for a cycle that is not complete when the watermark passes ``due``. See ``WaitForCycle``."""
    form = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "ignoreNullFields": "false"}
    x = stream.withWatermark(ts, delay)
    x = x.select(
        ts,
        F.to_json(F.struct(*keys), form).alias("cycle_key"),
        F.to_json(F.struct(*stream.columns), form).alias("body"),
        (F.lit("") if part is None else part.cast("string")).alias("part"),
        F.unix_millis(due.cast("timestamp")).alias("due"),
        F.coalesce(ends, F.lit(False)).alias("ends") if ends is not None else F.lit(False).alias("ends"),
    )
    got = x.groupBy("cycle_key").transformWithStateInPandas(
        statefulProcessor=WaitForCycle([str(e) for e in expected], release),
        outputStructType="cycle_key string, body string, reason string",
        outputMode="Append",
        timeMode="EventTime",
    )
    schema = StructType([StructField(f.name, f.dataType) for f in stream.schema.fields])
    row, key = F.from_json("body", schema, form), F.from_json("cycle_key", schema, form)
    return got.select(*[(F.coalesce(row[c], key[c]) if c in keys else row[c]).alias(c) for c in stream.columns], "reason")


def staged(batch_rows: DataFrame, folder: str, batch: int) -> DataFrame:
    """The micro-batch, written once: its steps read the files and don't run the stream's plan and state again."""
    path = f"{folder}/batch={batch}"
    batch_rows.write.mode("overwrite").parquet(path)
    return batch_rows.sparkSession.read.schema(batch_rows.schema).parquet(path)


def cycle_intake(
    stream: DataFrame,
    features: Callable[[DataFrame], DataFrame],
    verdicts: Callable[[DataFrame], DataFrame],
    keys: Sequence[str],
    accepted: str,
    rejected: str,
    checkpoint: str,
    signals: Callable[[DataFrame], DataFrame] | None = None,
    published: str | None = None,
) -> StreamingQuery:
    """Cell files -> validation -> features -> signals; rejected cycles go to a side output with their reason.

    Each micro-batch writes to its own folder with overwrite, so a replayed batch leaves one copy. Where a cycle's
    cells come in several micro-batches, the stream is that of ``whole_cycles``; its reasons go to the side output too.
    """

    def handle(cells: DataFrame, batch: int) -> None:
        cells = staged(cells, f"{checkpoint}-cells", batch)
        early = None
        if "reason" in cells.columns:
            early = cells.filter(F.col("reason").isNotNull()).select(*keys, "reason")
            cells = cells.filter(F.col("reason").isNull()).drop("reason")
        v = verdicts(cells)
        good = v.filter(F.col("reason").isNull()).select(*keys)
        features(cells.join(good, list(keys), "left_semi")).write.mode("overwrite").parquet(f"{accepted}/batch={batch}")
        bad = v.filter(F.col("reason").isNotNull())
        bad = bad if early is None else bad.unionByName(early, allowMissingColumns=True)
        bad.write.mode("overwrite").parquet(f"{rejected}/batch={batch}")
        if signals is not None:
            kept = cells.sparkSession.read.parquet(f"{accepted}/batch={batch}")
            signals(kept).write.mode("overwrite").parquet(f"{published}/batch={batch}")

    return run_batches(stream, handle, checkpoint)


def publish_batches(stream: DataFrame, payloads: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """One JSON line per completed cycle and part (idempotent per batch folder).

    Where a cycle's signals come in several micro-batches, the stream is that of ``whole_cycles``.
    """

    def handle(signals: DataFrame, batch: int) -> None:
        signals = staged(signals, f"{checkpoint}-signals", batch)
        if "reason" in signals.columns:
            signals = signals.filter(F.col("reason").isNull()).drop("reason")
        payloads(signals).select("cycle_id", "part", "payload").write.mode("overwrite").json(f"{out}/batch={batch}")

    return run_batches(stream, handle, checkpoint)


def window_statistics(
    stream: DataFrame, keys: Sequence[str], ts: str, value: str, size: str, slide: str | None = None, delay: str = "1 hour"
) -> DataFrame:
    """Tumbling or sliding mean, deviation, extremes and count, final once the watermark passes."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    g = stream.withWatermark(ts, delay).groupBy(*keys, w.alias("w"))
    return g.agg(
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        F.count(value).alias("n"),
    ).select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "mean", "std", "min", "max", "n")


def flag_anomalies(statistics: DataFrame, limit: float = 3.0) -> DataFrame:
    """Windows whose extreme lies more than ``limit`` deviations from their own mean."""
    far = F.greatest(F.col("max") - F.col("mean"), F.col("mean") - F.col("min")) / F.nullif(F.col("std"), F.lit(0.0))
    return statistics.withColumn("is_anomaly", F.coalesce(far > limit, F.lit(False)))


def budget_windows(stream: DataFrame, ts: str, size: str, target: float, delay: str = "1 hour") -> DataFrame:
    """Error budget and newest request per window."""
    bad = (F.col("status") >= 500) & ~F.coalesce("fail_closed", F.lit(False))
    g = stream.withWatermark(ts, delay).groupBy(F.window(ts, size).alias("w")).agg(
        F.count("*").alias("observed_requests"), F.count_if(bad).alias("real_5xx"), F.max(ts).alias("latest")
    )
    left = F.greatest(F.lit(1.0) - F.col("real_5xx") / F.col("observed_requests") / F.lit(1 - target), F.lit(0.0))
    return g.select(F.col("w.start").alias("start"), "observed_requests", "real_5xx", "latest", left.alias("remaining_fraction"))


class RunLength(StatefulProcessor):
    """Runs of consecutive qualifying days per location, whatever order the days arrive in.

    State is the location's disjoint runs as (first, last). A day joins the runs beside it, so an earlier day may
    bridge two runs; every day of a run from the lowest new one on then leaves again with its new length. Lengths only
    grow, so the largest one of a day is the last one. A day counts as qualifying when any row says so. Runs that ended
    more than ``horizon`` days before the newest run are forgotten; a qualifying day older than that leaves as
    ``late``, with the length that its own batch gives it.
    """

    def __init__(self, at_least: int, horizon: int):
        self.at_least, self.horizon = at_least, horizon

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.runs = handle.getListState("runs", "first int, last int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        runs = sorted((int(a), int(b)) for a, b in self.runs.get()) if self.runs.exists() else []
        known = runs[-1][1] - self.horizon if runs else None
        touched: dict[int, int] = {}  # first day of a run -> lowest new day in it
        for b in rows:
            for day in sorted({(d - EPOCH).days for d, hit in zip(b.day, b.hit, strict=True) if hit}):
                i = bisect_right(runs, (day, day))
                if i and runs[i - 1][1] >= day or i < len(runs) and runs[i][0] == day:
                    continue
                first, last, low = day, day, day
                if i < len(runs) and runs[i][0] == day + 1:
                    low = min(low, touched.pop(runs[i][0], low))
                    last = runs.pop(i)[1]
                if i and runs[i - 1][1] == day - 1:
                    i -= 1
                    first = runs.pop(i)[0]
                    low = min(low, touched.pop(first, low))
                runs.insert(i, (first, last))
                touched[first] = low
        out = []
        ends = dict(runs)
        for first, low in sorted(touched.items()):
            for day in range(max(low, first + self.at_least - 1), ends[first] + 1):
                out.append((key[0], EPOCH + timedelta(days=day), day - first + 1, known is not None and day < known))
        if runs:
            self.runs.put([r for r in runs if r[1] >= runs[-1][1] - self.horizon])
        yield pd.DataFrame(out, columns=["location", "day", "length", "late"])

    def close(self) -> None:
        pass


def run_length_alerts(stream: DataFrame, at_least: int, horizon: int = 3660) -> DataFrame:
    """Heat or drought alert state from daily rows (location, day date, hit boolean): days of runs of ``at_least`` days.

    A day leaves again when an earlier day lengthens its run; ``latest_lengths`` keeps the last word.
    """
    return stream.groupBy("location").transformWithStateInPandas(
        statefulProcessor=RunLength(at_least, horizon),
        outputStructType="location string, day date, length int, late boolean",
        outputMode="Append",
        timeMode="None",
    )


def latest_lengths(alerts: DataFrame) -> DataFrame:
    """The alerts with corrections applied: one row per location and day."""
    return alerts.groupBy("location", "day").agg(F.max("length").alias("length"), F.min("late").alias("late"))


class FeedSession(StatefulProcessor):
    """First-in first-out connect/disconnect pairing per (tenant, session) with a time-out.

    Events wait in state until the watermark has passed them (a timer at the oldest one), then pair in
    time order. The queue of open
    connects times out ``timeout_ms`` after its newest connect, so abandoned sessions do not pile up.
    """

    def __init__(self, timeout_ms: int):
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", "ms long, tie long, up boolean")
        self.open = handle.getListState("open", "ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        late = timerValues.getCurrentWatermarkInMs()
        due = None
        for b in rows:
            fresh = b[b.ms > late]
            self.pending.appendList([(int(m), int(t), bool(u)) for m, t, u in zip(fresh.ms, fresh.tie, fresh.up, strict=True)])
            if len(fresh):
                first = int(fresh.ms.min())
                due = first if due is None else min(due, first)
        if due is not None:
            self.handle.registerTimer(due + 1)
        yield pd.DataFrame(columns=["tenant_id", "session_id", "connected_ms", "disconnected_ms"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        ready = sorted(r for r in (tuple(x) for x in self.pending.get()) if r[0] <= mark)
        rest = [r for r in (tuple(x) for x in self.pending.get()) if r[0] > mark]
        queue = [x[0] for x in self.open.get()]
        out = []
        for ms, _, up in ready:
            if up:
                queue.append(ms)
            elif queue:
                out.append((*key, queue.pop(0), ms))
        queue = [q for q in queue if q + self.timeout_ms > mark]
        self.pending.put(rest) if rest else self.pending.clear()
        if rest:
            self.handle.registerTimer(min(r[0] for r in rest) + 1)
        self.open.put([(q,) for q in queue]) if queue else self.open.clear()
        if queue:
            self.handle.registerTimer(max(queue) + self.timeout_ms)
        yield pd.DataFrame(out, columns=["tenant_id", "session_id", "connected_ms", "disconnected_ms"])

    def close(self) -> None:
        pass


def feed_sessions(stream: DataFrame, ts: str, tie: str, connect: Column, delay: str = "1 hour", timeout_hours: int = 24 * 30) -> DataFrame:
    """Completed feed sessions in milliseconds from a stream with tenant_id, session_id and ``ts``."""
    x = stream.withWatermark(ts, delay).select(
        "tenant_id", "session_id", ts, F.unix_millis(ts).alias("ms"), F.col(tie).cast("long").alias("tie"), connect.alias("up")
    )
    return x.groupBy("tenant_id", "session_id").transformWithStateInPandas(
        statefulProcessor=FeedSession(timeout_hours * 3_600_000),
        outputStructType="tenant_id string, session_id long, connected_ms long, disconnected_ms long",
        outputMode="Append",
        timeMode="EventTime",
    )


def drain(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over all available input into parquet and read the result back."""
    spark = stream.sparkSession
    q = (
        stream.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode(mode)
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
