"""Sinks and the keyed store (O-SRC-07..10). Everything is a distributed write; re-runs are idempotent."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UNIT = ("date", "cycle", "lead")


def write_cycles(
    spark: SparkSession, cells: DataFrame, path: str, partition: Sequence[str] = UNIT, rows_per_file: int = 2_000_000
) -> None:
    """Append the units that the store does not hold yet, one folder per unit.

    The rebalance hint clusters rows by unit so that a folder gets few files; adaptive execution splits a
    very large unit over several tasks and packs small ones, and ``maxRecordsPerFile`` bounds each file.
    """
    todo = cells
    if store_exists(spark, path):
        have = spark.read.schema(cells.schema).parquet(path).select(*partition).distinct()
        todo = cells.join(have, list(partition), "left_anti")
    (
        todo.hint("rebalance", *[F.col(c) for c in partition])
        .write.mode("append")
        .option("maxRecordsPerFile", rows_per_file)
        .partitionBy(*partition)
        .parquet(path)
    )


def store_exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def write_report(df: DataFrame, path: str, fmt: str, partition: Sequence[str] = ()) -> None:
    """Ledger, trade and report sink as csv, json or parquet."""
    w = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        w = w.option("header", "true")
    if partition:
        w = w.partitionBy(*partition)
    w.save(path)


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], version: Column) -> DataFrame:
    """Last write per natural key; new rows beat old ones of the same version.

    ``max_by`` combines on the map side, so a key with very many versions never gathers in one task.
    """
    cols = [c for c in old.columns if c not in keys]
    both = old.select(*keys, *cols).withColumn("_src", F.lit(0)).unionByName(
        new.select(*keys, *cols).withColumn("_src", F.lit(1))
    )
    g = both.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.struct(version, "_src")).alias("_r"))
    return g.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in cols])


def whole_steps(frames: Iterator[pd.DataFrame], time: str, steps: int) -> Iterator[pd.DataFrame]:
    """Sorted frames cut anew, so that each holds ``steps`` whole time steps (the last one those that are left).

    The step that a frame ends in stays open until a later frame begins another one. NULL times are one step.
    """
    held: list[pd.DataFrame] = []
    begun, last, first = 0, None, True
    for frame in frames:
        if not len(frame):
            continue
        t = frame[time].reset_index(drop=True)
        before = t.shift()
        new = (t != before) & ~(t.isna() & before.isna())
        new.iloc[0] = first or not (t.iloc[0] == last or pd.isna(t.iloc[0]) and pd.isna(last))
        start = 0
        for i in new.to_numpy().nonzero()[0].tolist():
            if begun == steps:
                held.append(frame.iloc[start:i])
                yield pd.concat(held, ignore_index=True)
                held, begun, start = [], 0, i
            begun += 1
        held.append(frame.iloc[start:])
        last, first = t.iloc[-1], False
    if held:
        yield pd.concat(held, ignore_index=True)


def chunked_map(
    df: DataFrame,
    time: str,
    fn: Callable[[pd.DataFrame], pd.DataFrame],
    schema: str,
    columns: Sequence[str] | None = None,
    partitions: int | None = None,
    steps: int = 64,
) -> DataFrame:
    """Apply a pandas function to chunks of ``steps`` whole time steps of a table too large for memory.

    Rows are range-partitioned by time, so a step lies in one partition, and sorted; Arrow batches are cut anew at
    steps, whatever their size. Memory holds one chunk and not a partition. A partition's last chunk may be shorter.
    Only ``columns`` are read. The result is lazy; any sink can take it.
    """
    src = df.select(time, *[c for c in (columns or df.columns) if c != time])
    ranged = src.repartitionByRange(partitions, time) if partitions else src.repartitionByRange(time)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for chunk in whole_steps(batches, time, steps):
            yield fn(chunk)

    return ranged.sortWithinPartitions(time).mapInPandas(run, schema)
