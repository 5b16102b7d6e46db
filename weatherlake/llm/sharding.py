"""Contiguous shards of near-equal bytes from global prefix sums.

Rows are range-partitioned by id; each partition contributes one total, the totals are summed up in order, and
a row's global byte position is its partition's start plus the running size inside the partition. The byte line
is cut at equal targets; a row goes to the shard that holds its midpoint, so shards are contiguous in id order
and differ from the target by less than one row. Only ids, sizes and checksums are shuffled, never texts.

Defined results: a null text has size ``overhead`` and the checksum of the empty text; null ids sort first;
repeated rows each get their own slot, in an order fixed by their position in the input; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weatherlake.llm.common import ROW, body, stored, with_row


def byte_shards(docs: DataFrame, shards: int, overhead: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, position, shard, slot): ``position`` is the global byte offset of the row."""
    sized = with_row(docs).select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(body(text_col)) + overhead).cast("long").alias("size"),
        F.crc32(body(text_col).cast("binary")).alias("text_crc32"),
        ROW,
    )
    ranged = sized.repartitionByRange("doc_id", ROW).withColumn("part", F.spark_partition_id())
    rows = stored(ranged, "shard-sizes")
    totals = rows.groupBy("part").agg(F.sum("size").alias("part_bytes"), F.count("*").alias("part_rows"))
    # one row per partition, so a plain running sum over all of them is small
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    all_parts = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = totals.select(
        "part",
        F.coalesce(F.sum("part_bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("part_rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("part_bytes").over(all_parts).alias("all_bytes"),
    )
    inside = Window.partitionBy("part").orderBy("doc_id", ROW)
    running = F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = (
        rows.join(starts, "part")
        .withColumn("position", F.col("bytes_before") + running)
        .withColumn("line", F.col("rows_before") + F.row_number().over(inside) - 1)
        .withColumn("wide", (2 * F.col("position") + F.col("size")).cast("decimal(38,0)"))
        .withColumn("shard", F.least(F.expr(f"wide * {shards} div (2 * all_bytes)").cast("int"), F.lit(shards - 1)))
    )
    first = placed.groupBy("shard").agg(F.min("line").alias("first_line"))
    return placed.join(F.broadcast(first), "shard").select(  # one row per shard
        "doc_id", "size", "text_crc32", "position", "shard", (F.col("line") - F.col("first_line")).alias("slot")
    )
