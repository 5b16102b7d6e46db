"""Exact duplicates by a tree-merge of sorted digest runs.

Every input partition forms one run: its distinct digests, sorted, each with a count and the surviving row.
Partitions sit in ``FAN ** m`` slots, and the digest space is cut into as many ranges. In round r a run is cut by the r-th digit (base ``FAN``) of the digest's range and
the pieces are exchanged among the slots that differ in that digit only; each slot merges the ``FAN`` runs it
gets, adding counts and keeping one survivor per verified text. After m rounds a slot holds exactly its own
digest range. Copies are merged at every level, so a text with a third of all rows is one row per run from the
start. Runs carry a 64-bit sort digest; equality is verified by byte length and SHA-256.

The survivors go back the same way: every run asks for its own digests, and rows look up their run's answer, so
no row count of a group ever meets in one task.

Defined results: null counts as the empty text; a null id loses against any id; repeated rows (same id, same
text) keep exactly one; an empty table gives an empty result; extra columns are ignored or, in ``drop_copies``,
kept as they are.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weatherlake.llm.common import ROW, ascii_lower, body, keep_rows, stored, stored_documents, whole, with_row

FAN = 8
KEY = ["digest", "n_bytes", "text_sha256"]


def digest_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """One small stored row per document: row number, input partition, id and digests of the folded text.

    ``carry`` stores the document with them, as ``_doc``.
    """
    folded = ascii_lower(body(text_col))
    doc = [whole(docs)] if carry else []
    rows = with_row(docs.select("*", *doc)).select(
        ROW,
        *["_doc" for _ in doc],
        F.spark_partition_id().alias("part"),
        F.col(id_col).alias("doc_id"),
        folded.alias("_folded"),
    )
    rows = rows.select(
        ROW,
        *["_doc" for _ in doc],
        "part",
        "doc_id",
        F.xxhash64("_folded").alias("digest"),
        F.octet_length("_folded").alias("n_bytes"),
        F.sha2("_folded", 256).alias("text_sha256"),
    )
    return stored_documents(rows, "digests") if carry else stored(rows, "dedup-digests")


def merge_runs(rows: DataFrame, keep: str = "smallest") -> DataFrame:
    """Survivor and count of every distinct text: (digest, n_bytes, text_sha256, keep, group_size)."""
    best = F.max if keep == "largest" else F.min
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rounds = max(1, math.ceil(math.log(max(width, 2), FAN) - 1e-9))
    slots, bits = FAN**rounds, rounds * int(math.log2(FAN))
    # the last field keeps a null id behind any other under both orders
    order = F.struct((F.col("doc_id").isNull() == F.lit(keep != "largest")).alias("rank"), "doc_id", ROW)
    runs = rows.groupBy((F.col("part") % slots).alias("slot"), *KEY).agg(best(order).alias("keep"), F.count("*").alias("group_size"))
    home = F.shiftrightunsigned(F.col("digest"), 64 - bits)
    for r in range(rounds):
        step = FAN**r
        digit = lambda c: F.floor(c / step) % FAN
        target = F.col("slot") + (digit(home) - digit(F.col("slot"))) * step
        runs = (
            runs.withColumn("slot", target.cast("long"))
            .repartition("slot")
            .groupBy("slot", *KEY)
            .agg(best("keep").alias("keep"), F.sum("group_size").alias("group_size"))
            .sortWithinPartitions("slot", "digest")
        )
    return runs.drop("slot")


def find_copies(docs: DataFrame, keep: str = "smallest", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: _row, doc_id, keep_id, group_size, kept, text_sha256."""
    rows = digest_rows(docs, id_col, text_col)
    asked = rows.select("part", *KEY).distinct()
    answers = asked.join(merge_runs(rows, keep), KEY)
    return rows.join(answers, ["part", *KEY]).select(
        ROW,
        "doc_id",
        F.col("keep.doc_id").alias("keep_id"),
        "group_size",
        (F.col(ROW) == F.col(f"keep.{ROW}")).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame, keep: str = "largest") -> DataFrame:
    """The documents without the copies, with all their columns."""
    rows = digest_rows(docs, carry=True)
    kept = merge_runs(rows, keep).select(F.col(f"keep.{ROW}").alias(ROW))
    return keep_rows(rows, kept)
