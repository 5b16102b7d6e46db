"""Tamper-evident chains and omission sweeps (O-AU-01..03)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from weatherlake.operators.windows import POS, over_tiles

GENESIS = "genesis"
# Request paths whose calls must leave an audit row.
MUTATING_PREFIXES = ("/v1/admin/tokens", "/v1/admin/keys", "/v1/admin/tenants", "/v1/backtests")


def row_hash(prev: Column, payload: Column) -> Column:
    return F.sha2(F.concat(F.coalesce(prev, F.lit(GENESIS)), F.lit("|"), payload), 256)


def chain_rows(audit: DataFrame, chain: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows with their 0-based chain position and ``bad``: a wrong hash or a broken link.

    Every row is checked against its predecessor only, so chains of any length run in tiles.
    """

    def build(x: DataFrame, w) -> DataFrame:
        before = F.lag("hash").over(w)
        ok = (F.col("hash") == row_hash(F.col("prev_hash"), F.col("payload"))) & F.col("prev_hash").eqNullSafe(before)
        return x.withColumn("bad", ~F.coalesce(ok, F.lit(False))).withColumn("position", F.col(POS) - 1)

    return over_tiles(audit, chain, order, build, before=1)


def verify_chains(audit: DataFrame, chain: Sequence[str], order: Sequence[str]) -> DataFrame:
    rows = chain_rows(audit, chain, order)
    first = F.min(F.when(F.col("bad"), F.col("position")))
    return rows.groupBy(*chain).agg(F.count("*").alias("n"), (~F.max("bad")).alias("ok"), first.alias("first_bad"))


def seal_chains(rows: DataFrame, chain: str, order: Sequence[str]) -> DataFrame:
    """Add prev_hash and hash in order, one chain after another.

    A hash needs its predecessor, so a chain is sequential by definition. Chains spread over tasks and
    stream through Arrow batches; only the last hash is kept, never the chain.
    """
    schema = StructType(
        [*rows.schema.fields, StructField("prev_hash", StringType()), StructField("hash", StringType())]
    )

    def seal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, last = None, None
        for b in batches:
            prevs, hashes = [], []
            for c, payload in zip(b[chain], b["payload"], strict=True):
                if c != current:
                    current, last = c, None
                prevs.append(last)
                last = hashlib.sha256(f"{last or GENESIS}|{payload}".encode()).hexdigest()
                hashes.append(last)
            yield b.assign(prev_hash=prevs, hash=hashes)

    ordered = rows.repartition(chain).sortWithinPartitions(chain, *order)
    return ordered.mapInPandas(seal, schema)


def is_mutating(path: Column, prefixes: Sequence[str] = MUTATING_PREFIXES) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | path.startswith(p)
    return out


def omissions(access_log: DataFrame, audit: DataFrame) -> DataFrame:
    """Logged mutating requests without an audit row."""
    want = access_log.filter(is_mutating(F.col("path"))).select("request_id").distinct()
    return want.join(audit.select("request_id"), "request_id", "left_anti")
