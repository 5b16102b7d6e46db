"""Query registry: one entry per operator, with the SQL twin that checks it."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weatherlake.session import use_utc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
COVERS: dict[str, str] = {}


def query(name: str, covers: str, sql: str | None = None, rounds: dict[str, int] | None = None):
    """Register a query; ``rounds`` gives the decimals compared, applied alike on both sides."""
    rounds = rounds or {}

    def deco(fn):
        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            use_utc(spark)
            out = fn(spark, sf_dir)
            cols = [
                (F.round(F.col(c).cast("double"), rounds[c]) + F.lit(0.0)).alias(c) if c in rounds else F.col(c)
                for c in out.columns
            ]
            return out.select(*cols) if rounds else out

        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = run
        COVERS[name] = covers
        if sql is not None:
            if rounds:
                rep = ", ".join(f"round(cast({c} as double), {d}) + 0.0 as {c}" for c, d in rounds.items())
                SQL[name] = f"select * replace ({rep}) from ({sql})"
            else:
                SQL[name] = sql
        return run

    return deco


def also(name: str, of: str) -> None:
    """A second name of a registered query."""
    if name in QUERIES:
        raise ValueError(f"duplicate query {name}")
    QUERIES[name], COVERS[name] = QUERIES[of], COVERS[of]
    if of in SQL:
        SQL[name] = SQL[of]
