"""Bounded samples of labelled documents for the two classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weatherlake.llm.common import id_hash


def held_out() -> F.Column:
    return id_hash() % 4 == 2


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """(doc_id, text, y) of at most ``rows`` labelled documents outside the held-out quarter.

    Ids are taken in the order of a hash, so the sample does not depend on partitioning. Repeated labels of an id
    are averaged, and of repeated documents of an id the smallest text counts, so an id is one row; null ids and null
    labels are left out. The label table is cut down first: at most ``rows`` rows are broadcast, and documents are
    read in place.
    """
    one = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out())
    one = one.groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("int").alias("y"))
    few = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return texts.join(F.broadcast(few), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"))
