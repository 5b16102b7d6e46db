"""Blocks of texts in tables bucketed by block, and question-and-answer rounds between blocks and buckets.

A block sends each bucket one packed request with its distinct keys; a bucket answers every block that asked. Blocks
and answers are bucketed tables on the block number, so joining them moves no text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weatherlake.llm.common import body, bucketed

#: Bytes of text that make a block full; a longer text is a block of its own.
BLOCK = 4 << 20
REQUEST = "block long, part long, body binary"


def text_blocks(docs: DataFrame, block_bytes: int = BLOCK, tag: str | None = None) -> DataFrame:
    """(block, ids, sizes, tags, data): consecutive texts of a partition, UTF-8 with a zero byte after each, compressed.
    ``tags`` holds the texts' values of the string column ``tag``."""
    tagged = F.col(tag) if tag else F.lit(None).cast("string")
    rows = docs.select(F.col("doc_id").cast("long"), body().cast("binary").alias("text"), tagged.alias("tag"), F.spark_partition_id().alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        tags: list = []
        texts: list[bytes] = []
        size = made = part = 0

        def out() -> pa.RecordBatch:
            data = zstandard.ZstdCompressor(level=3).compress(b"\0".join([*texts, b""]))
            values = [[part << 32 | made], [ids], [[len(t) for t in texts]], [tags], [data]]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string()), pa.large_binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], names=["block", "ids", "sizes", "tags", "data"])

        for b in batches:
            for doc_id, text, tagged, part in zip(*(c.to_pylist() for c in b.columns)):
                if texts and size + len(text) > block_bytes:
                    yield out()
                    ids, tags, texts, size, made = [], [], [], 0, made + 1
                ids.append(doc_id)
                tags.append(tagged)
                texts.append(text)
                size += len(text) + 16
        if texts:
            yield out()

    return rows.mapInArrow(run, "block long, ids array<long>, sizes array<long>, tags array<string>, data binary")


def text_of(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def requests(block: int, parts: np.ndarray, make: Callable[[slice], bytes]) -> pa.RecordBatch:
    """One request per bucket present; ``parts`` are the buckets of the block's keys, in ascending order."""
    present, first = np.unique(parts, return_index=True)
    cut = [*first.tolist(), len(parts)]
    bodies = [make(slice(i, j)) for i, j in zip(cut, cut[1:])]
    values = [np.full(len(present), block, np.int64), present.astype(np.int64), bodies]
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, [pa.int64(), pa.int64(), pa.binary()])], names=["block", "part", "body"])


def exchange(asked: DataFrame, answer: Callable[[list[bytes]], list[bytes]], buckets: int, label: str) -> DataFrame:
    """(block, ``label``): each block's answers as structs of part and body. ``answer`` maps the requests of a bucket
    to their answers, in the same order."""

    def one(t: pa.Table) -> pa.Table:
        return t.set_column(2, "body", pa.array(answer(t.column("body").to_pylist()), pa.binary()))

    answers = asked.groupBy("part").applyInArrow(one, REQUEST).repartition(buckets, "block")
    return bucketed(answers.groupBy("block").agg(F.collect_list(F.struct("part", "body")).alias(label)), buckets, label)


def in_order(answers: list[dict] | None) -> list[bytes]:
    return [a["body"] for a in sorted(answers or [], key=lambda a: a["part"])]
