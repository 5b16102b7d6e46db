"""Helpers shared by the training-data operators: shared-storage tables, row ids, text columns, two-level sums."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from weatherlake.session import delete, materialise, scratch_path

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: The six ASCII characters that separate words; ``bytes.split()`` uses the same six.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"

ROW = "_row"
#: Bits of a row's place in its block of stored documents.
PLACE = 14
#: Rows of a stored file of a frame whose number of rows is known.
FILE_ROWS = 1 << 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str, rows: int | None = None) -> DataFrame:
    """Write a frame to the cluster's shared folder and read it back; lost executors re-read it.

    ``rows`` is the number of rows, or a bound of it, of a frame that is cheap to compute: a small one is then written by
    as many tasks as there are cores, with a file each, and not by one task and file for every shuffle partition.
    """
    if rows is not None:
        df = df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // FILE_ROWS)))
    return materialise(df, f"llm-{label}")


def bucketed(df: DataFrame, buckets: int, label: str, codec: str = "snappy") -> DataFrame:
    """Write to the shared folder, bucketed by block, and read back. The catalog forgets the name at once."""
    spark = df.sparkSession
    name = f"llm_{label}_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, "block").option("path", scratch_path(spark, name)).option("compression", codec).saveAsTable(name)
    found = spark.table(name)
    found.schema  # resolved now, so the name is no longer needed
    spark.sql(f"drop table {name}")
    return found


def discard(df: DataFrame) -> None:
    """Delete the files of a frame just as ``stored`` or ``bucketed`` gave it, when all that needs them is stored itself."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if folder.rsplit("/", 1)[1].startswith(("llm_", "llm-")):
            delete(df.sparkSession, folder)


def body(text: str = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, UPPER, LOWER)


def with_row(docs: DataFrame) -> DataFrame:
    """Add ``_row``, a number of the row, so that repeated rows (equal ids, equal texts) can be told apart.
    It holds for one scan only, as the next plan may split the files anew: store it with what belongs to it."""
    return docs.withColumn(ROW, F.monotonically_increasing_id())


def whole(docs: DataFrame) -> Column:
    """All columns as the struct ``_doc``, whatever their names."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")


def stored_documents(rows: DataFrame, label: str) -> DataFrame:
    """Store numbered rows and their documents in tables bucketed by blocks of rows, so that ``attached`` moves none."""
    buckets = 2 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return bucketed(rows.withColumn("block", F.shiftright(ROW, PLACE)), buckets, label, codec="zstd")


def numbered(docs: DataFrame) -> DataFrame:
    """Stored rows (_row, _doc, block): the one place from which numbers, texts and kept documents are taken."""
    return stored_documents(docs.select(F.monotonically_increasing_id().alias(ROW), whole(docs)), "numbered")


def attached(rows: DataFrame, values: DataFrame) -> DataFrame:
    """The rows of ``stored_documents`` that have a row of the same number in ``values``, with the array ``_values`` of the
    structs of its other columns. Only values move: a block gets all of its own, and a row finds its by its place."""
    rest = [c for c in values.columns if c != ROW]
    place = (F.col(ROW) % (1 << PLACE)).cast("int")
    placed = values.select(F.shiftright(ROW, PLACE).alias("block"), place.alias("place"), (F.struct(*rest) if rest else F.lit(True)).alias("value"))

    def gather(t: pa.Table) -> pa.Table:
        at = t.column("place").to_numpy()
        order = np.argsort(at, kind="stable")
        ends = np.searchsorted(at[order], np.arange(at.max() + 2))
        value = t.column("value").combine_chunks().take(pa.array(order))
        if rest:  # fields that may be null, as in the schema
            value = pa.StructArray.from_arrays(value.flatten(), names=rest)
        each = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), value)
        return pa.table({"block": t.column("block").slice(0, 1), "values": pa.ListArray.from_arrays(pa.array([0, len(each)], pa.int32()), each)})

    kind = placed.schema["value"].dataType.simpleString()
    blocks = placed.groupBy("block").applyInArrow(gather, f"block long, values array<array<{kind}>>")
    # by hash, as a merge would sort the documents
    found = rows.join(blocks.hint("shuffle_hash"), "block").withColumn("_values", F.get("values", place))
    return found.filter(F.size("_values") > 0).drop("values")


def keep_rows(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """The documents of the stored ``rows`` whose row number is in ``kept``, with all their columns."""
    return attached(rows.select(ROW, "_doc", "block"), kept.select(ROW)).select("_doc.*")


def id_hash(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text; null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))


def sums_before(df: DataFrame, keys: Sequence[str], order: str, values: Sequence[str], span: int = 1024) -> DataFrame:
    """Add ``<value>_before``: the sum of each value over earlier rows of the same keys.

    ``order`` is an integer column, unique for the keys. Two levels: sums of spans of ``order`` are scanned
    first, then the rows inside each span, so no task sees more than a span or one row per span.
    """
    x = df.withColumn("_span", F.floor(F.col(order) / span))
    inside = Window.partitionBy(*keys, "_span").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy(*keys).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    spans = x.groupBy(*keys, "_span").agg(*[F.sum(v).alias(f"_s_{v}") for v in values])
    carry = spans.select(*keys, "_span", *[F.coalesce(F.sum(f"_s_{v}").over(over), F.lit(0)).alias(f"_c_{v}") for v in values])
    out = x.join(carry, [*keys, "_span"])
    for v in values:
        out = out.withColumn(f"{v}_before", F.col(f"_c_{v}") + F.coalesce(F.sum(v).over(inside), F.lit(0)))
    return out.drop("_span", *[f"_c_{v}" for v in values])


#: Texts handed to one call of a mapped function.
BATCH = 512


def map_columns(df: DataFrame, inputs: Sequence[str], outputs: Sequence[tuple[str, str]], make: Callable[[], Callable]) -> DataFrame:
    """Append columns computed from ``inputs`` in Arrow batches; a column of the same name is replaced.

    ``outputs`` are (name, kind) with kind long, double, boolean or binary. ``make()`` runs once per task and
    gives ``f(*lists) -> lists``, one list per output, for at most ``BATCH`` rows at a time.
    """
    names = [n for n, _ in outputs]
    src = df.select(*[df[f"`{c}`"] for c in df.columns if c not in names], *[F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(inputs)])
    keep = [c for c in df.columns if c not in names]
    schema = StructType([*src.schema.fields[: len(keep)], *StructType.fromDDL(", ".join(f"{n} {k}" for n, k in outputs)).fields])
    arrow = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.large_binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in batches:
            for s in range(0, b.num_rows, BATCH):
                p = b.slice(s, BATCH)
                new = f(*[c.to_pylist() for c in p.columns[len(keep) :]])
                cols = [pa.array(x, arrow[k]) for x, (_, k) in zip(new, outputs)]
                yield pa.RecordBatch.from_arrays([*p.columns[: len(keep)], *cols], names=[*keep, *names])

    return src.mapInArrow(run, schema)
