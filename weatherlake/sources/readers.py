"""Readers for landed files. Parsers take a frame of text so that any source of text can feed them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CYCLE_SCHEMA = (
    "time timestamp, valid_time timestamp, latitude double, longitude double, t2m double, date string, cycle string, lead int"
)
PRICE_SCHEMA = "Date date, Open double, High double, Low double, Close double, Volume long"
CONTRACT_SCHEMA = "contract string, month_name string, first_notice_day date, last_trading_day date"
_UNIT = r"_(\d{8})_(\d{2})z_f(\d{3})"


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN becomes NULL at the source: Spark orders NaN above every number."""
    cols = [
        F.when(~F.isnan(c), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes
    ]
    return df.select(*cols)


def read_cycle_files(
    spark: SparkSession, path: str, schema: str = CYCLE_SCHEMA, first: str | None = None, last: str | None = None, leads: Sequence[int] | None = None
) -> DataFrame:
    """All lead files below a folder; date (yyyyMMdd), cycle and lead come from each file's path.

    Files may be named ``<prefix>_20240131_12z_f024.parquet``, or parts may lie in a folder of such a name. Dates and
    leads are conditions on file metadata, so files outside them are skipped without being opened.
    """
    raw = spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(path)
    name = F.col("_metadata.file_path")
    def part(i: int) -> Column:
        return F.regexp_extract(name, _UNIT, i)
    raw = raw.filter(part(1) != "")
    if first is not None:
        raw = raw.filter(part(1) >= first)
    if last is not None:
        raw = raw.filter(part(1) <= last)
    if leads is not None:
        raw = raw.filter(part(3).cast("int").isin(*leads))
    ids = {"date": part(1), "cycle": part(2), "lead": part(3).cast("int")}
    return nan_to_null(raw.withColumns(ids))


def read_cycle_store(
    spark: SparkSession, path: str, schema: str | None = None, first: str | None = None, last: str | None = None, leads: Sequence[int] | None = None, unit: str = "date"
) -> DataFrame:
    """Partitioned cycle store; the date and lead predicates prune folders before any file is opened."""
    r = spark.read if schema is None else spark.read.schema(schema)
    df = r.parquet(path)
    if first is not None:
        df = df.filter(F.col(unit) >= first)
    if last is not None:
        df = df.filter(F.col(unit) <= last)
    if leads is not None:
        df = df.filter(F.col("lead").isin(*leads))
    return nan_to_null(df)


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per file; API responses are small documents."""
    return spark.read.option("wholetext", "true").text(path)


def parse_weather(df: DataFrame, hourly: Sequence[str], daily: Sequence[str] = (), keep: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Column-array weather documents (text in ``value``) as an hourly and a daily frame.

    A top-level list holds several locations, numbered in ``location``. Daily variables get the prefix
    ``daily_``; latitude, longitude, elevation and timezone ride along.
    """
    def arrays(names: Sequence[str]) -> str:
        return "struct<time: array<string>" + "".join(f", {n}: array<double>" for n in names) + ">"
    doc = (
        f"struct<latitude: double, longitude: double, elevation: double, timezone: string, hourly: {arrays(hourly)}, daily: {arrays(daily)}>"
    )
    many = F.ltrim("value").startswith("[")
    docs = F.when(many, F.from_json("value", f"array<{doc}>")).otherwise(F.array(F.from_json("value", doc)))
    x = df.select(*keep, F.posexplode(docs).alias("location", "d"))
    base = [*keep, "location", *[F.col(f"d.{c}").alias(c) for c in ("latitude", "longitude", "elevation", "timezone")]]

    def unpack(group: str, names: Sequence[str], prefix: str) -> DataFrame:
        fields = ["time", *names]
        zipped = F.arrays_zip(*[F.col(f"d.{group}.{n}").alias(n) for n in fields])
        y = x.select(*base, F.explode(zipped).alias("r"))
        return y.select(
            *[F.col(c) if isinstance(c, str) else c for c in [*keep, "location", "latitude", "longitude", "elevation", "timezone"]],
            F.to_timestamp("r.time").alias("time"),
            *[F.col(f"r.{n}").alias(prefix + n) for n in names],
        )

    return unpack("hourly", hourly, ""), unpack("daily", daily, "daily_")


# Short station field -> column.
STATION_FIELDS = {
    "tmax": "temperature_max",
    "tmin": "temperature_min",
    "tavg": "temperature_mean",
    "prcp": "precipitation",
    "wspd": "windspeed_max",
    "wdir": "winddirection",
    "wpgt": "windgust_max",
    "pres": "pressure_mean",
    "rhum": "humidity_mean",
    "cldc": "cloudcover_mean",
    "vsby": "visibility_mean",
    "coco": "weather",
}


def parse_station_daily(df: DataFrame, keep: Sequence[str] = ("station_id",)) -> DataFrame:
    """Daily station documents ({"data": [...]}) with long field names, keyed by station."""
    fields = ", ".join(f"{k}: {'int' if k == 'coco' else 'double'}" for k in STATION_FIELDS)
    doc = F.from_json("value", f"struct<data: array<struct<date: string, {fields}>>>")
    x = df.select(*keep, F.explode(doc["data"]).alias("r"))
    return x.select(
        *keep, F.to_date(F.substring("r.date", 1, 10)).alias("date"), *[F.col(f"r.{k}").alias(v) for k, v in STATION_FIELDS.items()]
    )


# Field names of settlement documents.
SETTLEMENT_FIELDS = (
    "settlementDate",
    "date",
    "month",
    "contractMonth",
    "settlementPrice",
    "last",
    "change",
    "netChange",
    "volume",
    "totalVolume",
    "openInterest",
    "region",
)


def parse_settlements(df: DataFrame, keep: Sequence[str] = ("product",), start: str | None = None, end: str | None = None) -> DataFrame:
    """Settlement documents: a bare list or one under ``settlements`` or ``data``, with field aliases.

    A price that is no number becomes NULL; rows outside [start, end] are dropped.
    """
    item = "array<struct<" + ", ".join(f"`{n}`: string" for n in SETTLEMENT_FIELDS) + ">>"
    bare = F.ltrim("value").startswith("[")
    doc = F.from_json("value", f"struct<settlements: {item}, data: {item}>")
    rows = F.when(bare, F.from_json("value", item)).otherwise(F.coalesce(doc["settlements"], doc["data"]))
    x = df.select(*keep, F.explode(rows).alias("r"))
    def first(*fields: str) -> Column:
        cols = [F.col(f"r.{f}") for f in fields]
        return F.coalesce(*cols) if len(cols) > 1 else cols[0]
    x = x.select(
        *keep,
        first("settlementDate", "date").alias("settlement_date"),
        first("month", "contractMonth").alias("month"),
        first("settlementPrice", "last").try_cast("double").alias("settlement_price"),
        first("change", "netChange").try_cast("double").alias("change"),
        F.coalesce(first("volume", "totalVolume").try_cast("long"), F.lit(0)).alias("volume"),
        F.coalesce(first("openInterest").try_cast("long"), F.lit(0)).alias("open_interest"),
        F.coalesce(first("region"), F.lit("US_NATIONAL")).alias("region"),
    )
    if start is not None:
        x = x.filter(F.col("settlement_date") >= start)
    if end is not None:
        x = x.filter(F.col("settlement_date") <= end)
    return x


def split_prices(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Price history CSVs, and the lines that don't fit the schema as (ticker, line).

    The ticker is the file's name without its extension, or that of the folder its parts lie in.
    """
    ticker = F.regexp_extract(F.col("_metadata.file_path"), r"([^/=]+)\.csv(?:/[^/]*)?$", 1)
    lines = spark.read.option("recursiveFileLookup", "true").text(path).select(ticker.alias("ticker"), F.col("value").alias("line"))
    header = ",".join(f.split(" ")[0] for f in PRICE_SCHEMA.split(", "))
    parsed = F.from_csv("line", f"{PRICE_SCHEMA}, _bad string", {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"})
    x = lines.filter(F.trim("line") != header).select("ticker", "line", parsed.alias("_p"))
    fits = F.col("_p").isNotNull() & F.col("_p._bad").isNull()
    good = nan_to_null(x.filter(fits).select("_p.*", "ticker").drop("_bad"))
    return good, x.filter(~fits).select("ticker", "line")


def read_prices(spark: SparkSession, path: str) -> DataFrame:
    """Price history CSVs without the lines that don't fit."""
    return split_prices(spark, path)[0]


def read_contracts(spark: SparkSession, path: str) -> DataFrame:
    """Contract calendar CSV; rows without a contract or a last trading day are no contracts."""
    raw = spark.read.schema(CONTRACT_SCHEMA).option("header", "true").csv(path)
    return raw.dropna(subset=["contract", "last_trading_day"])


def read_continuous(spark: SparkSession, path: str) -> DataFrame:
    """Continuous series (Date, close_adj) with a known adjusted close."""
    raw = spark.read.parquet(path)
    day = F.col("Date").cast("date").alias("Date")
    return nan_to_null(raw.select(day, "close_adj", *[c for c in raw.columns if c not in ("Date", "close_adj")])).dropna(subset=["close_adj"])


_ACCESS = r'^\S+\s+(\S+)\s+"([A-Z]+)\s+(\S+)[^"]*"\s+(\d+)'


def parse_access_log(df: DataFrame) -> DataFrame:
    """Access-log lines (text in ``value``); lines that do not parse are dropped, other columns are kept."""
    line = F.trim("value")
    def part(i: int) -> Column:
        return F.regexp_extract(line, _ACCESS, i)
    x = df.withColumns({"request_id": part(1), "method": part(2), "path": part(3), "status": part(4).try_cast("int")})
    return x.filter(F.col("request_id") != "").drop("value")
