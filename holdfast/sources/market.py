"""Readers for price history and corporate-event feeds.

Both are single long tables keyed by symbol (not one DataFrame per symbol), so
the plan has the same size whatever the number of symbols. Both are strict: a
malformed line, number or date fails the job, with ANSI mode on or off. CSV
columns are bound by the header of the file they stand in, so the files of a feed
may order their columns differently.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from holdfast.functions import strict
from holdfast.schemas import EVENTS_FEED, PRICES
from holdfast.sources.csv_files import all_accepted, malformed_line, missing_or_malformed, read_csv_by_header


def _as_text(schema: StructType) -> StructType:
    return StructType([StructField(f.name, StringType()) for f in schema.fields])


def _read(spark: SparkSession, path: str, fmt: str, schema: StructType) -> DataFrame:
    """The feed's columns by name, as text for CSV and JSON."""
    if fmt == "csv":
        lines = read_csv_by_header(spark, path, schema.fieldNames())
        keyed = F.coalesce(malformed_line(), missing_or_malformed("symbol", F.col("symbol"), required=True))
        return all_accepted(lines, keyed).select(*schema.fieldNames())
    if fmt == "json":
        return spark.read.schema(_as_text(schema)).option("mode", "FAILFAST").json(path)
    return spark.read.format(fmt).load(path).select(*schema.fieldNames())


def _number(name: str) -> F.Column:
    return strict(F.col(name), F.col(name).try_cast("double"), name).alias(name)


def read_prices(spark: SparkSession, path: str, fmt: str = "parquet",
                timestamp_format: str = "yyyy-MM-dd HH:mm:ss") -> DataFrame:
    """Price history as (timestamp date, symbol, quote double).

    Parquet tables are expected to carry a date or timestamp already; CSV and
    JSON feeds deliver ``timestamp`` as text in ``timestamp_format``.
    """
    df = _read(spark, path, fmt, PRICES)
    day = F.col("timestamp")
    if isinstance(df.schema["timestamp"].dataType, StringType):
        day = strict(day, F.try_to_timestamp(day, F.lit(timestamp_format)), "timestamp")
    return df.select(day.cast("date").alias("timestamp"), F.col("symbol").cast("string"), _number("quote"))


def read_events(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Corporate-event feed as delivered: ex_date stays text until it is cleaned."""
    df = _read(spark, path, fmt, EVENTS_FEED)
    numbers = ("ratio", "amount")
    return df.select(*(_number(c) if c in numbers else F.col(c) for c in EVENTS_FEED.fieldNames()))
