"""Securities master: cleaning snapshots, refreshing the table, looking up codes."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdfast.functions import falsy_to_null, map_lookup, slug, strict
from holdfast.schemas import (
    DEFAULT_SEGMENT,
    DEFAULT_SEGMENT_CODE,
    EXCHANGE_SEGMENT_CODES,
    EXCHANGE_SEGMENTS,
    SECURITIES,
    SECURITIES_COLUMNS,
    SECURITY_STATUSES,
    SNAPSHOT_KEYS,
)


BAD_NUMBERS = ("fail", "null")


def normalise_securities(snapshots: DataFrame, bad_numbers: str = "fail") -> DataFrame:
    """Snapshot records (segment, a VARIANT per JSON key) to the securities columns.

    Each JSON key is renamed to its column; a value that is absent, null, "",
    false or a numeric zero becomes null (the string "0" stays). A value of a
    numeric column that is not a number fails the job, as a load into a table
    would; with ``bad_numbers="null"`` it becomes null, and
    :func:`bad_numbers_audit` counts such values.
    """
    if bad_numbers not in BAD_NUMBERS:
        raise ValueError(f"bad_numbers must be one of {BAD_NUMBERS}")
    cols = [F.col("segment")]
    for key, column in SNAPSHOT_KEYS.items():
        value, text = _typed(key, column)
        cols.append((strict(text, value, column) if bad_numbers == "fail" else value).alias(column))
    return snapshots.select(*cols).select(*SECURITIES_COLUMNS)


def _typed(key: str, column: str) -> tuple[Column, Column]:
    """A JSON value as its column's type, and as text (null if falsy)."""
    return falsy_to_null(F.col(key), SECURITIES[column].dataType.simpleString()), falsy_to_null(F.col(key), "string")


def bad_numbers_audit(snapshots: DataFrame) -> DataFrame:
    """Values that are not numbers in numeric columns: (segment, column, value, rows)."""
    numeric = [(key, column) for key, column in SNAPSHOT_KEYS.items() if SECURITIES[column].dataType.simpleString() != "string"]
    each = []
    for key, column in numeric:
        value, text = _typed(key, column)
        each.append(F.struct(F.lit(column).alias("column"), F.when(value.isNull(), text).alias("value")))
    found = snapshots.select("segment", F.explode(F.array(*each)).alias("bad")).where("bad.value IS NOT NULL")
    return found.groupBy("segment", "bad.column", "bad.value").agg(F.count("*").alias("rows"))


def with_security_id(securities: DataFrame, load: str = "") -> DataFrame:
    """Add ``id``: a 64-bit key of the row.

    A hash of the whole record, its number among equal records and ``load``, the
    name of a bulk load ("" for a refresh): no global sort or single task is
    needed, and a record that does not change keeps its id across refreshes. Ids
    are unique in all likelihood, as 64-bit hashes are: among a million records
    the chance that any two share one is about 1 in 37 million.
    """
    record = F.xxhash64(*SECURITIES_COLUMNS)
    twin = F.row_number().over(Window.partitionBy(*SECURITIES_COLUMNS).orderBy(record))
    return securities.withColumn("id", F.xxhash64(record, twin, F.lit(load)) if load else F.xxhash64(record, twin))


def layout_for_table(securities: DataFrame) -> DataFrame:
    """Order rows so each segment folder holds files sorted by scrip_id.

    Range partitioning on (segment, scrip_id) splits a large segment over
    several tasks and files, and gives each file a narrow scrip_id min/max for
    Parquet row-group skipping, the access path the reference's indexes gave.
    """
    return securities.repartitionByRange("segment", "scrip_id").sortWithinPartitions("segment", "scrip_id")


def segment_audit(securities: DataFrame, expected: Iterable[str] = EXCHANGE_SEGMENTS) -> DataFrame:
    """Rows per segment (segment, rows): the load audit of a refresh.

    Every ``expected`` segment has a line, with 0 where it had no snapshot.
    """
    found = securities.groupBy("segment").agg(F.count(F.lit(1)).alias("rows"))
    named = securities.sparkSession.sql("SELECT explode(:names) AS segment", {"names": F.array(*map(F.lit, expected))})
    return named.unionByName(found, allowMissingColumns=True).groupBy("segment").agg(F.coalesce(F.max("rows"), F.lit(0)).cast("long").alias("rows"))


def resolve_segment(segment: str | None, valid: Iterable[str] = EXCHANGE_SEGMENTS,
                    default: str = DEFAULT_SEGMENT) -> str:
    """A known segment name as is; anything else becomes the default segment."""
    return segment if segment in set(valid) else default


def resolve_status(status: str | None, valid: Iterable[str] = SECURITY_STATUSES) -> str | None:
    """A known status as is; anything else means "no status filter"."""
    return status if status in set(valid) else None


def _listing(securities: DataFrame, segment: str | None, status: str | None,
             valid_segments: Iterable[str]) -> DataFrame:
    seg = resolve_segment(segment, valid_segments)
    st = resolve_status(status)
    cond = F.col("segment") == F.lit(seg)
    if st is not None:
        cond = cond & (F.col("status") == F.lit(st))
    # one code per scrip_id: the smallest, so duplicates resolve the same way every run
    return (securities.filter(cond).groupBy("scrip_id")
            .agg(F.min("scrip_code").alias("scrip_code")))


def lookup_codes(tickers: DataFrame, securities: DataFrame, segment: str | None = DEFAULT_SEGMENT,
                 status: str | None = None,
                 valid_segments: Iterable[str] = EXCHANGE_SEGMENTS) -> DataFrame:
    """Exchange code per ticker: (symbol, scrip_code), null for unknown tickers.

    ``tickers`` has a ``symbol`` column. Segment and status filters are
    column predicates, so they reach a Parquet or JDBC scan.
    """
    listing = _listing(securities, segment, status, valid_segments)
    return tickers.select("symbol").join(
        listing, F.col("symbol") == F.col("scrip_id"), "left"
    ).select("symbol", "scrip_code")


def unknown_symbols(tickers: DataFrame, securities: DataFrame, segment: str | None = DEFAULT_SEGMENT,
                    status: str | None = None,
                    valid_segments: Iterable[str] = EXCHANGE_SEGMENTS) -> DataFrame:
    """Tickers not listed in the segment (and status): (symbol)."""
    listing = _listing(securities, segment, status, valid_segments)
    return tickers.select("symbol").join(
        listing, F.col("symbol") == F.col("scrip_id"), "left_anti"
    )


LOOKUP_KEYS = ("scrip_code", "isin_number", "scrip_id")
_PUSHED = 10      # values of one IN that Parquet still gets as single values, by Spark's default


def securities_by(securities: DataFrame, key: str, values: Iterable[str]) -> DataFrame:
    """Rows of the master whose ``key`` (an exchange code, an ISIN or a scrip id) is one of a few values.

    The values reach the Parquet scan as equality tests, so row groups are
    skipped by their bloom filter (code, ISIN) or by their range (scrip id). For
    values that are rows of a table use :func:`lookup_securities`.
    """
    if key not in LOOKUP_KEYS:
        raise ValueError(f"key must be one of {LOOKUP_KEYS}")
    values = list(dict.fromkeys(values))
    wanted = F.lit(False)
    for at in range(0, len(values), _PUSHED):
        wanted = wanted | F.col(key).isin(values[at:at + _PUSHED])
    return securities.where(wanted)


def lookup_securities(wanted: DataFrame, securities: DataFrame, key: str) -> DataFrame:
    """Rows of the master for each value in ``wanted``'s column ``key``; a value
    that the master lacks keeps a row with nulls."""
    if key not in LOOKUP_KEYS:
        raise ValueError(f"key must be one of {LOOKUP_KEYS}")
    return wanted.select(key).distinct().join(securities, key, "left")


def segment_code(segment: str | Column) -> Column:
    """The listing service's code of a segment name; unknown names get the default code."""
    return map_lookup(EXCHANGE_SEGMENT_CODES, segment, DEFAULT_SEGMENT_CODE)


def segment_slug(segment: str | Column) -> Column:
    """File-name-safe form of a segment name."""
    return slug(segment)
