"""From executions to a net daily tradebook, and what is derived from it.

Netting is a ``groupBy(trade_date, symbol)``: Spark aggregates partially on the
map side, so a symbol that holds a third of all executions still sends at most
one row per day and map task through the shuffle, and the shuffle keys spread
that symbol over all its days.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.functions import signed_quantity, weighted_average
from holdfast.schemas import DEFAULT_TRADING_SEGMENT, SEGMENT_SERIES


def series_for(segment: str | None = None, series: Iterable[str] | None = None) -> list[str]:
    """The exchange series a trading segment keeps; an unknown segment is an error."""
    if series is not None:
        return list(series)
    name = segment or DEFAULT_TRADING_SEGMENT
    if name not in SEGMENT_SERIES:
        raise ValueError(f"unknown trading segment {name!r}; known: {sorted(SEGMENT_SERIES)}")
    return list(SEGMENT_SERIES[name])


def clean_tradebook(tradebook: DataFrame, segment: str | None = None,
                    series: Iterable[str] | None = None) -> DataFrame:
    """Executions of the wanted series with a signed quantity.

    Output: trade_date, symbol, quantity (long, negative for sales), price.
    Rows whose series is null are dropped, as ``isin`` is never true for null.
    """
    keep = series_for(segment, series)
    return tradebook.filter(F.col("series").isin(*keep)).select(
        "trade_date",
        "symbol",
        signed_quantity("trade_type", "quantity").alias("quantity"),
        "price",
    )


def net_tradebook(clean: DataFrame) -> DataFrame:
    """One row per (trade_date, symbol): weighted average price and net quantity.

    ``average_price`` is null where the day's buys and sells cancel out.
    """
    return clean.groupBy("trade_date", "symbol").agg(
        weighted_average("price", "quantity").alias("average_price"),
        F.sum("quantity").alias("quantity"),
    )


def symbols(net: DataFrame) -> DataFrame:
    """Distinct symbols traded (one column, ``symbol``)."""
    return net.select("symbol").distinct()


def tenure(net: DataFrame, end: str | None = None) -> DataFrame:
    """One row: first trade date and the (exclusive) end of the valuation window.

    The end is the day after the last trade, or ``end`` when given (e.g. today,
    to value holdings up to now).
    """
    end_date = F.date_add(F.max("trade_date"), 1) if end is None else F.lit(end).cast("date")
    return net.agg(F.min("trade_date").alias("start_date"), end_date.alias("end_date"))


def bounds(tenure_row: DataFrame) -> tuple[Column, Column]:
    """A one-row tenure as (start_date, end_date) columns, usable in any expression.

    Both come from one scalar subquery: Spark runs it once, reuses it at every
    place it appears, and folds the value into the plan, so nothing is
    cross-joined and nothing passes through Python.
    """
    row = tenure_row.select(F.struct("start_date", "end_date")).scalar()
    return row.getField("start_date"), row.getField("end_date")


def tenure_bounds(net: DataFrame) -> tuple[Column, Column]:
    """The tenure of a net tradebook as two scalar-subquery columns."""
    return bounds(tenure(net))


def earliest_trade_dates(net: DataFrame) -> DataFrame:
    """First trade date per symbol: (symbol, start_date)."""
    return net.groupBy("symbol").agg(F.min("trade_date").alias("start_date"))
