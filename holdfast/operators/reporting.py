"""Reports over daily holdings: resampling, portfolio totals, latest allocation.

Money is summed as decimals (and handed back as double) so totals do not
depend on the order Spark happens to add rows in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdfast.functions import exact_sum, truncate_date

HOW = ("sum", "last")


def resample(holdings: DataFrame, granularity: str | None, how: str = "sum") -> DataFrame:
    """Holdings per period start (Monday weeks, months, years) and symbol.

    ``how="sum"`` adds the daily values of the period, as the reference's
    charts do; ``how="last"`` keeps the value on the period's last day.
    Output: timestamp (period start, date), symbol, valuation.
    """
    if how not in HOW:
        raise ValueError(f"how must be one of {HOW}")
    period = truncate_date(granularity, "timestamp").alias("timestamp")
    value = (exact_sum("valuation") if how == "sum"
             else F.max_by("valuation", "timestamp"))
    return holdings.groupBy(period, "symbol").agg(value.alias("valuation"))


def resample_all(holdings: DataFrame) -> DataFrame:
    """All granularities from one pass over the holdings, by grouping sets.

    Output: granularity, timestamp, symbol, valuation. ``day``, ``week``, ``month``
    and ``year`` are as :func:`resample` gives them; ``portfolio`` is the total of
    all positions per day (no symbol); ``total`` adds all days of a symbol (no
    timestamp). A report then is a filter on ``granularity``.
    """
    periods = ("day", "week", "month", "year")
    rows = holdings.select("symbol", "valuation", *(truncate_date(p, "timestamp").alias(p) for p in periods))
    # each row is counted once per set before the one exchange; the sets meet again in none
    sets = [*([F.col(p), F.col("symbol")] for p in periods), [F.col("day")], [F.col("symbol")]]
    totals = rows.groupingSets(sets, *periods, "symbol").agg(
        F.grouping_id().alias("absent"), exact_sum("valuation").alias("valuation"))
    # grouping_id has a bit for each grouping column that a set lacks: day, week, month, year, symbol
    lacking = {"day": 0b01110, "week": 0b10110, "month": 0b11010, "year": 0b11100, "portfolio": 0b01111, "total": 0b11110}
    name = F.coalesce(*(F.when(F.col("absent") == bits, F.lit(g)) for g, bits in lacking.items()))
    return totals.select(name.alias("granularity"), F.coalesce(*periods).alias("timestamp"), "symbol", "valuation")


def portfolio_valuation(holdings: DataFrame) -> DataFrame:
    """Total value of all positions per day: (timestamp, valuation)."""
    return holdings.groupBy("timestamp").agg(exact_sum("valuation").alias("valuation"))


def latest_allocation(holdings: DataFrame) -> DataFrame:
    """Positions on the latest date and their share of that day's total.

    Output: symbol, valuation, percentage (rounded to 2; null if the total is 0).
    One pass over the holdings: each symbol's last row (partial aggregation on
    the map side), then two windows over one row per symbol.
    """
    last = holdings.groupBy("symbol").agg(F.max("timestamp").alias("timestamp"), F.max_by("valuation", "timestamp").alias("valuation"))
    everyone = Window.partitionBy()
    latest = last.withColumn("latest", F.max("timestamp").over(everyone)).filter("timestamp = latest")
    total = F.sum(F.col("valuation").cast("decimal(20,2)")).over(everyone).cast("double")
    return latest.withColumn("total", total).select("symbol", "valuation", _share().alias("percentage"))


def share_of_total(positions: DataFrame) -> DataFrame:
    """Positions (symbol, valuation) with their share of the total, rounded to 2.

    The total is a one-row aggregate, partly summed where the rows are: no task
    sees all symbols.
    """
    total = positions.agg(exact_sum("valuation")).scalar()
    return positions.withColumn("total", total).select("symbol", "valuation", _share().alias("percentage"))


def _share() -> Column:
    return F.round(F.try_divide(F.col("valuation"), F.col("total")) * 100, 2)


def melted_holdings(holdings: DataFrame, granularity: str | None = None) -> DataFrame:
    """The chart table: Date (text), Security, Valuation, one row per period and symbol.

    The holdings are long already, so resampling and renaming is all there is
    to do; no wide step, whatever the number of symbols.
    """
    return resample(holdings, granularity).select(
        F.col("timestamp").cast("string").alias("Date"), F.col("symbol").alias("Security"), F.col("valuation").alias("Valuation"))
