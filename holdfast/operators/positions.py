"""Positions over the market calendar, and what they are worth.

Long form throughout: (timestamp, symbol, ...). The daily grid (every market
day for every held symbol) is generated per symbol by exploding the set of
market days, one array in a scalar subquery: distinct days, cut to the tenure,
so at most one entry per calendar day whatever the data volume, and a mistyped
trade year adds no rows.

The running balance and the day's price come out of one window pass: grid
rows, trade rows and price rows are unioned and ordered per symbol, so a
position and its price meet without a join on (day, symbol). Each input is
hash-partitioned by ``symbol`` before the union (trades and prices are
shuffled once, the grid is generated after the small shuffle of the symbols),
so the union feeds the window with no exchange in between and the (symbols x
days) rows are never shuffled. A symbol's rows number at most its days plus
its trade days plus its price days, since trades were netted and quotes are
reduced to one per day before: a symbol with a third of all executions, or a
feed with many quotes a day, does not make its window task larger.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdfast.functions import truncate_date
from holdfast.operators.tradebook import bounds
from holdfast.schemas import PRICE_TICKER_SUFFIX

OFF_CALENDAR = ("keep", "drop")
PRICE_FILL = ("zero", "carry")


def price_history(prices: DataFrame, symbols: DataFrame, tenure: DataFrame | tuple[Column, Column],
                  suffix: str = PRICE_TICKER_SUFFIX) -> DataFrame:
    """Quotes of the held symbols inside the tenure [start_date, end_date).

    ``tenure`` is a one-row frame, or its two bounds as literal columns: those
    reach the scan, so files and row groups outside the tenure are skipped.
    Output: timestamp, symbol, ticker (symbol plus the feed's suffix), quote
    rounded to two decimals.
    """
    start, end = tenure if isinstance(tenure, tuple) else bounds(tenure)
    return (
        prices.filter((F.col("timestamp") >= start) & (F.col("timestamp") < end))
        .join(symbols, "symbol", "left_semi")
        .select(
            "timestamp",
            "symbol",
            F.concat(F.col("symbol"), F.lit(suffix)).alias("ticker"),
            F.round("quote", 2).alias("quote"),
        )
    )


def market_days(price_hist: DataFrame) -> DataFrame:
    """Days on which any held symbol has a price (one column, ``timestamp``)."""
    return price_hist.select("timestamp").distinct()


def trading_grid(symbols: DataFrame, days: DataFrame, tenure: DataFrame) -> DataFrame:
    """(symbol, timestamp) for every symbol and every distinct day of ``days`` in the tenure.

    The days are one array (a scalar subquery, at most one entry per calendar
    day of the tenure) that every symbol row explodes: no join at all.
    """
    start, end = bounds(tenure)
    inside = days.filter((F.col("timestamp") >= start) & (F.col("timestamp") < end))
    every = inside.agg(F.collect_set("timestamp")).scalar()
    # hash-partitioned by symbol before the explode: the (symbols x days) rows
    # are generated in as many tasks as the other inputs of the window use,
    # and never shuffled themselves
    return symbols.select("symbol").repartition("symbol").select("symbol", F.explode(every).alias("timestamp"))


def _trade_rows(adjusted: DataFrame, market: DataFrame, off_calendar: str) -> DataFrame:
    if off_calendar not in OFF_CALENDAR:
        raise ValueError(f"off_calendar must be one of {OFF_CALENDAR}")
    trades = adjusted.select("symbol", F.col("trade_date").alias("timestamp"), "quantity")
    if off_calendar == "drop":
        trades = trades.join(market.select("timestamp"), "timestamp", "left_semi")
    return trades.repartition("symbol")


def trades_aligned(adjusted: DataFrame, market: DataFrame, symbols: DataFrame, tenure: DataFrame,
                   off_calendar: str = "keep", net: DataFrame | None = None) -> DataFrame:
    """Quantity traded per (day, symbol) over the market days and the trade days, 0 if none.

    With ``off_calendar="keep"`` a trade on a day without prices keeps its
    own row (its day joins the grid); ``"drop"`` leaves such trades out. The
    trade days come from ``net`` where it is given: the adjustment does not
    change them, so the event join need not run for them.
    """
    trades = _trade_rows(adjusted, market, off_calendar)
    days = market.select("timestamp")
    if off_calendar == "keep":
        traded = (adjusted if net is None else net).select(F.col("trade_date").alias("timestamp"))
        days = days.union(traded.distinct())
    grid = trading_grid(symbols, days, tenure).select(
        "symbol", "timestamp", F.lit(True).alias("on_grid"), F.lit(0.0).alias("quantity"))
    rows = grid.unionByName(trades.select(
        "symbol", "timestamp", F.lit(False).alias("on_grid"), F.col("quantity").cast("double").alias("quantity")))
    # the day's quantity through the per-symbol window: both inputs already
    # arrive partitioned by symbol, so the grid is not shuffled again
    return (
        rows.select("timestamp", "symbol", "on_grid", F.sum("quantity").over(_today()).alias("quantity"))
        .filter("on_grid")
        .drop("on_grid")
    )


def _day_rows(adjusted: DataFrame, market: DataFrame, symbols: DataFrame, tenure: DataFrame,
              off_calendar: str, price_hist: DataFrame | None) -> DataFrame:
    """Grid, trade and (optionally) price rows in one frame, ready for the window."""
    null_quote = F.lit(None).cast("double")
    grid = trading_grid(symbols, market, tenure).select(
        "symbol", "timestamp", F.lit(True).alias("on_grid"), F.lit(0.0).alias("quantity"),
        null_quote.alias("quote"))
    trades = _trade_rows(adjusted, market, off_calendar).select(
        "symbol", "timestamp", F.lit(False).alias("on_grid"),
        F.col("quantity").cast("double").alias("quantity"), null_quote.alias("quote"))
    rows = grid.unionByName(trades)
    if price_hist is not None:
        # one quote a day, the highest, before the rows of a symbol meet
        daily = price_hist.groupBy("symbol", "timestamp").agg(F.max(F.col("quote").cast("double")).alias("quote"))
        rows = rows.unionByName(daily.repartition("symbol").select(
            "symbol", "timestamp", F.lit(False).alias("on_grid"), F.lit(0.0).alias("quantity"), "quote"))
    return rows


def _up_to_today():
    """Per symbol, every row dated on or before the current row's day."""
    return (Window.partitionBy("symbol").orderBy("timestamp")
            .rangeBetween(Window.unboundedPreceding, Window.currentRow))


def _today():
    """Per symbol, the rows of the current row's day."""
    return (Window.partitionBy("symbol").orderBy("timestamp")
            .rangeBetween(Window.currentRow, Window.currentRow))


def position_balance(adjusted: DataFrame, market: DataFrame, symbols: DataFrame, tenure: DataFrame,
                     off_calendar: str = "keep") -> DataFrame:
    """Running quantity held per (market day, symbol): (timestamp, symbol, balance).

    The running sum covers every trade up to and including the day, also
    trades on days without prices (unless ``off_calendar="drop"``); the
    result is cut to the market days.
    """
    rows = _day_rows(adjusted, market, symbols, tenure, off_calendar, None)
    return (
        rows.select("timestamp", "symbol", "on_grid",
                    F.sum("quantity").over(_up_to_today()).alias("balance"))
        .filter("on_grid")
        .drop("on_grid")
    )


def holdings(adjusted: DataFrame, price_hist: DataFrame, market: DataFrame, symbols: DataFrame,
             tenure: DataFrame, off_calendar: str = "keep", price_fill: str = "zero") -> DataFrame:
    """Value of each position per market day: (timestamp, symbol, valuation).

    valuation = round(quote * balance, 2). A day without a quote for the
    symbol is valued at 0 (``price_fill="zero"``, as the reference does) or at
    the last known quote (``"carry"``).
    """
    if price_fill not in PRICE_FILL:
        raise ValueError(f"price_fill must be one of {PRICE_FILL}")
    rows = _day_rows(adjusted, market, symbols, tenure, off_calendar, price_hist)
    # the day's quote is the highest of the day, so a feed with two quotes for
    # a day still gives one answer; "carry" takes it from the last priced day
    rows = rows.withColumn("quote", F.max("quote").over(_today()))
    if price_fill == "zero":
        quote = F.col("quote")
    else:
        quote = F.last("quote", ignorenulls=True).over(_up_to_today())
    valued = rows.select(
        "timestamp", "symbol", "on_grid",
        F.sum("quantity").over(_up_to_today()).alias("balance"),
        F.coalesce(quote, F.lit(0.0)).alias("quote"),
    )
    return valued.filter("on_grid").select(
        "timestamp", "symbol", F.round(F.col("quote") * F.col("balance"), 2).alias("valuation")
    )


def latest_holdings(adjusted: DataFrame, price_hist: DataFrame, market: DataFrame, symbols: DataFrame, tenure: DataFrame,
                    granularity: str | None = None, off_calendar: str = "keep", price_fill: str = "zero") -> DataFrame:
    """Value of each position over the latest day, week, month or year: (symbol, valuation).

    What :func:`holdings`, resampled, has for its last period, without the
    history before it: trades before the period are one sum per symbol, and of the
    prices only the period's (and with ``carry`` the last one before it) are
    read. No grid and no window: a symbol's days, trades and quotes of the period
    are one array, at most three entries a day, that is walked through in order.
    """
    if price_fill not in PRICE_FILL:
        raise ValueError(f"price_fill must be one of {PRICE_FILL}")
    begin, end = bounds(tenure)
    days = market.select("timestamp").filter((F.col("timestamp") >= begin) & (F.col("timestamp") < end))
    start = truncate_date(granularity, days.agg(F.max("timestamp")).scalar())
    in_period = F.col("timestamp") >= start
    last_day = days.agg(F.max("timestamp")).scalar()

    # what happens on a day, in order: trades, then the day's quote, then its valuation
    entry = lambda kind, value: F.struct(F.col("timestamp").alias("day"), F.lit(kind).alias("kind"), value.cast("double").alias("value"))
    trades = _trade_rows(adjusted, market, off_calendar).where(F.col("timestamp") <= last_day)
    trades = trades.groupBy("symbol").agg(
        F.sum(F.when(~in_period, F.col("quantity").cast("double"))).alias("opening"),
        F.collect_list(F.when(in_period, entry(0, F.col("quantity")))).alias("events"))
    quotes = price_hist.select("symbol", "timestamp", F.col("quote").cast("double").alias("quote")).where("quote IS NOT NULL")
    if price_fill == "zero":
        quotes = quotes.where(in_period)
    daily = quotes.groupBy("symbol", "timestamp").agg(F.max("quote").alias("quote")).repartition("symbol")
    priced = daily.groupBy("symbol").agg(
        F.max_by(F.when(~in_period, F.col("quote")), F.when(~in_period, F.col("timestamp"))).alias("carried"),
        F.collect_list(F.when(in_period, entry(1, F.col("quote")))).alias("quoted"))

    closes = days.where(in_period).agg(F.collect_set(entry(2, F.lit(0.0)))).scalar()
    none = F.array().cast("array<struct<day: date, kind: int, value: double>>")
    null = F.lit(None).cast("double")

    def step(state, e):
        value = F.round(F.coalesce(state["quote"], F.lit(0.0)) * state["balance"], 2)
        return F.struct(
            F.when(e["kind"] == 0, state["balance"] + e["value"]).otherwise(state["balance"]).alias("balance"),
            F.when(e["kind"] == 1, e["value"]).when(e["kind"] == 2, state["quote"] if price_fill == "carry" else null).otherwise(state["quote"]).alias("quote"),
            F.when(e["kind"] == 2, (state["total"] + value.cast("decimal(20,2)")).cast("decimal(30,2)")).otherwise(state["total"]).alias("total"))

    opening = F.struct(
        F.coalesce("opening", F.lit(0.0)).alias("balance"), (F.col("carried") if price_fill == "carry" else null).alias("quote"),
        F.lit(0).cast("decimal(30,2)").alias("total"))
    held = symbols.select("symbol").join(trades, "symbol", "left").join(priced, "symbol", "left").where(last_day.isNotNull())
    walk = F.sort_array(F.concat(F.coalesce("events", none), F.coalesce("quoted", none), closes))
    held = held.select("symbol", "opening", "carried", walk.alias("walk"))
    return held.select("symbol", F.aggregate("walk", opening, step, lambda s: s["total"].cast("double")).alias("valuation"))
