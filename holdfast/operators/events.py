"""Corporate actions (splits, bonuses) and the quantities they restate.

A trade on day ``d`` is multiplied by the ratio of every quantity event of its
symbol with ``d < ex_date``. Rather than joining each trade to all later
events and multiplying back per trade (a fan-out by the number of events), the
events of a symbol are turned into disjoint validity intervals that each carry
the product of all ratios still to come::

    events e1 < e2 < ... < ek  ->  (-inf, e1): r1*...*rk, [e1, e2): r2*...*rk, ...,
                                    [e(k-1), ek): rk; on or after ek: no interval (1.0)

Every trade then meets at most one interval: a left join on ``symbol`` with a
range condition and no re-aggregation. The interval table grows with the
number of events, not with trades, and the join strategy (broadcast or
sort-merge) is left to the optimizer's size checks.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from holdfast.schemas import QUANTITY_EVENT_TYPES


def corporate_events(feed: DataFrame, start_dates: DataFrame, as_of: str | Column | None = None,
                     types: Iterable[str] = QUANTITY_EVENT_TYPES,
                     date_format: str = "dd MMM yyyy") -> DataFrame:
    """Quantity-changing events of the held symbols: (symbol, ex_date, ratio, type).

    ``start_dates`` is (symbol, start_date), e.g. :func:`earliest_trade_dates`;
    only its symbols are kept, and only events from their first trade up to
    ``as_of`` (default: today). A text ``ex_date`` is parsed with
    ``date_format``; a malformed one fails the job instead of being dropped, and
    so does a quantity event without a ratio, which would count as 1.
    """
    ex_date = F.col("ex_date")
    if isinstance(feed.schema["ex_date"].dataType, StringType):
        # explicit, so a bad date fails whatever the session's ANSI setting
        parsed = F.try_to_date(ex_date, date_format)
        ex_date = F.when(ex_date.isNotNull() & parsed.isNull(),
                         F.raise_error(F.concat(F.lit("unparseable ex_date: "), ex_date))).otherwise(parsed)
    if as_of is None:
        upper = F.current_date()
    elif isinstance(as_of, Column):
        upper = as_of
    else:
        upper = F.lit(as_of).cast("date")
    missing = F.concat(F.lit("event without ratio: "), F.col("type"), F.lit(" of "), F.coalesce("symbol", F.lit("?")))
    ratio = F.when(F.col("ratio").isNull(), F.raise_error(missing)).otherwise(F.col("ratio").cast("double"))
    events = feed.filter(F.col("type").isin(*types)).select(
        "symbol", ex_date.alias("ex_date"), ratio.alias("ratio"), "type"
    )
    return (
        events.join(start_dates.select("symbol", "start_date"), "symbol")
        .filter((F.col("ex_date") >= F.col("start_date")) & (F.col("ex_date") <= upper))
        .select("symbol", "ex_date", "ratio", "type")
    )


def unparsed_events(feed: DataFrame, date_format: str = "dd MMM yyyy") -> DataFrame:
    """Feed rows whose text ``ex_date`` does not parse: the audit of a dirty feed.

    ``corporate_events`` fails on such a row rather than dropping an event
    silently; this lists them (all columns) so a feed can be checked first.
    """
    return feed.filter(F.col("ex_date").isNotNull()
                       & F.try_to_date(F.col("ex_date"), date_format).isNull())


def adjustment_intervals(events: DataFrame) -> DataFrame:
    """(symbol, valid_from, valid_to, factor): the factor for trades in [valid_from, valid_to).

    ``valid_from`` is null for the interval before a symbol's first event.
    Events sharing an ex_date make one interval, so intervals never overlap.
    """
    # One window per symbol, ordered by day number: RANGE frames treat events
    # of the same day as one step, so the suffix product includes them all and
    # the previous ex_date is the previous *distinct* one. The dedupe after it
    # groups on (symbol, ...) and so reuses the window's partitioning: a single
    # shuffle in all.
    day = Window.partitionBy("symbol").orderBy(F.unix_date("ex_date"))
    still_to_come = day.rangeBetween(Window.currentRow, Window.unboundedFollowing)
    before = day.rangeBetween(Window.unboundedPreceding, -1)
    return events.select(
        "symbol",
        F.max("ex_date").over(before).alias("valid_from"),
        F.col("ex_date").alias("valid_to"),
        F.product("ratio").over(still_to_come).alias("factor"),
    ).dropDuplicates(["symbol", "valid_to"])


def _with_factor(net: DataFrame, events: DataFrame) -> DataFrame:
    iv = adjustment_intervals(events).alias("iv")
    trades = net.alias("t")
    on = (
        (F.col("t.symbol") == F.col("iv.symbol"))
        & (F.col("t.trade_date") < F.col("iv.valid_to"))
        & (F.col("iv.valid_from").isNull() | (F.col("t.trade_date") >= F.col("iv.valid_from")))
    )
    return trades.join(iv, on, "left").select(
        "t.*", F.coalesce(F.col("iv.factor"), F.lit(1.0)).alias("factor")
    )


def adjustment_factor(net: DataFrame, events: DataFrame) -> DataFrame:
    """(trade_date, symbol, factor): product of the ratios of later events, 1.0 if none."""
    return _with_factor(net, events).select("trade_date", "symbol", "factor")


def adjust_for_events(net: DataFrame, events: DataFrame) -> DataFrame:
    """The net tradebook with quantities restated in today's shares (double).

    ``average_price`` is left as traded, as in the reference.
    """
    return _with_factor(net, events).select(
        "trade_date", "symbol", "average_price",
        (F.col("quantity") * F.col("factor")).alias("quantity"),
    )
