"""The holdings pipeline, end to end: tradebook to daily valued positions.

Every stage is a DataFrame. With ``materialize`` (the default) reading
``symbols``, ``price_history`` or anything built on them starts the job that
writes the net tradebook or the price history; all else is lazy, and only the
one-row tenure is brought to the driver. The net tradebook
feeds six branches (symbols, tenure, first trade dates, events, adjustment,
grid), and each branch needs different columns of it, so Catalyst prunes
each copy differently and no exchange can be shared: left lazy, the raw
executions would be scanned once per branch. With ``materialize`` (the
default) the net tradebook is written once, as Parquet, to a fresh folder
under the cluster's checkpoint root and read back: the raw scan runs exactly
once, the branches read a table of at most (days x symbols) rows with real
size statistics, and lineage is cut there, so a lost executor recomputes from
that table and not from the raw files. The held symbols' price history is
written the same way, as every report reads it twice. ``close()`` removes both.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.operators import events as ev
from holdfast.operators import positions as pos
from holdfast.operators import reporting as rep
from holdfast.operators import tradebook as tb
from holdfast.session import remove_folder, scratch_dir


def write_and_read(df: DataFrame, name: str, folders: list[str]) -> DataFrame:
    """Write ``df`` once to a new folder in the shared checkpoint root, noted in
    ``folders``; return the re-read table."""
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    folders.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@dataclass
class HoldingsPlan:
    """All stages of one portfolio, as lazy DataFrames.

    tradebook: canonical executions; prices: (timestamp, symbol, quote);
    events_feed: (symbol, details, ex_date, ratio, type, amount), ex_date as
    text or date. Instead of a tradebook, ``executions`` may give already
    cleaned rows (trade_date, symbol, signed quantity, price), such as the
    table the streaming intake appends to.

    Switches: ``off_calendar`` ("keep" | "drop") for trades on days without
    prices; ``price_fill`` ("zero" | "carry") for days without a quote;
    ``calendar`` (a frame with a ``timestamp`` column) replaces the market days
    taken from the price history; ``end`` ends the valuation window (default:
    the day after the last trade); ``as_of`` bounds the events (default today).
    """

    tradebook: DataFrame | None
    prices: DataFrame
    events_feed: DataFrame
    executions: DataFrame | None = None
    segment: str | None = None
    as_of: str | None = None
    off_calendar: str = "keep"
    price_fill: str = "zero"
    materialize: bool = True
    calendar: DataFrame | None = None
    end: str | None = None
    scratch: list[str] = field(default_factory=list, init=False, repr=False)

    def close(self) -> None:
        """Remove the tables this plan wrote; its frames cannot be read afterwards."""
        while self.scratch:
            remove_folder(self.prices.sparkSession, self.scratch.pop())

    def __enter__(self) -> HoldingsPlan:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    @cached_property
    def clean(self) -> DataFrame:
        """Cleaned executions: given (e.g. the streaming intake's table) or from the tradebook."""
        if self.executions is not None:
            return self.executions.select("trade_date", "symbol", "quantity", "price")
        return tb.clean_tradebook(self.tradebook, self.segment)

    @cached_property
    def net(self) -> DataFrame:
        """The net daily tradebook, lazy (one scan of the executions)."""
        return tb.net_tradebook(self.clean)

    @cached_property
    def _net(self) -> DataFrame:
        """What the branches read: the net tradebook, written once if ``materialize``."""
        return write_and_read(self.net, "net-tradebook", self.scratch) if self.materialize else self.net

    @cached_property
    def symbols(self) -> DataFrame:
        return tb.symbols(self._net)

    @cached_property
    def tenure(self) -> DataFrame:
        return tb.tenure(self._net, self.end)

    @cached_property
    def start_dates(self) -> DataFrame:
        return tb.earliest_trade_dates(self._net)

    @cached_property
    def price_history(self) -> DataFrame:
        """Quotes of the held symbols in the tenure; written once if ``materialize``.

        Every report reads them twice (as price rows and as the market-day
        set), so the price source is scanned once, not once per use. The net
        table is there already, so its one-row tenure is read back and its
        bounds reach the price scan as literals.
        """
        if not self.materialize:
            return pos.price_history(self.prices, self.symbols, self.tenure)
        row = self.tenure.first()
        literals = (F.lit(row["start_date"]).cast("date"), F.lit(row["end_date"]).cast("date"))
        return write_and_read(pos.price_history(self.prices, self.symbols, literals), "price-history", self.scratch)

    @cached_property
    def events(self) -> DataFrame:
        return ev.corporate_events(self.events_feed, self.start_dates, self.as_of)

    @cached_property
    def factors(self) -> DataFrame:
        return ev.adjustment_factor(self._net, self.events)

    @cached_property
    def adjusted(self) -> DataFrame:
        return ev.adjust_for_events(self._net, self.events)

    @cached_property
    def market_days(self) -> DataFrame:
        """The union of the held symbols' price days, or the given ``calendar`` cut to the tenure."""
        if self.calendar is None:
            return pos.market_days(self.price_history)
        start, end = tb.bounds(self.tenure)
        days = self.calendar.select(F.col("timestamp").cast("date").alias("timestamp")).distinct()
        return days.filter((F.col("timestamp") >= start) & (F.col("timestamp") < end))

    @cached_property
    def trades_aligned(self) -> DataFrame:
        return pos.trades_aligned(self.adjusted, self.market_days, self.symbols, self.tenure,
                                  self.off_calendar, self._net)

    @cached_property
    def balance(self) -> DataFrame:
        return pos.position_balance(self.adjusted, self.market_days, self.symbols, self.tenure,
                                    self.off_calendar)

    @cached_property
    def holdings(self) -> DataFrame:
        return pos.holdings(self.adjusted, self.price_history, self.market_days, self.symbols,
                            self.tenure, self.off_calendar, self.price_fill)

    def latest_allocation(self, granularity: str | None = None) -> DataFrame:
        """Positions over the latest day, week, month or year and their shares of
        its total, valued from that period alone."""
        return rep.share_of_total(pos.latest_holdings(
            self.adjusted, self.price_history, self.market_days, self.symbols, self.tenure,
            granularity, self.off_calendar, self.price_fill))


def build_holdings(tradebook: DataFrame, prices: DataFrame, events_feed: DataFrame,
                   **options) -> HoldingsPlan:
    """Wire the pipeline; see :class:`HoldingsPlan` for the options."""
    return HoldingsPlan(tradebook, prices, events_feed, **options)


def holdings_from_files(spark: SparkSession, tradebook_path: str, prices: DataFrame,
                        events_feed: DataFrame, broker: str = "Zerodha", **options) -> HoldingsPlan:
    """Same, starting from a broker's tradebook export."""
    from holdfast.sources.tradebook import read_tradebook

    return build_holdings(read_tradebook(spark, tradebook_path, broker), prices, events_feed, **options)


def holdings_from_executions(executions: DataFrame, prices: DataFrame, events_feed: DataFrame,
                             **options) -> HoldingsPlan:
    """Same, starting from cleaned executions (see ``streaming.read_executions``)."""
    return HoldingsPlan(None, prices, events_feed, executions=executions, **options)
