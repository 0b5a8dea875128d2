"""Registered queries: one per operator key, each over the whole test tables.

Each entry takes (spark, sf_dir) and does all of its own work: a key that uses
the holdings plan builds a new one, so nothing computed by one call serves
another. Inputs come from :mod:`holdfast.sources.adapters`; queries that
exercise a file format read their input from a folder under the cluster's
checkpoint root, written once per session (the files only; never a result).
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.operators import reporting as rep
from holdfast.operators import reshape
from holdfast.operators import securities as sec
from holdfast.plans.holdings import HoldingsPlan, build_holdings
from holdfast.plans.tradebook import load_tradebook
from holdfast.plans.securities import ingest_securities_csv, refresh_securities, write_master
from holdfast.schemas import SECURITIES_COLUMNS
from holdfast.session import scratch_dir
from holdfast.sources import adapters
from holdfast.sources import securities as src
from holdfast.sources.market import read_prices
from holdfast.sources.tradebook import read_tradebook, write_tradebook_csv

# Parameters over the fixture: the lookup asks for active listings in one
# segment, and the wide tables have a column for each of the 25 brands.
LOOKUP_SEGMENT = "Debt or Others"
LOOKUP_STATUS = "Active"
LOOKUP_CODES = [str(500_000 + n) for n in range(1, 41)]
WIDE_SYMBOLS = [f"Brand#{n}" for n in range(1, 26)]


def _inputs(spark: SparkSession, sf_dir: str) -> adapters.Inputs:
    return adapters.Inputs(spark, sf_dir)


def _plan(spark: SparkSession, sf_dir: str, **options) -> HoldingsPlan:
    inputs = _inputs(spark, sf_dir)
    return build_holdings(inputs.tradebook, inputs.prices, inputs.events_feed, **options)


_FILES: dict[tuple, tuple[SparkSession, str]] = {}


def _input_files(spark: SparkSession, sf_dir: str, name: str, write) -> str:
    """Write an input in a file format once per session and folder (a broker
    export, listing snapshots, a hand-over CSV); the keys time only reading it."""
    key = (id(spark), sf_dir, name)
    cached = _FILES.get(key)
    if cached is None or cached[0] is not spark:
        path = scratch_dir(spark, name)
        write(path)
        cached = _FILES[key] = (spark, path)
    return cached[1]


def tradebook_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _input_files(spark, sf_dir, "tradebook-csv",
                        lambda p: write_tradebook_csv(_inputs(spark, sf_dir).tradebook, p))
    return read_tradebook(spark, path, broker="Zerodha")


def tradebook_mixed_headers(spark, sf_dir):
    """One folder of exports whose headers order their columns differently; one has a column more."""

    def write(path):
        rows = _inputs(spark, sf_dir).tradebook
        part = F.col("trade_id").cast("long") % 3
        swapped = [{"quantity": "price", "price": "quantity"}.get(c, c) for c in rows.columns]
        for k, layout in enumerate((rows.columns, swapped, rows.columns[::-1])):
            own = rows.where(part == k).select(*layout)
            write_tradebook_csv(own.withColumn("account", F.lit("main")) if k == 2 else own, path, "append")

    return read_tradebook(spark, _input_files(spark, sf_dir, "tradebook-mixed", write), broker="Zerodha")


def _damaged_export(spark, sf_dir) -> str:
    """An export some of whose lines are cut, too long, or lack or garble a value."""

    def write(path):
        rows = _inputs(spark, sf_dir).tradebook
        n = F.col("trade_id").cast("long")
        rows = rows.withColumns({"quantity": F.when(n % 89 != 3, F.col("quantity")).cast("string"),
                                 "price": F.when(n % 83 == 5, F.lit("1.2.3")).otherwise(F.col("price").cast("string"))})
        line = F.to_csv(F.struct(*rows.columns))
        line = F.when(n % 97 == 1, F.substring_index(line, ",", 8)).when(n % 101 == 2, F.concat(line, F.lit(",x"))).otherwise(line)
        # one column whose name is the header: Spark then writes the lines as they are
        rows.select(line.alias(",".join(rows.columns))).write.option("header", True).option("sep", "\x01").option("quote", "\x02").csv(path)

    return _input_files(spark, sf_dir, "tradebook-damaged", write)


def tradebook_load(spark, sf_dir):
    """Lines of a damaged export by what became of them."""
    load = load_tradebook(spark, _damaged_export(spark, sf_dir), scratch_dir(spark, "tradebook-load"))
    good = load.tradebook.select(F.lit("accepted").alias("outcome"))
    return good.union(load.rejects.select("reason")).groupBy("outcome").agg(F.count("*").alias("lines"))


def tradebook_clean(spark, sf_dir):
    return _plan(spark, sf_dir).clean


def net_tradebook(spark, sf_dir):
    return _plan(spark, sf_dir).net


# Keys that read one branch of the net tradebook scan the executions once
# anyway; writing it out first would only add a job.
def symbols(spark, sf_dir):
    return _plan(spark, sf_dir, materialize=False).symbols


def tenure(spark, sf_dir):
    return _plan(spark, sf_dir, materialize=False).tenure


def earliest_trade_dates(spark, sf_dir):
    return _plan(spark, sf_dir, materialize=False).start_dates


def price_history(spark, sf_dir):
    return _plan(spark, sf_dir).price_history


def corporate_events(spark, sf_dir):
    return _plan(spark, sf_dir, materialize=False).events


def adjustment_factor(spark, sf_dir):
    return _plan(spark, sf_dir).factors


def adjusted_tradebook(spark, sf_dir):
    return _plan(spark, sf_dir).adjusted


def market_days(spark, sf_dir):
    return _plan(spark, sf_dir).market_days


def trades_aligned(spark, sf_dir):
    return _plan(spark, sf_dir).trades_aligned


def position_balance(spark, sf_dir):
    return _plan(spark, sf_dir).balance


def holdings_daily(spark, sf_dir):
    return _plan(spark, sf_dir).holdings


def holdings_carried(spark, sf_dir):
    return _plan(spark, sf_dir, price_fill="carry").holdings


def holdings_off_calendar_drop(spark, sf_dir):
    return _plan(spark, sf_dir, off_calendar="drop").holdings


def trades_wide(spark, sf_dir):
    return reshape.trades_wide(_plan(spark, sf_dir).trades_aligned, WIDE_SYMBOLS)


def quotes_wide(spark, sf_dir):
    return reshape.quotes_wide(_plan(spark, sf_dir).price_history, WIDE_SYMBOLS)


def holdings_wide(spark, sf_dir):
    return reshape.holdings_wide(_plan(spark, sf_dir).holdings, WIDE_SYMBOLS)


def holdings_unpivot(spark, sf_dir):
    return reshape.melt(holdings_wide(spark, sf_dir))


def holdings_melt(spark, sf_dir):
    return rep.melted_holdings(_plan(spark, sf_dir).holdings, "day")


def holdings_melt_weekly(spark, sf_dir):
    return rep.melted_holdings(_plan(spark, sf_dir).holdings, "week")


def holdings_melt_monthly(spark, sf_dir):
    return rep.melted_holdings(_plan(spark, sf_dir).holdings, "month")


def holdings_melt_yearly(spark, sf_dir):
    return rep.melted_holdings(_plan(spark, sf_dir).holdings, "year")


def holdings_weekly(spark, sf_dir):
    return rep.resample(_plan(spark, sf_dir).holdings, "week")


def holdings_monthly(spark, sf_dir):
    return rep.resample(_plan(spark, sf_dir).holdings, "month")


def holdings_yearly(spark, sf_dir):
    return rep.resample(_plan(spark, sf_dir).holdings, "year")


def holdings_monthly_last(spark, sf_dir):
    return rep.resample(_plan(spark, sf_dir).holdings, "month", how="last")


def holdings_all_periods(spark, sf_dir):
    return rep.resample_all(_plan(spark, sf_dir).holdings)


def latest_allocation_carried(spark, sf_dir):
    return _plan(spark, sf_dir, price_fill="carry").latest_allocation("month")


def portfolio_valuation(spark, sf_dir):
    return rep.portfolio_valuation(_plan(spark, sf_dir).holdings)


def latest_allocation(spark, sf_dir):
    return _plan(spark, sf_dir).latest_allocation("day")


def _allocation(spark, sf_dir, granularity):
    return _plan(spark, sf_dir).latest_allocation(granularity)


def latest_allocation_weekly(spark, sf_dir):
    return _allocation(spark, sf_dir, "week")


def latest_allocation_monthly(spark, sf_dir):
    return _allocation(spark, sf_dir, "month")


def latest_allocation_yearly(spark, sf_dir):
    return _allocation(spark, sf_dir, "year")


def price_feed(spark, sf_dir):
    """A price feed whose timestamps are text."""
    text = _inputs(spark, sf_dir).prices.select(F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), "symbol", "quote")
    path = _input_files(spark, sf_dir, "prices-csv", lambda p: text.write.option("header", True).csv(p))
    return read_prices(spark, path, fmt="csv")


def securities_lookup(spark, sf_dir):
    return sec.lookup_codes(_plan(spark, sf_dir, materialize=False).symbols, _inputs(spark, sf_dir).securities,
                            LOOKUP_SEGMENT, LOOKUP_STATUS)


def unknown_symbols(spark, sf_dir):
    return sec.unknown_symbols(_plan(spark, sf_dir, materialize=False).symbols, _inputs(spark, sf_dir).securities,
                               LOOKUP_SEGMENT, LOOKUP_STATUS)


def segment_codes(spark, sf_dir):
    segments = _inputs(spark, sf_dir).securities.select("segment").distinct()
    segments = segments.union(segments.select(F.concat("segment", F.lit(" (old)"))))  # names without a code
    return segments.select("segment", sec.segment_code("segment").alias("code"))


def segment_slug(spark, sf_dir):
    segments = _inputs(spark, sf_dir).securities.select("segment").distinct()
    return segments.select("segment", sec.segment_slug("segment").alias("slug"))


def _snapshots(spark, sf_dir) -> str:
    return _input_files(spark, sf_dir, "securities-json",
                        lambda p: src.write_snapshots(adapters.securities_full_view(spark, sf_dir), p))


def securities_normalise(spark, sf_dir):
    return sec.normalise_securities(src.read_snapshots(spark, _snapshots(spark, sf_dir)))


def securities_refresh(spark, sf_dir):
    return refresh_securities(spark, _snapshots(spark, sf_dir), scratch_dir(spark, "securities-table"))


def securities_pretty(spark, sf_dir):
    """Snapshots that are one array per segment, laid out over lines."""
    path = _input_files(spark, sf_dir, "securities-pretty", lambda p: src.write_snapshots(adapters.securities_full_view(spark, sf_dir), p, pretty=True))
    return sec.normalise_securities(src.read_snapshots(spark, path, multi_line=True))


def securities_concurrent(spark, sf_dir):
    """The master after two bulk loads of half the rows each that ran at the same time."""
    rows = adapters.securities_full_view(spark, sf_dir)
    odd = F.col("scrip_code").cast("long") % 2
    halves = [_input_files(spark, sf_dir, f"securities-half-{k}", lambda p, k=k: src.write_securities_csv(rows.where(odd == k), p)) for k in (0, 1)]
    table = scratch_dir(spark, "securities-table")
    with ThreadPoolExecutor(2) as loads:
        list(loads.map(lambda half: ingest_securities_csv(spark, half, table), halves))
    return src.read_securities_table(spark, table).select(*SECURITIES_COLUMNS)


def _master_with_isin(spark, sf_dir) -> DataFrame:
    rows = adapters.securities_full_view(spark, sf_dir).withColumn("isin_number", F.concat(F.lit("INE"), F.col("scrip_code")))
    table = scratch_dir(spark, "securities-table")
    write_master(sec.with_security_id(rows), table)
    return src.read_securities_table(spark, table)


def securities_by_code(spark, sf_dir):
    return sec.securities_by(_master_with_isin(spark, sf_dir), "scrip_code", LOOKUP_CODES).select("scrip_code", "segment", "scrip_id", "security_name")


def securities_by_isin(spark, sf_dir):
    """The part keys as ISINs; only those that the master lists have a security."""
    wanted = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.concat(F.lit("INE"), 500000 + F.col("p_partkey")).alias("isin_number"))
    return sec.lookup_securities(wanted, _master_with_isin(spark, sf_dir), "isin_number").select("isin_number", "scrip_code", "segment", "scrip_id")


def securities_ids(spark, sf_dir):
    """Every row of the master has an id of its own, also rows that repeat a record."""
    rows = adapters.securities_full_view(spark, sf_dir)
    keyed = sec.with_security_id(rows.union(rows.withColumn("scrip_code", F.lit(None).cast("string"))).union(rows))
    return keyed.groupBy("segment").agg(F.count("*").alias("rows"), F.count_distinct("id").alias("ids"))


def securities_roundtrip(spark, sf_dir):
    path = _input_files(spark, sf_dir, "securities-csv",
                        lambda p: src.write_securities_csv(adapters.securities_full_view(spark, sf_dir), p))
    table = ingest_securities_csv(spark, path, scratch_dir(spark, "securities-table"))
    return table.select(*SECURITIES_COLUMNS)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "tradebook_scan": tradebook_scan,
    "tradebook_mixed_headers": tradebook_mixed_headers,
    "tradebook_load": tradebook_load,
    "tradebook_clean": tradebook_clean,
    "net_tradebook": net_tradebook,
    "symbols": symbols,
    "tenure": tenure,
    "earliest_trade_dates": earliest_trade_dates,
    "price_history": price_history,
    "price_feed": price_feed,
    "corporate_events": corporate_events,
    "adjustment_factor": adjustment_factor,
    "adjusted_tradebook": adjusted_tradebook,
    "market_days": market_days,
    "trades_aligned": trades_aligned,
    "trades_wide": trades_wide,
    "quotes_wide": quotes_wide,
    "position_balance": position_balance,
    "holdings_daily": holdings_daily,
    "holdings_wide": holdings_wide,
    "holdings_melt": holdings_melt,
    "holdings_unpivot": holdings_unpivot,
    "holdings_melt_weekly": holdings_melt_weekly,
    "holdings_melt_monthly": holdings_melt_monthly,
    "holdings_melt_yearly": holdings_melt_yearly,
    "holdings_weekly": holdings_weekly,
    "holdings_monthly": holdings_monthly,
    "holdings_yearly": holdings_yearly,
    "holdings_monthly_last": holdings_monthly_last,
    "holdings_carried": holdings_carried,
    "holdings_off_calendar_drop": holdings_off_calendar_drop,
    "holdings_all_periods": holdings_all_periods,
    "portfolio_valuation": portfolio_valuation,
    "latest_allocation": latest_allocation,
    "latest_allocation_weekly": latest_allocation_weekly,
    "latest_allocation_monthly": latest_allocation_monthly,
    "latest_allocation_yearly": latest_allocation_yearly,
    "latest_allocation_carried": latest_allocation_carried,
    "securities_lookup": securities_lookup,
    "unknown_symbols": unknown_symbols,
    "segment_codes": segment_codes,
    "segment_slug": segment_slug,
    "securities_normalise": securities_normalise,
    "securities_refresh": securities_refresh,
    "securities_pretty": securities_pretty,
    "securities_concurrent": securities_concurrent,
    "securities_by_code": securities_by_code,
    "securities_by_isin": securities_by_isin,
    "securities_ids": securities_ids,
    "securities_roundtrip": securities_roundtrip,
}
