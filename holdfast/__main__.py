"""Command line: the holdings reports and the securities refresh as batch jobs.

    python -m holdfast holdings --tradebook T --prices P --events E --out DIR
        [--broker Zerodha] [--segment ...] [--prices-format parquet|csv|json]
        [--events-format json|csv|parquet] [--price-fill zero|carry]
        [--off-calendar keep|drop] [--as-of YYYY-MM-DD] [--end YYYY-MM-DD]
        [--calendar PARQUET]

writes Parquet tables under DIR: holdings_daily, holdings_weekly,
holdings_monthly, holdings_yearly (resampled sums), portfolio_valuation and
latest_allocation, i.e. the data behind the reference's three charts.

    python -m holdfast refresh-securities --snapshots S --table T

rebuilds the securities master from JSON snapshots and prints the audit.
The session is taken from the launcher (spark-submit / cluster defaults).
"""

from __future__ import annotations

import argparse
import os
import sys

from holdfast.operators import latest_allocation, portfolio_valuation, resample
from holdfast.plans.holdings import holdings_from_files
from holdfast.plans.securities import refresh_securities
from holdfast.session import get_session
from holdfast.sources import read_events, read_prices


def _holdings(args: argparse.Namespace) -> int:
    spark = get_session(args.master)
    plan = holdings_from_files(
        spark, args.tradebook,
        read_prices(spark, args.prices, fmt=args.prices_format),
        read_events(spark, args.events, fmt=args.events_format),
        broker=args.broker, segment=args.segment, as_of=args.as_of,
        off_calendar=args.off_calendar, price_fill=args.price_fill, end=args.end,
        calendar=spark.read.parquet(args.calendar) if args.calendar else None,
    )
    # write the daily holdings once, then derive every report from that table:
    # six lazy writes would otherwise run the whole pipeline six times
    daily_path = os.path.join(args.out, "holdings_daily")
    plan.holdings.write.mode("overwrite").parquet(daily_path)
    daily = spark.read.schema(plan.holdings.schema).parquet(daily_path)
    outputs = {
        "holdings_weekly": resample(daily, "week"),
        "holdings_monthly": resample(daily, "month"),
        "holdings_yearly": resample(daily, "year"),
        "portfolio_valuation": portfolio_valuation(daily),
        "latest_allocation": latest_allocation(daily),
    }
    for name, df in outputs.items():
        df.write.mode("overwrite").parquet(os.path.join(args.out, name))
    return 0


def _refresh(args: argparse.Namespace) -> int:
    spark = get_session(args.master)
    for row in refresh_securities(spark, args.snapshots, args.table, args.multi_line).orderBy("segment").collect():
        print(f"{row['segment']}\t{row['rows']}")
    return 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="holdfast")
    parser.add_argument("--master", default=None, help="Spark master (default: the launcher's)")
    sub = parser.add_subparsers(dest="command", required=True)

    h = sub.add_parser("holdings", help="daily holdings and their reports from a broker tradebook")
    h.add_argument("--tradebook", required=True)
    h.add_argument("--prices", required=True)
    h.add_argument("--events", required=True)
    h.add_argument("--out", required=True)
    h.add_argument("--broker", default="Zerodha")
    h.add_argument("--segment", default=None)
    h.add_argument("--prices-format", default="parquet", choices=["parquet", "csv", "json"])
    h.add_argument("--events-format", default="json", choices=["json", "csv", "parquet"])
    h.add_argument("--price-fill", default="zero", choices=["zero", "carry"])
    h.add_argument("--off-calendar", default="keep", choices=["keep", "drop"])
    h.add_argument("--as-of", default=None)
    h.add_argument("--end", default=None, help="end of the valuation window (exclusive), YYYY-MM-DD")
    h.add_argument("--calendar", default=None, help="Parquet table of market days (column timestamp)")
    h.set_defaults(run=_holdings)

    r = sub.add_parser("refresh-securities", help="rebuild the securities master from snapshots")
    r.add_argument("--snapshots", required=True)
    r.add_argument("--table", required=True)
    r.add_argument("--multi-line", action="store_true", help="snapshot files are pretty-printed JSON")
    r.set_defaults(run=_refresh)

    args = parser.parse_args(argv)
    return args.run(args)


if __name__ == "__main__":
    sys.exit(main())
