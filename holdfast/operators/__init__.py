"""DataFrame -> DataFrame operators over long (timestamp, symbol, ...) tables."""

from holdfast.operators.events import (
    adjust_for_events,
    adjustment_factor,
    adjustment_intervals,
    corporate_events,
    unparsed_events,
)
from holdfast.operators.positions import (
    holdings,
    latest_holdings,
    market_days,
    position_balance,
    price_history,
    trades_aligned,
    trading_grid,
)
from holdfast.operators.reporting import (
    latest_allocation,
    melted_holdings,
    portfolio_valuation,
    resample,
    resample_all,
    share_of_total,
)
from holdfast.operators.reshape import holdings_wide, melt, quotes_wide, trades_wide
from holdfast.operators.securities import (
    bad_numbers_audit,
    lookup_codes,
    lookup_securities,
    normalise_securities,
    securities_by,
    segment_audit,
    segment_code,
    segment_slug,
    unknown_symbols,
    with_security_id,
)
from holdfast.operators.tradebook import (
    clean_tradebook,
    earliest_trade_dates,
    net_tradebook,
    symbols,
    tenure,
)

__all__ = [
    "adjust_for_events", "adjustment_factor", "adjustment_intervals", "corporate_events", "unparsed_events",
    "holdings", "latest_holdings", "market_days", "position_balance", "price_history", "trades_aligned", "trading_grid",
    "latest_allocation", "melted_holdings", "portfolio_valuation", "resample", "resample_all", "share_of_total",
    "bad_numbers_audit", "lookup_codes", "lookup_securities", "normalise_securities", "securities_by", "segment_audit", "segment_code", "segment_slug",
    "unknown_symbols", "with_security_id",
    "clean_tradebook", "earliest_trade_dates", "net_tradebook", "symbols", "tenure",
]
