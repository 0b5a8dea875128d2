"""holdfast: trade-ledger and holdings analytics as Spark DataFrame operators.

Executions are netted per day and symbol, restated for splits and bonuses,
run forward over the market calendar, valued and reported, all as lazy
DataFrame transformations over long tables keyed by symbol.
"""

from holdfast.plans.holdings import HoldingsPlan, build_holdings, holdings_from_files
from holdfast.plans.securities import refresh_securities
from holdfast.session import checkpoint_root, get_session, scratch_dir

__all__ = [
    "HoldingsPlan",
    "build_holdings",
    "checkpoint_root",
    "get_session",
    "holdings_from_files",
    "refresh_securities",
    "scratch_dir",
]
