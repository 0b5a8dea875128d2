"""Wide (one column per symbol) views and the way back to long form.

The engine computes in long form; wide tables exist only at the edge, for
readers that want a column per symbol. Their columns are the ``symbols`` that
the caller names: they are the schema of the result, and belong to its reader.
The pivot is one aggregation by ``timestamp`` and spends no job on finding
values. Symbols with '.', '&' or '-' in their name are fine: the columns are
only ever addressed through ``col()`` with backticks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _pivot(long: DataFrame, value: str, symbols: Sequence[str], suffix: str,
           agg=F.max) -> DataFrame:
    if not symbols:
        return long.select("timestamp").distinct()
    pivoted = long.groupBy("timestamp").pivot("symbol", list(symbols)).agg(agg(value))
    if not suffix:
        return pivoted
    return pivoted.select(
        "timestamp",
        *[F.col(f"`{c}`").alias(f"{c}{suffix}") for c in pivoted.columns if c != "timestamp"],
    )


def trades_wide(aligned: DataFrame, symbols: Sequence[str]) -> DataFrame:
    """timestamp plus one ``<symbol>_quantity`` column (0 where nothing traded)."""
    return _pivot(aligned, "quantity", symbols, "_quantity", agg=F.sum)


def quotes_wide(price_hist: DataFrame, symbols: Sequence[str]) -> DataFrame:
    """timestamp plus one ``<symbol>_quote`` column (null where a symbol has no price)."""
    return _pivot(price_hist, "quote", symbols, "_quote")


def holdings_wide(holdings: DataFrame, symbols: Sequence[str]) -> DataFrame:
    """timestamp plus one ``<symbol>`` column holding the valuation."""
    return _pivot(holdings, "valuation", symbols, "")


def melt(wide: DataFrame, id_column: str = "timestamp", var_name: str = "Security",
         value_name: str = "Valuation", date_name: str = "Date") -> DataFrame:
    """Wide to long: (Date as text, Security, Valuation), one row per cell."""
    values = [c for c in wide.columns if c != id_column]
    if not values:   # no symbols at all: the long form is empty, not an error
        return wide.filter(F.lit(False)).select(
            F.col(id_column).cast("string").alias(date_name),
            F.lit(None).cast("string").alias(var_name),
            F.lit(None).cast("double").alias(value_name),
        )
    long = wide.unpivot([id_column], [F.col(f"`{c}`") for c in values], var_name, value_name)
    return long.select(
        F.col(id_column).cast("string").alias(date_name), var_name, value_name
    )
