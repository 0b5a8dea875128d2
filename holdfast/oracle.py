"""DuckDB oracle: each query key as plain SQL over the driver's tables.

The SQL states every stage the straightforward way (correlated products for
the adjustment, a calendar x symbols grid, window sums), independently of the
Spark formulation, and starts from the same adapter definitions. Each query
text is self-contained: the stages it needs are prepended as CTEs.
"""

from __future__ import annotations

from holdfast.sources.adapters import ADAPTER_SQL
from holdfast.queries import LOOKUP_CODES, LOOKUP_SEGMENT, LOOKUP_STATUS, WIDE_SYMBOLS
from holdfast.schemas import (
    DEFAULT_SEGMENT_CODE,
    EXCHANGE_SEGMENT_CODES,
    EXCHANGE_SEGMENTS,
    PRICE_TICKER_SUFFIX,
    QUANTITY_EVENT_TYPES,
    SEGMENT_SERIES,
    DEFAULT_TRADING_SEGMENT,
)


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _in_list(values) -> str:
    return ", ".join(_quote(v) for v in values)


_SERIES = _in_list(SEGMENT_SERIES[DEFAULT_TRADING_SEGMENT])
_EVENT_TYPES = _in_list(QUANTITY_EVENT_TYPES)
_SEGMENT_CODES = ", ".join(f"({_quote(k)}, {_quote(v)})" for k, v in EXCHANGE_SEGMENT_CODES.items())

_TABLES = {"lineitem": "lineitem", "part": "part"}

# name -> (dependencies, body)
STAGES: dict[str, tuple[list[str], str]] = {
    "v_tradebook": ([], ADAPTER_SQL["v_tradebook"].format(**_TABLES)),
    "v_prices": ([], ADAPTER_SQL["v_prices"].format(**_TABLES)),
    "v_events": ([], ADAPTER_SQL["v_events"].format(**_TABLES)),
    "v_securities": ([], ADAPTER_SQL["v_securities"].format(**_TABLES)),
    "v_securities_full": (["v_securities"], """
SELECT segment, scrip_code, security_name, status, CAST(NULL AS VARCHAR) AS group_name,
       face_value, CAST(NULL AS VARCHAR) AS isin_number, CAST(NULL AS VARCHAR) AS industry,
       scrip_id, CAST(NULL AS VARCHAR) AS nsurl, CAST(NULL AS VARCHAR) AS issuer_name,
       CAST(NULL AS DECIMAL(24,4)) AS market_cap
FROM v_securities"""),
    "clean": (["v_tradebook"], f"""
SELECT trade_date, symbol,
       CASE WHEN trade_type = 'buy' THEN quantity ELSE -quantity END AS quantity,
       price
FROM v_tradebook WHERE series IN ({_SERIES})"""),
    "net": (["clean"], """
SELECT trade_date, symbol,
       CAST(SUM(price * CAST(quantity AS DECIMAL(18,0))) AS DOUBLE)
         / NULLIF(CAST(SUM(quantity) AS DOUBLE), 0) AS average_price,
       CAST(SUM(quantity) AS BIGINT) AS quantity
FROM clean GROUP BY trade_date, symbol"""),
    "symbols": (["net"], "SELECT DISTINCT symbol FROM net"),
    "tenure": (["net"], """
SELECT MIN(trade_date) AS start_date, CAST(MAX(trade_date) + 1 AS DATE) AS end_date FROM net"""),
    "start_dates": (["net"], "SELECT symbol, MIN(trade_date) AS start_date FROM net GROUP BY symbol"),
    "price_history": (["v_prices", "symbols", "tenure"], f"""
SELECT p.timestamp, p.symbol, p.symbol || '{PRICE_TICKER_SUFFIX}' AS ticker, ROUND(p.quote, 2) AS quote
FROM v_prices p, tenure t
WHERE p.symbol IN (SELECT symbol FROM symbols)
  AND p.timestamp >= t.start_date AND p.timestamp < t.end_date"""),
    "events": (["v_events", "start_dates"], f"""
SELECT e.symbol, e.ex_date, e.ratio, e.type
FROM v_events e JOIN start_dates s ON e.symbol = s.symbol
WHERE e.type IN ({_EVENT_TYPES}) AND e.ex_date >= s.start_date AND e.ex_date <= CURRENT_DATE"""),
    "factors": (["net", "events"], """
SELECT n.trade_date, n.symbol,
       COALESCE((SELECT PRODUCT(e.ratio) FROM events e
                 WHERE e.symbol = n.symbol AND n.trade_date < e.ex_date), CAST(1 AS DOUBLE)) AS factor
FROM net n"""),
    "adjusted": (["net", "factors"], """
SELECT n.trade_date, n.symbol, n.average_price, n.quantity * f.factor AS quantity
FROM net n JOIN factors f ON f.trade_date = n.trade_date AND f.symbol = n.symbol"""),
    "market_days": (["price_history"], "SELECT DISTINCT timestamp FROM price_history"),
    "trades_aligned": (["market_days", "adjusted", "symbols"], """
SELECT d.timestamp, s.symbol, COALESCE(a.quantity, CAST(0 AS DOUBLE)) AS quantity
FROM (SELECT timestamp FROM market_days UNION SELECT trade_date FROM adjusted) d
CROSS JOIN symbols s
LEFT JOIN adjusted a ON a.trade_date = d.timestamp AND a.symbol = s.symbol"""),
    "balance": (["trades_aligned", "market_days"], """
SELECT timestamp, symbol, balance FROM (
  SELECT timestamp, symbol,
         SUM(quantity) OVER (PARTITION BY symbol ORDER BY timestamp
                             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS balance
  FROM trades_aligned) r
WHERE timestamp IN (SELECT timestamp FROM market_days)"""),
    "holdings": (["balance", "price_history"], """
SELECT b.timestamp, b.symbol,
       -- + 0.0 turns -0.0 (no price times a short balance) into 0.0, as Spark's round does
       ROUND(COALESCE(p.quote, 0) * b.balance, 2) + CAST(0 AS DOUBLE) AS valuation
FROM balance b LEFT JOIN price_history p ON p.timestamp = b.timestamp AND p.symbol = b.symbol"""),
    "holdings_carried": (["balance", "price_history"], """
SELECT timestamp, symbol, ROUND(COALESCE(carried, 0) * balance, 2) + CAST(0 AS DOUBLE) AS valuation FROM (
  SELECT b.timestamp, b.symbol, b.balance,
         LAST_VALUE(p.quote IGNORE NULLS) OVER (PARTITION BY b.symbol ORDER BY b.timestamp
                             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS carried
  FROM balance b LEFT JOIN price_history p ON p.timestamp = b.timestamp AND p.symbol = b.symbol) c"""),
}


def with_stages(needed: list[str], select: str) -> str:
    """Prepend the CTEs ``select`` needs (and theirs), in dependency order."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for dep in STAGES[name][0]:
            visit(dep)
        order.append(name)

    for name in needed:
        visit(name)
    ctes = ",\n".join(f"{name} AS ({STAGES[name][1].strip()})" for name in order)
    return f"WITH {ctes}\n{select.strip()}"


def _resample(trunc: str) -> str:
    return with_stages(["holdings"], f"""
SELECT CAST(date_trunc('{trunc}', timestamp) AS DATE) AS timestamp, symbol,
       CAST(SUM(CAST(valuation AS DECIMAL(20,2))) AS DOUBLE) AS valuation
FROM holdings GROUP BY 1, 2""")


def _melt(trunc: str) -> str:
    return with_stages(["holdings"], f"""
SELECT CAST(CAST(date_trunc('{trunc}', timestamp) AS DATE) AS VARCHAR) AS Date, symbol AS Security,
       CAST(SUM(CAST(valuation AS DECIMAL(20,2))) AS DOUBLE) AS Valuation
FROM holdings GROUP BY 1, 2""")


def _allocation(trunc: str, holdings: str = "holdings") -> str:
    return with_stages([holdings], f"""
SELECT symbol, valuation, ROUND(valuation / NULLIF(total, 0) * 100, 2) AS percentage
FROM (SELECT symbol, CAST(SUM(CAST(valuation AS DECIMAL(20,2))) AS DOUBLE) AS valuation
      FROM {holdings} WHERE date_trunc('{trunc}', timestamp) = (SELECT date_trunc('{trunc}', MAX(timestamp)) FROM {holdings}) GROUP BY symbol) l,
     (SELECT CAST(SUM(CAST(valuation AS DECIMAL(20,2))) AS DOUBLE) AS total
      FROM {holdings} WHERE date_trunc('{trunc}', timestamp) = (SELECT date_trunc('{trunc}', MAX(timestamp)) FROM {holdings})) t""")


def _wide(stage: str, agg: str, value: str, suffix: str) -> str:
    """One conditional aggregate per symbol: plain columns, so the text also makes a view."""
    columns = ", ".join(f"{agg}(CASE WHEN symbol = {_quote(s)} THEN {value} END) AS \"{s}{suffix}\"" for s in WIDE_SYMBOLS)
    return with_stages([stage], f"SELECT timestamp, {columns} FROM {stage} GROUP BY timestamp")


def _listing(filter_status: bool = True) -> str:
    status = f" AND status = {_quote(LOOKUP_STATUS)}" if filter_status else ""
    return (f"SELECT scrip_id, MIN(scrip_code) AS scrip_code FROM v_securities "
            f"WHERE segment = {_quote(LOOKUP_SEGMENT)}{status} GROUP BY scrip_id")


ORACLE: dict[str, str] = {
    "tradebook_scan": with_stages(["v_tradebook"], "SELECT * FROM v_tradebook"),
    "tradebook_mixed_headers": with_stages(["v_tradebook"], "SELECT * FROM v_tradebook"),
    "tradebook_load": with_stages(["v_tradebook"], """
SELECT CASE WHEN n % 97 = 1 OR n % 101 = 2 THEN 'malformed line: wrong number of fields'
            WHEN n % 89 = 3 THEN 'missing quantity' WHEN n % 83 = 5 THEN 'malformed price: 1.2.3' ELSE 'accepted' END AS outcome,
       COUNT(*) AS lines
FROM (SELECT CAST(trade_id AS BIGINT) AS n FROM v_tradebook) t GROUP BY 1"""),
    "tradebook_clean": with_stages(["clean"], "SELECT * FROM clean"),
    "net_tradebook": with_stages(["net"], "SELECT * FROM net"),
    "symbols": with_stages(["symbols"], "SELECT * FROM symbols"),
    "tenure": with_stages(["tenure"], "SELECT * FROM tenure"),
    "earliest_trade_dates": with_stages(["start_dates"], "SELECT * FROM start_dates"),
    "price_history": with_stages(["price_history"], "SELECT * FROM price_history"),
    "corporate_events": with_stages(["events"], "SELECT * FROM events"),
    "adjustment_factor": with_stages(["factors"], "SELECT * FROM factors"),
    "adjusted_tradebook": with_stages(["adjusted"], "SELECT * FROM adjusted"),
    "market_days": with_stages(["market_days"], "SELECT * FROM market_days"),
    "trades_aligned": with_stages(["trades_aligned"], "SELECT * FROM trades_aligned"),
    "trades_wide": _wide("trades_aligned", "SUM", "quantity", "_quantity"),
    "quotes_wide": _wide("price_history", "MAX", "quote", "_quote"),
    "position_balance": with_stages(["balance"], "SELECT * FROM balance"),
    "holdings_daily": with_stages(["holdings"], "SELECT * FROM holdings"),
    "holdings_wide": _wide("holdings", "MAX", "valuation", ""),
    "holdings_unpivot": with_stages(["holdings"], """
SELECT CAST(timestamp AS VARCHAR) AS Date, symbol AS Security, valuation AS Valuation FROM holdings"""),
    "holdings_melt_weekly": _melt("week"),
    "holdings_melt_monthly": _melt("month"),
    "holdings_melt_yearly": _melt("year"),
    "holdings_melt": with_stages(["holdings"], """
SELECT CAST(timestamp AS VARCHAR) AS Date, symbol AS Security, valuation AS Valuation FROM holdings"""),
    "holdings_weekly": _resample("week"),
    "holdings_monthly": _resample("month"),
    "holdings_yearly": _resample("year"),
    "holdings_monthly_last": with_stages(["holdings"], """
SELECT CAST(date_trunc('month', timestamp) AS DATE) AS timestamp, symbol,
       ARG_MAX(valuation, timestamp) AS valuation
FROM holdings GROUP BY 1, 2"""),
    "holdings_carried": with_stages(["holdings_carried"], "SELECT * FROM holdings_carried"),
    "holdings_off_calendar_drop": with_stages(["market_days", "adjusted", "symbols", "price_history"], """
SELECT d.timestamp, s.symbol, ROUND(COALESCE(p.quote, 0) * b.balance, 2) + CAST(0 AS DOUBLE) AS valuation
FROM market_days d CROSS JOIN symbols s
JOIN (SELECT d.timestamp, s.symbol, COALESCE(SUM(a.quantity), CAST(0 AS DOUBLE)) AS balance
      FROM market_days d CROSS JOIN symbols s
      LEFT JOIN (SELECT * FROM adjusted WHERE trade_date IN (SELECT timestamp FROM market_days)) a
        ON a.symbol = s.symbol AND a.trade_date <= d.timestamp GROUP BY 1, 2) b ON b.timestamp = d.timestamp AND b.symbol = s.symbol
LEFT JOIN price_history p ON p.timestamp = d.timestamp AND p.symbol = s.symbol"""),
    "holdings_all_periods": with_stages(["holdings"], " UNION ALL ".join([*(f"""
SELECT '{g}' AS granularity, CAST(date_trunc('{g}', timestamp) AS DATE) AS timestamp, symbol,
       CAST(SUM(CAST(valuation AS DECIMAL(20,2))) AS DOUBLE) AS valuation FROM holdings GROUP BY 2, 3""" for g in ("day", "week", "month", "year")), """
SELECT 'portfolio', timestamp, NULL, CAST(SUM(CAST(valuation AS DECIMAL(20,2))) AS DOUBLE) FROM holdings GROUP BY timestamp""", """
SELECT 'total', NULL, symbol, CAST(SUM(CAST(valuation AS DECIMAL(20,2))) AS DOUBLE) FROM holdings GROUP BY symbol"""])),
    "portfolio_valuation": with_stages(["holdings"], """
SELECT timestamp, CAST(SUM(CAST(valuation AS DECIMAL(20,2))) AS DOUBLE) AS valuation
FROM holdings GROUP BY timestamp"""),
    "latest_allocation": _allocation("day"),
    "latest_allocation_weekly": _allocation("week"),
    "latest_allocation_monthly": _allocation("month"),
    "latest_allocation_yearly": _allocation("year"),
    "latest_allocation_carried": _allocation("month", "holdings_carried"),
    "securities_lookup": with_stages(["symbols", "v_securities"], f"""
SELECT s.symbol, l.scrip_code FROM symbols s LEFT JOIN ({_listing()}) l ON s.symbol = l.scrip_id"""),
    "unknown_symbols": with_stages(["symbols", "v_securities"], f"""
SELECT s.symbol FROM symbols s WHERE s.symbol NOT IN (SELECT scrip_id FROM ({_listing()}) l)"""),
    "segment_codes": with_stages(["v_securities"], f"""
SELECT s.segment, COALESCE(m.code, {_quote(DEFAULT_SEGMENT_CODE)}) AS code
FROM (SELECT DISTINCT segment FROM v_securities UNION ALL SELECT DISTINCT segment || ' (old)' FROM v_securities) s
LEFT JOIN (VALUES {_SEGMENT_CODES}) m(name, code) ON m.name = s.segment"""),
    "segment_slug": with_stages(["v_securities"], """
SELECT segment, lower(regexp_replace(segment, '[^a-zA-Z0-9]', '_', 'g')) AS slug
FROM (SELECT DISTINCT segment FROM v_securities) s"""),
    "securities_normalise": with_stages(["v_securities_full"], "SELECT * FROM v_securities_full"),
    "securities_refresh": with_stages(["v_securities"], f"""
SELECT e.segment, COUNT(s.segment) AS rows FROM (VALUES {", ".join(f"({_quote(x)})" for x in EXCHANGE_SEGMENTS)}) e(segment)
LEFT JOIN v_securities s ON s.segment = e.segment GROUP BY e.segment"""),
    "securities_pretty": with_stages(["v_securities_full"], "SELECT * FROM v_securities_full"),
    "securities_concurrent": with_stages(["v_securities_full"], "SELECT * FROM v_securities_full"),
    "securities_by_code": with_stages(["v_securities"], f"""
SELECT scrip_code, segment, scrip_id, security_name FROM v_securities WHERE scrip_code IN ({_in_list(LOOKUP_CODES)})"""),
    "securities_by_isin": with_stages(["v_securities"], """
SELECT w.isin_number, s.scrip_code, s.segment, s.scrip_id
FROM (SELECT 'INE' || CAST(500000 + p_partkey AS VARCHAR) AS isin_number FROM part) w
LEFT JOIN v_securities s ON 'INE' || s.scrip_code = w.isin_number"""),
    "securities_ids": with_stages(["v_securities"], """
SELECT segment, 3 * COUNT(*) AS rows, 3 * COUNT(*) AS ids FROM v_securities GROUP BY segment"""),
    "price_feed": with_stages(["v_prices"], "SELECT timestamp, symbol, quote FROM v_prices"),
    "securities_roundtrip": with_stages(["v_securities_full"], "SELECT * FROM v_securities_full"),
}
