"""The hand-worked case: every stage against numbers worked out by hand."""

from __future__ import annotations

from conftest import d, rows

from holdfast.operators import latest_allocation, portfolio_valuation, resample
from holdfast.operators.reshape import holdings_wide, melt, quotes_wide, trades_wide


def test_symbols_and_tenure(golden):
    plan = golden()
    assert rows(plan.symbols) == [("AAA",), ("BBB",)]
    assert rows(plan.tenure) == [(d("2024-01-02"), d("2024-02-06"))]
    assert rows(plan.start_dates) == [("AAA", d("2024-01-02")), ("BBB", d("2024-01-03"))]


def test_net_tradebook(golden):
    assert rows(golden().net, "trade_date", "symbol", "average_price", "quantity") == [
        (d("2024-01-02"), "AAA", 105.0, 20),
        (d("2024-01-03"), "BBB", 50.0, 7),
        (d("2024-02-05"), "AAA", 120.0, -5),
    ]


def test_events_and_adjustment(golden):
    plan = golden()
    assert rows(plan.events) == [("AAA", d("2024-02-01"), 2.0, "split")]
    assert rows(plan.adjusted, "trade_date", "symbol", "quantity") == [
        (d("2024-01-02"), "AAA", 40.0),
        (d("2024-01-03"), "BBB", 7.0),
        (d("2024-02-05"), "AAA", -5.0),
    ]
    assert rows(plan.factors, "symbol", "trade_date", "factor") == [
        ("AAA", d("2024-01-02"), 2.0), ("AAA", d("2024-02-05"), 1.0), ("BBB", d("2024-01-03"), 1.0),
    ]


def test_market_days_are_the_union_of_histories(golden):
    assert rows(golden().market_days) == [
        (d("2024-01-02"),), (d("2024-01-03"),), (d("2024-02-01"),), (d("2024-02-05"),)]


DAYS = ["2024-01-02", "2024-01-03", "2024-02-01", "2024-02-05"]


def test_daily_holdings_missing_price_is_zero(golden):
    got = rows(golden().holdings, "symbol", "timestamp", "valuation")
    want = sorted(
        [("AAA", d(x), v) for x, v in zip(DAYS, [2100.0, 2120.0, 2160.0, 2100.0])]
        + [("BBB", d(x), v) for x, v in zip(DAYS, [0.0, 350.0, 0.0, 385.0])]
    )
    assert got == want


def test_daily_holdings_carry_last_price(golden):
    got = rows(golden(price_fill="carry").holdings.filter("symbol = 'BBB'"), "timestamp", "valuation")
    assert got == [(d(x), v) for x, v in zip(DAYS, [0.0, 350.0, 350.0, 385.0])]


def test_balance(golden):
    got = rows(golden().balance.filter("symbol = 'AAA'"), "timestamp", "balance")
    assert got == [(d(x), v) for x, v in zip(DAYS, [40.0, 40.0, 40.0, 35.0])]


def test_portfolio_total(golden):
    got = rows(portfolio_valuation(golden().holdings))
    assert got == [(d(x), v) for x, v in zip(DAYS, [2100.0, 2470.0, 2160.0, 2485.0])]


def test_resample_week_month_year(golden):
    h = golden().holdings
    assert rows(resample(h, "week"), "timestamp", "symbol", "valuation") == [
        (d("2024-01-01"), "AAA", 4220.0), (d("2024-01-01"), "BBB", 350.0),
        (d("2024-01-29"), "AAA", 2160.0), (d("2024-01-29"), "BBB", 0.0),
        (d("2024-02-05"), "AAA", 2100.0), (d("2024-02-05"), "BBB", 385.0),
    ]
    assert rows(resample(h, "month"), "timestamp", "symbol", "valuation") == [
        (d("2024-01-01"), "AAA", 4220.0), (d("2024-01-01"), "BBB", 350.0),
        (d("2024-02-01"), "AAA", 4260.0), (d("2024-02-01"), "BBB", 385.0),
    ]
    assert rows(resample(h, "year"), "timestamp", "symbol", "valuation") == [
        (d("2024-01-01"), "AAA", 8480.0), (d("2024-01-01"), "BBB", 735.0),
    ]
    assert rows(resample(h, "month", how="last"), "timestamp", "symbol", "valuation") == [
        (d("2024-01-01"), "AAA", 2120.0), (d("2024-01-01"), "BBB", 350.0),
        (d("2024-02-01"), "AAA", 2100.0), (d("2024-02-01"), "BBB", 385.0),
    ]


def test_latest_allocation_daily_and_monthly(golden):
    h = golden().holdings
    assert rows(latest_allocation(h)) == [("AAA", 2100.0, 84.51), ("BBB", 385.0, 15.49)]
    assert rows(latest_allocation(resample(h, "month"))) == [("AAA", 4260.0, 91.71), ("BBB", 385.0, 8.29)]


def test_wide_forms_and_melt(golden):
    plan = golden()
    symbols = ["AAA", "BBB"]
    wide = holdings_wide(plan.holdings, symbols)
    assert wide.columns == ["timestamp", "AAA", "BBB"]
    assert rows(wide)[1] == (d("2024-01-03"), 2120.0, 350.0)
    assert trades_wide(plan.trades_aligned, symbols).columns == ["timestamp", "AAA_quantity", "BBB_quantity"]
    q = quotes_wide(plan.price_history, symbols)
    assert rows(q)[0] == (d("2024-01-02"), 52.5, None)
    long = melt(wide)
    assert long.columns == ["Date", "Security", "Valuation"]
    assert rows(long) == sorted(
        (r["timestamp"].isoformat(), r["symbol"], r["valuation"]) for r in plan.holdings.collect())


def test_price_history_ticker_and_window(golden):
    got = rows(golden().price_history, "symbol", "timestamp", "ticker", "quote")
    assert got[0] == ("AAA", d("2024-01-02"), "AAA.NS", 52.5)
    assert len(got) == 6


def test_trades_aligned(golden):
    got = rows(golden().trades_aligned, "symbol", "timestamp", "quantity")
    assert len(got) == 8
    assert ("AAA", d("2024-01-02"), 40.0) in got and ("BBB", d("2024-01-02"), 0.0) in got


def test_materialized_net_gives_same_holdings(golden):
    assert rows(golden(materialize=True).holdings) == rows(golden(materialize=False).holdings)


def test_melted_holdings_by_granularity(golden):
    from holdfast.operators import melted_holdings

    h = golden().holdings
    assert rows(melted_holdings(h, "month")) == [
        ("2024-01-01", "AAA", 4220.0), ("2024-01-01", "BBB", 350.0),
        ("2024-02-01", "AAA", 4260.0), ("2024-02-01", "BBB", 385.0)]
    assert len(melted_holdings(h, "day").collect()) == 8
