"""One test per edge case of FIXTURES.md §5."""

from __future__ import annotations

import pytest
from conftest import d, rows, trade

from holdfast import build_holdings
from holdfast.operators import clean_tradebook, latest_allocation, net_tradebook
from holdfast.operators.reshape import holdings_wide
from holdfast.sources import read_tradebook

PRICES = [("2024-01-02", "AAA", 10.0), ("2024-01-03", "AAA", 11.0), ("2024-01-04", "AAA", 12.0)]


def test_trade_type_null_or_upper_case_is_a_sale(make_tradebook):
    tb = make_tradebook([trade("2024-01-02", "AAA", None, 5, 10), trade("2024-01-02", "BBB", "BUY", 3, 10),
                         trade("2024-01-02", "CCC", "buy", 2, 10)])
    assert rows(clean_tradebook(tb), "symbol", "quantity") == [("AAA", -5), ("BBB", -3), ("CCC", 2)]


def test_series_null_is_dropped(make_tradebook):
    tb = make_tradebook([trade("2024-01-02", "AAA", "buy", 5, 10, series=None),
                         trade("2024-01-02", "BBB", "buy", 5, 10, series="A")])
    assert rows(clean_tradebook(tb), "symbol") == [("BBB",)]


def test_unknown_trading_segment_is_an_error(make_tradebook):
    with pytest.raises(ValueError):
        clean_tradebook(make_tradebook([trade("2024-01-02", "AAA", "buy", 5, 10)]), segment="Bonds")


def test_day_that_nets_to_zero(make_tradebook):
    tb = make_tradebook([trade("2024-01-02", "AAA", "buy", 5, 10), trade("2024-01-02", "AAA", "sell", 5, 12)])
    assert rows(net_tradebook(clean_tradebook(tb)), "symbol", "average_price", "quantity") == [("AAA", None, 0)]


def _plan(make_tradebook, make_prices, make_events, trades, events, prices=PRICES, **opts):
    return build_holdings(make_tradebook(trades), make_prices(prices), make_events(events), **opts)


def test_two_events_multiply_and_do_not_fan_out(make_tradebook, make_prices, make_events):
    events = [("AAA", "split", "03 Jan 2024", 2.0, "split", None),
              ("AAA", "bonus", "04 Jan 2024", 5.0, "bonus", None)]
    plan = _plan(make_tradebook, make_prices, make_events,
                 [trade("2024-01-02", "AAA", "buy", 1, 10), trade("2024-01-03", "AAA", "buy", 1, 10),
                  trade("2024-01-04", "AAA", "buy", 1, 10)], events)
    assert rows(plan.adjusted, "trade_date", "quantity") == [
        (d("2024-01-02"), 10.0), (d("2024-01-03"), 5.0), (d("2024-01-04"), 1.0)]


def test_two_events_on_the_same_day(make_tradebook, make_prices, make_events):
    events = [("AAA", "split", "03 Jan 2024", 2.0, "split", None),
              ("AAA", "bonus", "03 Jan 2024", 3.0, "bonus", None)]
    plan = _plan(make_tradebook, make_prices, make_events, [trade("2024-01-02", "AAA", "buy", 1, 10)], events)
    assert rows(plan.adjusted, "quantity") == [(6.0,)]


def test_trade_on_ex_date_is_not_adjusted(make_tradebook, make_prices, make_events):
    plan = _plan(make_tradebook, make_prices, make_events, [trade("2024-01-03", "AAA", "buy", 4, 10)],
                 [("AAA", "split", "03 Jan 2024", 2.0, "split", None)])
    assert rows(plan.adjusted, "quantity") == [(4.0,)]


def test_no_events_and_only_dividends_leave_quantities(make_tradebook, make_prices, make_events):
    trades = [trade("2024-01-02", "AAA", "buy", 4, 10), trade("2024-01-03", "AAA", "sell", 1, 10)]
    for events in ([], [("AAA", "dividend", "03 Jan 2024", None, "dividend", 2.0)]):
        plan = _plan(make_tradebook, make_prices, make_events, trades, events)
        assert rows(plan.adjusted, "trade_date", "quantity") == [(d("2024-01-02"), 4.0), (d("2024-01-03"), -1.0)]


def test_trade_on_a_day_without_prices(make_tradebook, make_prices, make_events):
    prices = [("2024-01-02", "AAA", 10.0), ("2024-01-04", "AAA", 12.0)]
    trades = [trade("2024-01-02", "AAA", "buy", 1, 10), trade("2024-01-03", "AAA", "buy", 2, 10),
              trade("2024-01-04", "AAA", "buy", 4, 10)]
    keep = _plan(make_tradebook, make_prices, make_events, trades, [], prices)
    assert rows(keep.balance, "timestamp", "balance") == [(d("2024-01-02"), 1.0), (d("2024-01-04"), 7.0)]
    assert (d("2024-01-03"), "AAA", 2.0) in rows(keep.trades_aligned, "timestamp", "symbol", "quantity")
    drop = _plan(make_tradebook, make_prices, make_events, trades, [], prices, off_calendar="drop")
    assert rows(drop.balance, "timestamp", "balance") == [(d("2024-01-02"), 1.0), (d("2024-01-04"), 5.0)]


def test_calendar_is_the_union_of_histories(make_tradebook, make_prices, make_events):
    prices = [("2024-01-02", "AAA", 10.0), ("2024-01-03", "BBB", 5.0), ("2024-01-04", "AAA", 11.0)]
    plan = _plan(make_tradebook, make_prices, make_events,
                 [trade("2024-01-02", "AAA", "buy", 1, 10), trade("2024-01-03", "BBB", "buy", 1, 5)], [], prices)
    assert rows(plan.market_days) == [(d("2024-01-02"),), (d("2024-01-03"),)]
    assert len(plan.holdings.collect()) == 4


def test_symbols_with_punctuation(make_tradebook, make_prices, make_events):
    names = ["M&M", "BAJAJ-AUTO", "A.B"]
    trades = [trade("2024-01-02", s, "buy", 1, 10) for s in names]
    prices = [("2024-01-02", s, 10.0) for s in names]
    plan = _plan(make_tradebook, make_prices, make_events, trades, [], prices)
    wide = holdings_wide(plan.holdings, names + ["NOT.HELD"])
    assert wide.columns == ["timestamp"] + names + ["NOT.HELD"]
    assert rows(wide) == [(d("2024-01-02"), 10.0, 10.0, 10.0, None)]


def test_unknown_broker_is_an_error(spark):
    with pytest.raises(ValueError, match="no tradebook loader"):
        read_tradebook(spark, "/nonexistent", broker="Nobody")


def test_all_zero_latest_holdings_give_null_percentage(make_tradebook, make_prices, make_events):
    plan = _plan(make_tradebook, make_prices, make_events,
                 [trade("2024-01-02", "AAA", "buy", 1, 10), trade("2024-01-03", "AAA", "sell", 1, 10)], [],
                 [("2024-01-02", "AAA", 10.0), ("2024-01-03", "AAA", 11.0)])
    assert rows(latest_allocation(plan.holdings)) == [("AAA", 0.0, None)]


def test_events_outside_the_window_are_ignored(make_tradebook, make_prices, make_events):
    events = [("AAA", "split", "01 Jan 2023", 2.0, "split", None),   # before the first trade
              ("AAA", "split", "03 Jan 2024", 3.0, "split", None)]
    plan = _plan(make_tradebook, make_prices, make_events, [trade("2024-01-02", "AAA", "buy", 1, 10)], events,
                 as_of="2024-01-02")
    assert rows(plan.events) == []
    plan = _plan(make_tradebook, make_prices, make_events, [trade("2024-01-02", "AAA", "buy", 1, 10)], events)
    assert rows(plan.events, "ex_date") == [(d("2024-01-03"),)]
    assert rows(plan.adjusted, "quantity") == [(3.0,)]


def test_given_calendar_replaces_the_price_days(spark, make_tradebook, make_prices, make_events):
    cal = spark.createDataFrame([(d("2024-01-02"),), (d("2024-01-03"),), (d("2024-01-04"),), (d("2023-12-29"),)],
                                "timestamp date")
    plan = _plan(make_tradebook, make_prices, make_events, [trade("2024-01-02", "AAA", "buy", 2, 10),
                                                           trade("2024-01-04", "AAA", "buy", 1, 10)], [],
                 [("2024-01-02", "AAA", 10.0), ("2024-01-04", "AAA", 12.0)], calendar=cal)
    # the calendar is cut to the tenure; 01-03 has no price, so it is valued at 0
    assert rows(plan.holdings, "timestamp", "valuation") == [
        (d("2024-01-02"), 20.0), (d("2024-01-03"), 0.0), (d("2024-01-04"), 36.0)]


def test_end_extends_the_valuation_window(make_tradebook, make_prices, make_events):
    prices = [("2024-01-02", "AAA", 10.0), ("2024-01-05", "AAA", 11.0), ("2024-01-09", "AAA", 12.0)]
    plan = _plan(make_tradebook, make_prices, make_events, [trade("2024-01-02", "AAA", "buy", 2, 10)], [], prices,
                 end="2024-01-09")
    assert rows(plan.tenure) == [(d("2024-01-02"), d("2024-01-09"))]
    assert rows(plan.holdings, "timestamp", "valuation") == [(d("2024-01-02"), 20.0), (d("2024-01-05"), 22.0)]


def test_dirty_event_dates_fail_the_adjustment_and_are_listed(make_tradebook, make_prices, make_events):
    from holdfast.operators import unparsed_events

    events = make_events([("AAA", "split", "03 Jan 2024", 2.0, "split", None),
                          ("AAA", "split", "2024-13-45", 2.0, "split", None),
                          ("AAA", "bonus", None, 2.0, "bonus", None)])
    assert rows(unparsed_events(events), "ex_date") == [("2024-13-45",)]
    plan = build_holdings(make_tradebook([trade("2024-01-02", "AAA", "buy", 1, 10)]), make_prices(PRICES), events)
    with pytest.raises(Exception):
        plan.adjusted.collect()


def test_empty_tradebook_gives_empty_reports(spark, make_tradebook, make_prices, make_events):
    from holdfast.operators import melted_holdings, portfolio_valuation, resample

    plan = _plan(make_tradebook, make_prices, make_events, [], [], [])
    assert plan.holdings.collect() == [] and holdings_wide(plan.holdings, []).columns == ["timestamp"]
    assert resample(plan.holdings, "month").collect() == []
    assert portfolio_valuation(plan.holdings).collect() == []
    assert latest_allocation(plan.holdings).collect() == []
    long = melted_holdings(plan.holdings, "week")
    assert long.columns == ["Date", "Security", "Valuation"] and long.collect() == []


def test_two_quotes_on_one_day_give_one_answer(make_tradebook, make_prices, make_events):
    prices = [("2024-01-02", "AAA", 10.0), ("2024-01-02", "AAA", 11.0), ("2024-01-04", "AAA", 12.0)]
    for fill in ("zero", "carry"):
        plan = _plan(make_tradebook, make_prices, make_events, [trade("2024-01-02", "AAA", "buy", 2, 10)], [],
                     prices, price_fill=fill, end="2024-01-05")
        assert rows(plan.holdings, "timestamp", "valuation") == [(d("2024-01-02"), 22.0), (d("2024-01-04"), 24.0)]


def test_a_long_report_has_no_symbol_limit(spark):
    from holdfast.operators import melted_holdings

    h = spark.range(12_000).selectExpr("date'2024-01-02' AS timestamp", "concat('S', id) AS symbol", "CAST(id AS DOUBLE) AS valuation")
    assert melted_holdings(h, "month").count() == 12_000
    assert latest_allocation(h).count() == 12_000


def test_quantity_event_without_ratio_is_an_error(make_tradebook, make_prices, make_events):
    events = [("AAA", "split", "03 Jan 2024", None, "split", None)]
    trades = [trade("2024-01-02", "AAA", "buy", 1, 10), trade("2024-01-04", "AAA", "buy", 1, 10)]
    with pytest.raises(Exception, match="event without ratio"):
        build_holdings(make_tradebook(trades), make_prices(PRICES), make_events(events)).adjusted.collect()


def test_average_price_keeps_every_decimal(make_tradebook):
    trades = [trade("2024-01-02", "AAA", "buy", 10, "100.1250"), trade("2024-01-02", "AAA", "buy", 10, "45.3375")]
    assert net_tradebook(clean_tradebook(make_tradebook(trades))).first()["average_price"] == 72.73125


def test_a_mistyped_year_adds_no_days(make_tradebook, make_prices, make_events):
    trades = [trade("1024-01-02", "AAA", "buy", 1, 10), trade("2024-01-03", "AAA", "buy", 1, 10)]
    plan = _plan(make_tradebook, make_prices, make_events, trades, [], [("2024-01-02", "AAA", 10.0), ("2024-01-03", "AAA", 11.0)])
    assert rows(plan.holdings, "timestamp", "valuation") == [(d("2024-01-02"), 10.0), (d("2024-01-03"), 22.0)]


def test_a_plan_removes_its_scratch_tables(make_tradebook, make_prices, make_events):
    import os

    with _plan(make_tradebook, make_prices, make_events, [trade("2024-01-02", "AAA", "buy", 1, 10)], []) as plan:
        assert plan.holdings.count() > 0
        folders = list(plan.scratch)
        assert len(folders) == 2 and all(os.path.isdir(f) for f in folders)
    assert plan.scratch == [] and not any(os.path.exists(f) for f in folders)


def test_no_machine_local_scratch_on_a_cluster():
    from types import SimpleNamespace

    from holdfast.session import checkpoint_root

    def session(master, named=None):
        made = []
        context = SimpleNamespace(master=master, getConf=lambda: SimpleNamespace(get=lambda k, v=None: named), getCheckpointDir=lambda: None, setCheckpointDir=made.append)
        return SimpleNamespace(sparkContext=context)

    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]", "k8s://x"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            checkpoint_root(session(master))
        assert checkpoint_root(session(master, "hdfs://x/y")) == "hdfs://x/y"
    for master in ("local", "local[4]", "local[*]"):
        assert "holdfast-ckpt-" in checkpoint_root(session(master))
