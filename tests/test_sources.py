"""Feed readers: text timestamps and dates are parsed on read."""

from __future__ import annotations

import json
import os

import pytest
from conftest import d, rows

from holdfast import build_holdings
from holdfast.sources import read_events, read_prices, read_tradebook, write_tradebook_csv


def test_price_feed_as_csv_text(spark, tmp_path):
    path = str(tmp_path / "prices.csv")
    with open(path, "w") as fh:
        fh.write("timestamp,symbol,quote\n2024-01-02 00:00:00,AAA,52.5\n2024-01-03 00:00:00,AAA,53.004\n")
    got = rows(read_prices(spark, path, fmt="csv"))
    assert got == [(d("2024-01-02"), "AAA", 52.5), (d("2024-01-03"), "AAA", 53.004)]


def test_event_feed_as_json(spark, tmp_path):
    path = str(tmp_path / "events.json")
    with open(path, "w") as fh:
        for r in [{"symbol": "AAA", "details": "split", "ex_date": "01 Feb 2024", "ratio": 2, "type": "split"},
                  {"symbol": "AAA", "details": "div", "ex_date": "15 Jan 2024", "type": "dividend", "amount": 1.5}]:
            fh.write(json.dumps(r) + "\n")
    ev = read_events(spark, path)
    assert ev.schema["ex_date"].dataType.simpleString() == "string"
    assert rows(ev, "type", "ex_date", "ratio") == [("dividend", "15 Jan 2024", None), ("split", "01 Feb 2024", 2.0)]


def test_tradebook_csv_columns_bound_by_name(spark, make_tradebook, tmp_path):
    from conftest import GOLDEN_TRADES

    tb = make_tradebook(GOLDEN_TRADES)
    shuffled = tb.select(*reversed(tb.columns))          # the broker's column order differs
    path = str(tmp_path / "tb")
    write_tradebook_csv(shuffled, path)
    back = read_tradebook(spark, path)
    assert back.columns == tb.columns and rows(back) == rows(tb)


def test_whole_pipeline_from_feeds(spark, make_tradebook, tmp_path):
    from conftest import GOLDEN_TRADES

    tb_path = str(tmp_path / "tb")
    write_tradebook_csv(make_tradebook(GOLDEN_TRADES), tb_path)
    prices = str(tmp_path / "p.csv")
    with open(prices, "w") as fh:
        fh.write("timestamp,symbol,quote\n2024-01-02 00:00:00,AAA,52.5\n2024-02-05 00:00:00,AAA,60\n"
                 "2024-01-03 00:00:00,BBB,50\n")
    events = str(tmp_path / "e.json")
    with open(events, "w") as fh:
        fh.write(json.dumps({"symbol": "AAA", "ex_date": "01 Feb 2024", "ratio": 2.0, "type": "split"}) + "\n")
    plan = build_holdings(read_tradebook(spark, tb_path), read_prices(spark, prices, fmt="csv"),
                          read_events(spark, events))
    assert rows(plan.holdings.filter("symbol = 'AAA'"), "timestamp", "valuation") == [
        (d("2024-01-02"), 2100.0), (d("2024-01-03"), 0.0), (d("2024-02-05"), 2100.0)]
    assert os.path.isdir(tb_path)


def test_malformed_tradebook_fields_fail_the_load(spark, tmp_path):
    import pytest

    from holdfast.schemas import TRADEBOOK

    path = str(tmp_path / "bad.csv")
    header = ",".join(TRADEBOOK.fieldNames())
    good = "AAA,I1,2024-01-02,X,EQ,EQ,buy,false,10,100.50,t1,o1,2024-01-02T10:00:00"
    bad = "AAA,I1,2024-01-02,X,EQ,EQ,buy,false,ten,100.50,t1,o1,2024-01-02T10:00:00"
    with open(path, "w") as fh:
        fh.write(header + "\n" + good + "\n")
    got = read_tradebook(spark, path).collect()[0]
    assert got["quantity"] == 10 and str(got["price"]) == "100.500000" and got["auction"] is False
    with open(path, "w") as fh:
        fh.write(header + "\n" + good + "\n" + bad + "\n")
    with pytest.raises(Exception, match="malformed quantity"):
        read_tradebook(spark, path).collect()


def _tradebook_file(path, *fields):
    from holdfast.schemas import TRADEBOOK

    with open(path, "w") as fh:
        fh.write(",".join(TRADEBOOK.fieldNames()) + "\n")
        for quantity, price in fields:
            fh.write(f"AAA,I1,2024-01-02,X,EQ,EQ,buy,false,{quantity},{price},t1,o1,2024-01-02T10:00:00\n")


def test_decimal_text_in_tradebooks(spark, tmp_path):
    path = str(tmp_path / "t.csv")
    _tradebook_file(path, ("10.000000", "45.3375"), ("5", "1.123456"), (" 7 ", "2.5000000000"))
    got = read_tradebook(spark, path).orderBy("quantity").collect()
    assert [(r["quantity"], str(r["price"])) for r in got] == [(5, "1.123456"), (7, "2.500000"), (10, "45.337500")]
    for quantity, price, name in (("1.5", "1", "quantity"), ("1", "1.1234567", "price"), ("1", "1.0000000000001", "price"), ("x", "1", "quantity")):
        _tradebook_file(path, (quantity, price))
        with pytest.raises(Exception, match=f"malformed {name}"):
            read_tradebook(spark, path).collect()


@pytest.fixture(params=["true", "false"])
def ansi(spark, request):
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", request.param)
    yield
    spark.conf.set("spark.sql.ansi.enabled", before)


BAD_EVENTS = [
    ("json", '{"symbol": "AAA", "ex_date": "01 Feb 2024", "ratio": "2:1", "type": "split"}\n'),
    ("json", '{"symbol": "AAA", "ex_date": "01 Feb 2024", "ratio": 2, "type": "split"}\n{"symbol": "AAA", "ex_da\n'),
    ("csv", "symbol,details,ex_date,ratio,type,amount\nAAA,x,01 Feb 2024,2:1,split,\n"),
]


@pytest.mark.parametrize("fmt,text", BAD_EVENTS)
def test_dirty_event_feeds_fail(spark, tmp_path, ansi, fmt, text):
    path = tmp_path / f"e.{fmt}"
    path.write_text(text)
    with pytest.raises(Exception):
        read_events(spark, str(path), fmt).collect()


def test_event_csv_columns_are_bound_by_name(spark, tmp_path, ansi):
    path = tmp_path / "e.csv"
    path.write_text("type,symbol,ratio,ex_date,amount,details\nsplit,AAA,2,01 Feb 2024,,x\n")
    assert rows(read_events(spark, str(path), "csv"), "symbol", "type", "ex_date", "ratio") == [("AAA", "split", "01 Feb 2024", 2.0)]
    path.write_text("kind,symbol\nsplit,AAA\n")
    with pytest.raises(Exception):
        read_events(spark, str(path), "csv").collect()


BAD_PRICES = [
    ("csv", "timestamp,symbol,quote\n2024-01-02 00:00:00,AAA,1x\n"),
    ("csv", "timestamp,symbol,quote\nbad,AAA,1\n"),
    ("json", '{"timestamp": "2024-01-02 00:00:00", "symbol": "AAA", "quote": "1x"}\n'),
    ("json", '{"timestamp": "bad", "symbol": "AAA", "quote": 1}\n'),
    ("json", '{"timestamp": "2024-01-02 00:00:00", "sym\n'),
]


@pytest.mark.parametrize("fmt,text", BAD_PRICES)
def test_dirty_price_feeds_fail(spark, tmp_path, ansi, fmt, text):
    path = tmp_path / f"p.{fmt}"
    path.write_text(text)
    with pytest.raises(Exception):
        read_prices(spark, str(path), fmt).collect()


def test_price_feed_as_json(spark, tmp_path, ansi):
    path = tmp_path / "p.json"
    path.write_text('{"timestamp": "2024-01-02 00:00:00", "symbol": "AAA", "quote": 1.25}\n{"timestamp": "2024-01-03 00:00:00", "symbol": "AAA"}\n')
    assert sorted(map(tuple, read_prices(spark, str(path), "json").collect())) == [(d("2024-01-02"), "AAA", 1.25), (d("2024-01-03"), "AAA", None)]


def test_jdbc_partitioning_needs_bounds(spark):
    from holdfast.sources.securities import read_securities_jdbc

    with pytest.raises(ValueError, match="lower and upper bound"):
        read_securities_jdbc(spark, "jdbc:none", {}, column="id")


LINE = {"symbol": "AAA", "isin": "I1", "trade_date": "2024-01-02", "exchange": "X", "segment": "EQ", "series": "EQ", "trade_type": "buy",
        "auction": "false", "quantity": "7", "price": "100", "trade_id": "t1", "order_id": "o1", "order_execution_time": "2024-01-02T10:00:00"}


def _export(folder, name, header, *lines):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join([",".join(header), *(x if isinstance(x, str) else ",".join(x.get(c, "") for c in header) for x in lines)]) + "\n")


def test_each_file_is_bound_by_its_own_header(spark, tmp_path, ansi):
    names = list(LINE)
    swapped = [{"quantity": "price", "price": "quantity"}.get(c, c) for c in names]
    folder = tmp_path / "exports"
    _export(folder, "a.csv", names, LINE)
    _export(folder, "odd {name} [1].csv", swapped, {**LINE, "quantity": "8"})
    _export(folder, "c.csv", ["account", *names[::-1]], {**LINE, "quantity": "9", "account": "main"})
    _export(folder, "none.csv", names)                              # a header and no line
    (folder / "empty.csv").write_text("")
    (folder / "bom.csv").write_text("﻿" + ",".join(swapped) + "\n" + ",".join({**LINE, "quantity": "10"}[c] for c in swapped) + "\n")
    got = read_tradebook(spark, str(folder))
    assert sorted((r["quantity"], float(r["price"])) for r in got.collect()) == [(7, 100.0), (8, 100.0), (9, 100.0), (10, 100.0)]
    assert got.select("symbol").distinct().count() == 1             # pruned to one column


def test_events_are_bound_by_their_own_headers(spark, tmp_path, ansi):
    folder = tmp_path / "events"
    folder.mkdir()
    (folder / "a.csv").write_text("symbol,details,ex_date,ratio,type,amount\nAAA,x,01 Feb 2024,2,split,9\n")
    (folder / "b.csv").write_text("symbol,details,ex_date,amount,type,ratio\nBBB,x,01 Feb 2024,9,split,2\n")
    assert rows(read_events(spark, str(folder), "csv"), "symbol", "ratio", "amount") == [("AAA", 2.0, 9.0), ("BBB", 2.0, 9.0)]
    (folder / "c.csv").write_text("symbol,details,ex_date,amount,type,ratio\nCCC,x,01 Feb\n")
    with pytest.raises(Exception, match="malformed line"):
        read_events(spark, str(folder), "csv").select("symbol").collect()


def test_headers_that_lack_or_repeat_a_column_are_errors(spark, tmp_path):
    folder = tmp_path / "exports"
    _export(folder, "a.csv", list(LINE), LINE)
    _export(folder, "b.csv", [c for c in LINE if c != "price"], LINE)
    with pytest.raises(ValueError, match="b.csv: column 'price' stands 0 times"):
        read_tradebook(spark, str(folder))
    _export(folder, "b.csv", [*LINE, "price"], LINE)
    with pytest.raises(ValueError, match="stands 2 times"):
        read_tradebook(spark, str(folder))


BAD_LINES = [
    (",".join(list(LINE.values())[:8]), "malformed line"),
    (",".join([*LINE.values(), "more"]), "malformed line"),
    ({**LINE, "quantity": ""}, "missing quantity"),
    ({**LINE, "price": " "}, "missing price"),
    ({**LINE, "symbol": ""}, "missing symbol"),
    ({**LINE, "trade_date": ""}, "missing trade_date"),
    ({**LINE, "trade_type": ""}, "missing trade_type"),
    ({**LINE, "quantity": "1.5"}, "malformed quantity: 1.5"),
    ({**LINE, "trade_date": "02/01/2024"}, "malformed trade_date"),
]


@pytest.mark.parametrize("bad,reason", BAD_LINES)
def test_a_bad_line_fails_the_load_whatever_is_read(spark, tmp_path, ansi, bad, reason):
    folder = tmp_path / "exports"
    _export(folder, "a.csv", list(LINE), LINE, bad)
    with pytest.raises(Exception, match=reason):
        read_tradebook(spark, str(folder)).select("isin").collect()
    with pytest.raises(Exception, match=reason):
        read_tradebook(spark, str(folder)).count()


def test_accepted_and_rejected_lines_are_all_lines(spark, tmp_path, ansi):
    from holdfast import scratch_dir
    from holdfast.plans.tradebook import load_tradebook
    from holdfast.sources import split_tradebook

    folder = tmp_path / "exports"
    _export(folder, "a.csv", list(LINE), LINE, *(bad for bad, _ in BAD_LINES))
    _export(folder, "b.csv", list(LINE)[::-1], LINE, LINE)
    good, bad = split_tradebook(spark, str(folder))
    assert good.count() == 3 and bad.count() == len(BAD_LINES)
    assert sorted(r["reason"][:9] for r in bad.collect()) == sorted(reason[:9] for _, reason in BAD_LINES)
    assert {r["file"].rsplit("/", 1)[1] for r in bad.collect()} == {"a.csv"}
    assert ",".join(list(LINE.values())[:8]) in {r["line"] for r in bad.collect()}
    load = load_tradebook(spark, str(folder), scratch_dir(spark, "test-load"))
    assert (load.accepted, load.rejected) == (3, len(BAD_LINES))
    assert rows(load.tradebook) == rows(good) and rows(load.rejects) == rows(bad)
    assert load.tradebook.schema == good.schema
    with pytest.raises(ValueError, match="9 rejected lines, more than 2"):
        load_tradebook(spark, str(folder), scratch_dir(spark, "test-load"), max_rejects=2)
    with pytest.raises(ValueError, match="no CSV export known"):
        split_tradebook(spark, str(folder), broker="Nobody")


def test_another_export_is_a_matter_of_its_column_names(spark, tmp_path):
    from holdfast.sources import brokers, register_csv_export

    register_csv_export("Other", {"quantity": "Filled Qty", "price": "Avg. Price"})
    folder = tmp_path / "exports"
    header = [{"quantity": "Filled Qty", "price": "Avg. Price"}.get(c, c) for c in LINE]
    _export(folder, "a.csv", header, ",".join(LINE.values()))
    got = read_tradebook(spark, str(folder), broker="Other").first()
    assert (got["quantity"], float(got["price"])) == (7, 100.0) and "Other" in brokers()
