"""The command line runs the holdings reports from files."""

from __future__ import annotations

import json
import os

from conftest import GOLDEN_TRADES, d, rows

from holdfast.__main__ import main
from holdfast.sources import write_tradebook_csv
from holdfast.sources.securities import read_securities_table


def test_holdings_command_writes_the_reports(spark, make_tradebook, tmp_path):
    tb = str(tmp_path / "tb")
    write_tradebook_csv(make_tradebook(GOLDEN_TRADES), tb)
    prices = str(tmp_path / "p.csv")
    with open(prices, "w") as fh:
        fh.write("timestamp,symbol,quote\n2024-01-02 00:00:00,AAA,52.5\n2024-01-03 00:00:00,AAA,53\n"
                 "2024-02-01 00:00:00,AAA,54\n2024-02-05 00:00:00,AAA,60\n"
                 "2024-01-03 00:00:00,BBB,50\n2024-02-05 00:00:00,BBB,55\n")
    events = str(tmp_path / "e.json")
    with open(events, "w") as fh:
        fh.write(json.dumps({"symbol": "AAA", "ex_date": "01 Feb 2024", "ratio": 2.0, "type": "split"}) + "\n")
    out = str(tmp_path / "out")
    assert main(["holdings", "--tradebook", tb, "--prices", prices, "--prices-format", "csv",
                 "--events", events, "--out", out]) == 0
    assert sorted(os.listdir(out)) == ["holdings_daily", "holdings_monthly", "holdings_weekly",
                                       "holdings_yearly", "latest_allocation", "portfolio_valuation"]
    assert rows(spark.read.parquet(os.path.join(out, "latest_allocation"))) == [
        ("AAA", 2100.0, 84.51), ("BBB", 385.0, 15.49)]
    assert rows(spark.read.parquet(os.path.join(out, "holdings_monthly")), "timestamp", "symbol", "valuation")[0] == (
        d("2024-01-01"), "AAA", 4220.0)


def test_refresh_command_prints_the_audit(spark, tmp_path, capsys):
    snapshots = tmp_path / "snap" / "segment=Equity T+1"
    snapshots.mkdir(parents=True)
    (snapshots / "a.json").write_text(json.dumps([
        {"SCRIP_CD": "500001", "scrip_id": "AAA", "Status": "Active"},
        {"SCRIP_CD": "500002", "scrip_id": "BBB", "Status": "Active"}]))
    table = str(tmp_path / "master")
    assert main(["refresh-securities", "--snapshots", str(tmp_path / "snap"), "--table", table]) == 0
    lines = capsys.readouterr().out.strip().split("\n")
    assert "Equity T+1\t2" in lines and "Commodity\t0" in lines and len(lines) == 15
    assert read_securities_table(spark, table).count() == 2
