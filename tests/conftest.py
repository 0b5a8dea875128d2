from __future__ import annotations

import datetime as dt
import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

from holdfast.schemas import EVENTS_FEED, PRICES, TRADEBOOK  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .appName("holdfast-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    # tests set their own checkpoint folder only where the session names none
    if not session.conf.get("spark.checkpoint.dir", None) and session.sparkContext.getCheckpointDir() is None:
        session.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="holdfast-test-ckpt-"))
    yield session


def d(s: str) -> dt.date:
    return dt.date.fromisoformat(s)


def trade(trade_date, symbol, trade_type, quantity, price, series="EQ"):
    from decimal import Decimal

    return (symbol, "ISIN" + symbol, d(trade_date), "NSE", "EQ", series, trade_type, False,
            quantity, Decimal(str(price)), "t", "o", dt.datetime.fromisoformat(trade_date + "T10:00:00"))


@pytest.fixture
def make_tradebook(spark):
    def build(rows):
        return spark.createDataFrame(rows, TRADEBOOK)

    return build


@pytest.fixture
def make_prices(spark):
    def build(rows):
        return spark.createDataFrame([(d(t), s, float(q)) for t, s, q in rows], PRICES)

    return build


@pytest.fixture
def make_events(spark):
    def build(rows):
        return spark.createDataFrame(rows, EVENTS_FEED)

    return build


# --- the hand-worked case of FIXTURES.md §4 ---------------------------------

GOLDEN_TRADES = [
    trade("2024-01-02", "AAA", "buy", 10, "100.00"),
    trade("2024-01-02", "AAA", "buy", 10, "110.00"),
    trade("2024-01-03", "BBB", "buy", 7, "50.00"),
    trade("2024-02-05", "AAA", "sell", 5, "120.00"),
    trade("2024-01-03", "CCC", "buy", 3, "10.00", series="BE"),
]

GOLDEN_EVENTS = [
    ("AAA", "split 2 for 1", "01 Feb 2024", 2.0, "split", None),
    ("AAA", "dividend", "15 Jan 2024", None, "dividend", 1.5),
]

GOLDEN_PRICES = [
    ("2024-01-02", "AAA", 52.5), ("2024-01-03", "AAA", 53.0), ("2024-02-01", "AAA", 54.0),
    ("2024-02-05", "AAA", 60.0), ("2024-01-03", "BBB", 50.0), ("2024-02-05", "BBB", 55.0),
]


@pytest.fixture
def golden(make_tradebook, make_prices, make_events):
    from holdfast import build_holdings

    def build(**options):
        return build_holdings(make_tradebook(GOLDEN_TRADES), make_prices(GOLDEN_PRICES),
                              make_events(GOLDEN_EVENTS), **options)

    return build


def rows(df, *cols):
    """Sorted list of tuples of the given columns."""
    cols = cols or tuple(df.columns)
    return sorted(tuple(r[c] for c in cols) for r in df.collect())
