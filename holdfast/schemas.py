"""Declared schemas and fixed dimension values.

Every input is read with a declared schema: inference costs an extra pass over
the data, fails on empty or all-null columns and changes types between files.
"""

from __future__ import annotations

from pyspark.sql.types import (
    BooleanType,
    DateType,
    DecimalType,
    DoubleType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)

MONEY = DecimalType(18, 6)  # unit prices: averages and fund prices have more than two decimals
FACE_VALUE = DecimalType(18, 4)
MARKET_CAP = DecimalType(24, 4)

# Canonical tradebook: one row per execution, as a broker exports it.
TRADEBOOK = StructType(
    [
        StructField("symbol", StringType()),
        StructField("isin", StringType()),
        StructField("trade_date", DateType()),
        StructField("exchange", StringType()),
        StructField("segment", StringType()),
        StructField("series", StringType()),
        StructField("trade_type", StringType()),
        StructField("auction", BooleanType()),
        StructField("quantity", LongType()),
        StructField("price", MONEY),
        StructField("trade_id", StringType()),
        StructField("order_id", StringType()),
        StructField("order_execution_time", TimestampNTZType()),
    ]
)

# Price history in long form: one row per symbol and market day.
PRICES = StructType(
    [
        StructField("timestamp", DateType()),
        StructField("symbol", StringType()),
        StructField("quote", DoubleType()),
    ]
)

# Corporate events as a feed delivers them (ex_date still text).
EVENTS_FEED = StructType(
    [
        StructField("symbol", StringType()),
        StructField("details", StringType()),
        StructField("ex_date", StringType()),
        StructField("ratio", DoubleType()),
        StructField("type", StringType()),
        StructField("amount", DoubleType()),
    ]
)

# Securities master, in the column order of the snapshot CSV files.
SECURITIES = StructType(
    [
        StructField("segment", StringType()),
        StructField("scrip_code", StringType()),
        StructField("security_name", StringType()),
        StructField("status", StringType()),
        StructField("group_name", StringType()),
        StructField("face_value", FACE_VALUE),
        StructField("isin_number", StringType()),
        StructField("industry", StringType()),
        StructField("scrip_id", StringType()),
        StructField("nsurl", StringType()),
        StructField("issuer_name", StringType()),
        StructField("market_cap", MARKET_CAP),
    ]
)

SECURITIES_COLUMNS = SECURITIES.fieldNames()

# --- Fixed values (must equal the reference's for equal results) -----------

# Exchange segment name -> code the exchange's listing service expects.
EXCHANGE_SEGMENT_CODES = {
    "Equity T+1": "Equity",
    "Equity T+0": "EQT0",
    "Derivatives": "DER",
    "Exchange Traded Funds": "MF",
    "Debt or Others": "DB",
    "Currency Derivatives": "CR",
    "Commodity": "CO",
    "Electronic Gold Receipts": "EGR",
    "Hybrid Security": "HS",
    "Municipal Bonds": "MB",
    "Preference Shares": "Preference Shares",
    "Debentures and Bonds": "Debentures and Bonds",
    "Equity - Institutional Series": "Equity - Institutional Series",
    "Commercial Papers": "Commercial Papers",
    "Social Stock Exchange": "SSE",
}

# Segment names the securities lookup accepts.
EXCHANGE_SEGMENTS = list(EXCHANGE_SEGMENT_CODES)

DEFAULT_SEGMENT = "Equity T+1"
DEFAULT_SEGMENT_CODE = "Equity"

SECURITY_STATUSES = ["Active", "Suspended", "Delisted"]

SUPPORTED_BROKERS = ["Zerodha"]

# Trading segment -> the exchange series that belong to it.
SEGMENT_SERIES = {
    "Fully Paid Equity Shares or Exchange Traded Funds": ["A", "EQ"],
}
DEFAULT_TRADING_SEGMENT = "Fully Paid Equity Shares or Exchange Traded Funds"

# Corporate event types that change the number of shares held.
QUANTITY_EVENT_TYPES = ["split", "bonus"]

# Suffix that turns a symbol into the price feed's ticker.
PRICE_TICKER_SUFFIX = ".NS"

# Snapshot JSON key -> securities column (segment comes from the file's place).
SNAPSHOT_KEYS = {
    "SCRIP_CD": "scrip_code",
    "Scrip_Name": "security_name",
    "Status": "status",
    "GROUP": "group_name",
    "FACE_VALUE": "face_value",
    "ISIN_NUMBER": "isin_number",
    "INDUSTRY": "industry",
    "scrip_id": "scrip_id",
    "NSURL": "nsurl",
    "Issuer_Name": "issuer_name",
    "Mktcap": "market_cap",
}
