"""Stand-in inputs built from the driver's TPC-H-like tables.

The test data has no trades, prices or securities; these frames give the
line items those shapes so every operator can run over whole tables:
``part.p_brand`` plays the symbol, ``l_shipdate`` the trade date and
``l_extendedprice`` the unit price. The same definitions, as SQL, open every
DuckDB oracle query (``holdfast.oracle``), so both engines start from the
same rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)

from holdfast.schemas import SECURITIES


# Declared schemas of the driver tables the adapters read (only the columns
# used); a declared schema also spares the footer-reading job of inference.
TABLE_SCHEMAS = {
    "lineitem": StructType([
        StructField("l_orderkey", LongType()),
        StructField("l_partkey", LongType()),
        StructField("l_linenumber", IntegerType()),
        StructField("l_quantity", DoubleType()),
        StructField("l_extendedprice", DoubleType()),
        StructField("l_returnflag", StringType()),
        StructField("l_linestatus", StringType()),
        StructField("l_shipdate", TimestampNTZType()),
    ]),
    "part": StructType([
        StructField("p_partkey", LongType()),
        StructField("p_name", StringType()),
        StructField("p_brand", StringType()),
        StructField("p_type", StringType()),
        StructField("p_size", IntegerType()),
    ]),
}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLE_SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


# Adapter definitions as SQL text common to Spark SQL and DuckDB; ``{lineitem}``
# and ``{part}`` name the driver tables. ``holdfast.oracle`` opens every DuckDB
# query with the same text, so both engines start from the same rows.
ADAPTER_SQL = {
    "v_tradebook": """
SELECT p_brand AS symbol,
       CAST(p_partkey AS STRING) AS isin,
       CAST(l_shipdate AS DATE) AS trade_date,
       'X' AS exchange,
       p_type AS segment,
       CASE WHEN l_linestatus = 'F' THEN 'EQ' ELSE 'BE' END AS series,
       CASE WHEN l_returnflag = 'R' THEN 'sell' ELSE 'buy' END AS trade_type,
       FALSE AS auction,
       CAST(l_quantity AS BIGINT) AS quantity,
       CAST(l_extendedprice AS DECIMAL(18,6)) AS price,
       CAST(l_orderkey * 10 + l_linenumber AS STRING) AS trade_id,
       CAST(l_orderkey AS STRING) AS order_id,
       l_shipdate AS order_execution_time
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey""",
    "v_prices": """
SELECT CAST(l_shipdate AS DATE) AS timestamp, p_brand AS symbol, MAX(l_extendedprice) AS quote
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey
WHERE EXTRACT(DAY FROM l_shipdate) <> 13
  AND NOT (CAST(SUBSTR(p_brand, 7) AS INT) % 5 = 0 AND EXTRACT(MONTH FROM l_shipdate) = 6)
GROUP BY CAST(l_shipdate AS DATE), p_brand""",
    "v_events": """
WITH b AS (SELECT DISTINCT p_brand AS symbol, CAST(SUBSTR(p_brand, 7) AS INT) AS n FROM {part})
SELECT symbol, CAST(DATE '1997-01-01' + n * 10 AS DATE) AS ex_date, CAST(2.0 AS DOUBLE) AS ratio,
       'split' AS type, 'split 2 for 1' AS details, CAST(NULL AS DOUBLE) AS amount FROM b
UNION ALL
SELECT symbol, CAST(DATE '2000-01-01' + n * 10 AS DATE), CAST(5.0 AS DOUBLE),
       'bonus', 'bonus 4 to 1', CAST(NULL AS DOUBLE) FROM b WHERE n <= 20
UNION ALL
SELECT symbol, CAST(DATE '1999-01-01' + n * 10 AS DATE), CAST(NULL AS DOUBLE),
       'dividend', 'dividend', CAST(1.5 AS DOUBLE) FROM b""",
    "v_securities": """
SELECT CASE p_type WHEN 'ECONOMY' THEN 'Equity T+0' WHEN 'LARGE' THEN 'Exchange Traded Funds' WHEN 'MEDIUM' THEN 'Derivatives'
                   WHEN 'PROMO' THEN 'Equity - Institutional Series' WHEN 'SMALL' THEN 'Social Stock Exchange'
                   ELSE 'Debt or Others' END AS segment, CAST(500000 + MIN(p_partkey) AS STRING) AS scrip_code,
       MIN(p_name) AS security_name,
       CASE WHEN MIN(p_partkey) % 3 = 0 THEN 'Active' WHEN MIN(p_partkey) % 3 = 1 THEN 'Suspended' ELSE 'Delisted' END AS status,
       p_brand AS scrip_id, CAST(MIN(p_size) AS DECIMAL(18,4)) AS face_value
FROM {part} GROUP BY p_type, p_brand""",
}


def _view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = ADAPTER_SQL[name]
    tables = {t: _table(spark, sf_dir, t) for t in TABLE_SCHEMAS if "{" + t + "}" in text}
    return spark.sql(text, **tables)


def tradebook_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical tradebook: one execution per line item."""
    return _view(spark, sf_dir, "v_tradebook")


def prices_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily close per symbol: the highest extended price of the day.

    No symbol has a price on the 13th of a month, and every fifth brand has none
    in June, so trades on days without prices and days without a quote occur.
    """
    return _view(spark, sf_dir, "v_prices")


def events_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corporate events per symbol, ex_date as a proper date.

    Every brand splits 2:1; brands 1-20 also get a 5x bonus; every brand pays
    a dividend (which must not touch quantities).
    """
    return _view(spark, sf_dir, "v_events")


def events_feed_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a feed delivers them: ex_date as text ``dd MMM yyyy``."""
    return events_view(spark, sf_dir).withColumn("ex_date", F.date_format("ex_date", "dd MMM yyyy"))


def securities_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Securities master: one security per part type, which plays a segment, and brand."""
    return _view(spark, sf_dir, "v_securities")


def securities_full_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The master view widened to every securities column (absent ones null)."""
    base = securities_view(spark, sf_dir)
    cols = [F.col(f.name) if f.name in base.columns else F.lit(None).cast(f.dataType).alias(f.name)
            for f in SECURITIES.fields]
    return base.select(*cols)


@dataclass
class Inputs:
    """The four inputs of the holdings pipeline for one test-data folder."""

    spark: SparkSession
    sf_dir: str

    @cached_property
    def tradebook(self) -> DataFrame:
        return tradebook_view(self.spark, self.sf_dir)

    @cached_property
    def prices(self) -> DataFrame:
        return prices_view(self.spark, self.sf_dir)

    @cached_property
    def events_feed(self) -> DataFrame:
        return events_feed_view(self.spark, self.sf_dir)

    @cached_property
    def securities(self) -> DataFrame:
        return securities_view(self.spark, self.sf_dir)
