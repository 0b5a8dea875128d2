"""Incremental intake of broker tradebook files with Structured Streaming.

Files that land in a folder (an upload, a broker's daily export) are read as
a file stream, cast to the canonical tradebook and cleaned by the same
operators as the batch path, and appended to an executions table partitioned
by trade date. The file sink commits each micro-batch exactly once through
its checkpoint, so a restarted or failed job neither loses nor duplicates
executions. No watermark and no streaming aggregation: late trades are never
dropped, and netting stays the batch operator over the table, where it sees
every execution of a day however late it arrived.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from holdfast.operators.tradebook import clean_tradebook
from holdfast.schemas import TRADEBOOK
from holdfast.sources.csv_files import FILE, LINE
from holdfast.sources.tradebook import accepted_lines

# A file stream needs its schema up front, and a CSV schema binds by position:
# the landing files must carry the canonical columns in this order. The header
# is checked against it (enforceSchema off), so a file with other columns fails
# the batch instead of being read into the wrong fields.
LANDING_SCHEMA = StructType([StructField(f.name, StringType()) for f in TRADEBOOK.fields])


def read_tradebook_stream(spark: SparkSession, landing_dir: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Canonical executions from the CSV files arriving in ``landing_dir``."""
    reader = (spark.readStream.schema(LANDING_SCHEMA).option("header", True)
              .option("enforceSchema", False).option("columnPruning", False).option("mode", "FAILFAST"))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return accepted_lines(reader.csv(landing_dir).withColumns({LINE: F.lit(None).cast("string"), FILE: F.col("_metadata.file_path")}))


def start_execution_intake(spark: SparkSession, landing_dir: str, table_path: str, checkpoint_path: str,
                           segment: str | None = None, available_now: bool = False) -> StreamingQuery:
    """Append cleaned executions (trade_date, symbol, quantity, price) to ``table_path``.

    ``checkpoint_path`` must be on shared storage. ``available_now`` processes
    what has landed and stops (for scheduled runs); otherwise the query keeps
    running and picks up new files.
    """
    # a day's rows in one task: one file per day and batch, not one per task
    executions = clean_tradebook(read_tradebook_stream(spark, landing_dir), segment).repartition("trade_date")
    writer = (executions.writeStream.format("parquet").outputMode("append")
              .option("checkpointLocation", checkpoint_path).partitionBy("trade_date"))
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start(table_path)


def read_executions(spark: SparkSession, table_path: str) -> DataFrame:
    """The executions table written by the intake, for the batch operators."""
    schema = StructType([TRADEBOOK[c] for c in ("symbol", "quantity", "price")] + [TRADEBOOK["trade_date"]])
    return spark.read.schema(schema).parquet(table_path).select("trade_date", "symbol", "quantity", "price")
