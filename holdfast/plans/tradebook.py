"""Loading a broker's export into tables, every line accounted for."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from holdfast.schemas import TRADEBOOK
from holdfast.sources.tradebook import REJECTED, parsed_lines

_SPLIT = StructType(TRADEBOOK.fields + [StructField(c, StringType()) for c in REJECTED] + [StructField("rejected", BooleanType())])


@dataclass
class TradebookLoad:
    """A loaded export: its executions, its rejected lines, and how many of each."""

    tradebook: DataFrame
    rejects: DataFrame
    accepted: int
    rejected: int


def load_tradebook(spark: SparkSession, path: str | list[str], table_path: str, broker: str = "Zerodha",
                   max_rejects: int | None = None) -> TradebookLoad:
    """Write an export as a Parquet table, good and rejected lines apart.

    One pass over the files: each line goes to the folder ``rejected=false`` or
    ``rejected=true`` of ``table_path``, which must not exist yet. The counts come
    from the write job itself. More than ``max_rejects`` rejected lines are an
    error; the written lines stay for inspection.
    """
    seen = Observation()
    lines = parsed_lines(spark, path, broker).withColumn("rejected", F.col("reason").isNotNull())
    good = ~F.col("rejected")
    # a good line needs no second copy of itself as text
    lines = lines.withColumns({c: F.when(F.col("rejected"), F.col(c)) for c in REJECTED})
    lines = lines.observe(seen, F.count_if(good).alias("accepted"), F.count_if(~good).alias("rejected"))
    lines.select(*_SPLIT.fieldNames()).write.partitionBy("rejected").parquet(table_path)
    accepted, rejected = seen.get["accepted"], seen.get["rejected"]
    if max_rejects is not None and rejected > max_rejects:
        raise ValueError(f"{rejected} rejected lines, more than {max_rejects}: see {os.path.join(table_path, 'rejected=true')}")
    table = spark.read.schema(_SPLIT).parquet(table_path)
    return TradebookLoad(table.where("NOT rejected").select(*TRADEBOOK.fieldNames()), table.where("rejected").select(*REJECTED), accepted, rejected)
