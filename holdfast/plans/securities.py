"""The securities refresh as one batch job, and bulk loads beside it.

The reference drops the table and then appends one segment at a time, so
readers see a half-loaded table in between. Here all snapshot segments are
read in one scan, cleaned, keyed and written to a new data folder, which becomes
the table when a commit names it. A refresh that fails leaves the table as it
was, a reader never finds it empty, and of writers at the same time none loses
rows: a refresh replaces what is there, a bulk load adds to whatever is there
when it commits. ``segment`` is the partition folder (partition pruning replaces
the index on segment), files are sorted by ``scrip_id`` inside it, and bloom
filters serve lookups by code or ISIN.
"""

from __future__ import annotations

from collections.abc import Iterable
from urllib.parse import unquote

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from holdfast.operators import securities as sec
from holdfast.schemas import EXCHANGE_SEGMENTS
from holdfast.session import folder_ages
from holdfast.sources import securities as src


NO_SEGMENT = "__HIVE_DEFAULT_PARTITION__"     # Spark's folder name for a null


def refresh_securities(spark: SparkSession, snapshot_path: str, table_path: str, multi_line: bool = False,
                       segments: Iterable[str] = EXCHANGE_SEGMENTS, bad_numbers: str = "fail") -> DataFrame:
    """Snapshots (``segment=<name>/`` folders of JSON) to the master table.

    Returns the load audit (segment, rows), with 0 rows for those of ``segments``
    that had no snapshot. The write job counts the rows as it writes them, so
    the table is not read again.
    """
    folders = (unquote(f.split("=", 1)[1]) for f in folder_ages(spark, snapshot_path) if f.startswith("segment="))
    expected = [None if f == NO_SEGMENT else f for f in dict.fromkeys([*segments, *sorted(folders)])]
    normalised = sec.normalise_securities(src.read_snapshots(spark, snapshot_path, multi_line), bad_numbers)
    counts = Observation()
    write_master(sec.with_security_id(normalised), table_path, counts, expected)
    rows = [(name, counts.get[str(i)]) for i, name in enumerate(expected)]
    return spark.createDataFrame(rows, "segment string, rows long")


def write_master(securities: DataFrame, table_path: str, counts: Observation | None = None, segments: Iterable[str | None] = ()) -> None:
    """Replace the table's rows, in files sorted by scrip_id; ``counts`` gets the
    rows written of each of ``segments``, by its number in the list."""
    spark = securities.sparkSession
    rows = sec.layout_for_table(securities)
    if counts is not None:
        # above the layout's exchange, in the stage that writes: rows of a task count when it succeeds
        rows = rows.observe(counts, *(F.count_if(F.col("segment").eqNullSafe(F.lit(name))).alias(str(i)) for i, name in enumerate(segments)))
    folder = src.new_data_folder()
    src.write_data(rows, table_path, folder)
    src.commit(spark, table_path, folder, append=False)
    src.remove_old_versions(spark, table_path)


def ingest_securities_csv(spark: SparkSession, csv_path: str, table_path: str) -> DataFrame:
    """Bulk-load hand-over CSV files into the master table, all or nothing.

    The files are read strictly (header names checked, a malformed row fails
    the load before anything is published); the table is created if missing.
    Only the new rows are written: the commit lists them beside what is there at
    that moment, so loads that run at the same time keep each other's rows. The
    load's own folder name is part of each id, so no two loads share ids. Returns
    the table as read back.
    """
    folder = src.new_data_folder()
    rows = sec.with_security_id(src.read_securities_csv(spark, csv_path), load=folder)
    src.write_data(sec.layout_for_table(rows), table_path, folder)
    src.commit(spark, table_path, folder, append=True)
    src.remove_old_versions(spark, table_path)
    return src.read_securities_table(spark, table_path)
