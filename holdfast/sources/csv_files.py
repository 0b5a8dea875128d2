"""CSV files bound by their own headers, line by line accounted for.

The files of one folder need not agree on the order of their columns, nor on
which further columns they carry. A short job reads the first line of each file
(a task takes one file and stops after its header), files whose headers put the
wanted columns in the same places form a group, and each group is read with its
own binding. The plan therefore grows with the number of different headers, not
with the number of files.

Lines that do not have as many fields as their header are not repaired: they
come back with ``LINE`` set, beside the file they stand in.
"""

from __future__ import annotations

import csv
from collections import defaultdict
from collections.abc import Iterable
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

LINE = "_malformed_line"
FILE = "_file"


def _first_line(batches):
    """The first line with anything in it; what follows in the file is not read."""
    for batch in batches:
        for i, value in enumerate(batch.column(1)):
            if value.as_py().strip():
                yield batch.slice(i, 1)
                return


def headers(spark: SparkSession, path: str | list[str]) -> dict[str, str]:
    """Header line of every file with content under ``path``, by file."""
    side = spark.newSession()     # a configuration of its own: opening a file fills a partition, so each task has one
    for key in ("maxPartitionBytes", "openCostInBytes"):
        side.conf.set(f"spark.sql.files.{key}", str(1 << 42))
    side.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    lines = side.read.schema("value string").text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    # one short row per file, as many as the driver lists for the scan itself
    return {r["file"]: r["value"].lstrip("﻿") for r in lines.mapInArrow(_first_line, "file string, value string").collect()}


def _names(header: str, delimiter: str) -> list[str]:
    return [name.strip() for name in next(csv.reader([header], delimiter=delimiter))]


def _literal_path(file: str) -> str:
    """A listed file's name as a path that names only this file."""
    return "".join("\\" + c if c in "[]{}*?\\" else c for c in unquote(file))


def read_csv_by_header(spark: SparkSession, path: str | list[str], columns: Iterable[str], delimiter: str = ",") -> DataFrame:
    """``columns`` as text, each bound by the header of the file it comes from,
    with ``LINE`` (the text of a line whose field count differs from its
    header's, else null) and ``FILE``.

    A header without one of the columns, or with one of them twice, is an error
    that names the file. Other columns are not returned. No file: no rows.
    """
    columns = list(columns)
    groups: dict[tuple, list[str]] = defaultdict(list)
    for file, header in sorted(headers(spark, path).items()):
        names = _names(header, delimiter)
        for c in columns:
            if names.count(c) != 1:
                raise ValueError(f"{unquote(file)}: column {c!r} stands {names.count(c)} times in its header: {header}")
        groups[(len(names), *map(names.index, columns))].append(file)
    if not groups:
        return spark.createDataFrame([], StructType([StructField(c, StringType()) for c in [*columns, LINE, FILE]]))

    def group(width: int, places: tuple[int, ...], files: list[str]) -> DataFrame:
        named = {place: c for c, place in zip(columns, places)}
        schema = StructType([StructField(named.get(i, f"_c{i}"), StringType()) for i in range(width)] + [StructField(LINE, StringType())])
        # one layout: the caller's path, so that a folder of many files is not spelled out
        where = path if len(groups) == 1 else [_literal_path(f) for f in files]
        return (spark.read.schema(schema).option("header", True).option("delimiter", delimiter)
                .option("columnPruning", False)   # else a line is not counted to its end
                .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", LINE).csv(where)
                .select(*(F.col(f"`{c}`") for c in columns), LINE, F.col("_metadata.file_path").alias(FILE)))

    return reduce(DataFrame.unionByName, (group(key[0], key[1:], files) for key, files in sorted(groups.items())))


def malformed_line() -> Column:
    """What is wrong with a line as such: a reason, or null."""
    return F.when(F.col(LINE).isNotNull(), F.lit("malformed line: wrong number of fields"))


def missing_or_malformed(name: str, parsed: Column, required: bool) -> Column:
    """What is wrong with a text field that parses to ``parsed``: a reason, or null."""
    raw = F.col(name)
    empty = raw.isNull() | (F.trim(raw) == "")
    reason = F.when(~empty & parsed.isNull(), F.concat(F.lit(f"malformed {name}: "), raw))
    return F.when(empty, F.lit(f"missing {name}")).otherwise(reason) if required else reason


def all_accepted(rows: DataFrame, reason: Column) -> DataFrame:
    """The rows, but a job error at the first one that has a ``reason``.

    A filter, so that it is evaluated whatever columns a report prunes.
    """
    fail = F.raise_error(F.concat(reason, F.lit(" in "), F.coalesce(F.col(FILE), F.lit("?")), F.lit(": "), F.coalesce(F.col(LINE), F.lit(""))))
    return rows.where(F.when(reason.isNull(), F.lit(True)).otherwise(fail.cast("boolean")))
