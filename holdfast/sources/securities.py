"""Securities-master sources and sinks.

* snapshots: the exchange's listing as JSON (one folder per segment, files
  holding either a JSON array or one object per line), every key read into a
  VARIANT so that the value's JSON type is still known when it is cleaned;
* CSV files, one folder per segment, as the refresh job hands them over;
* the master table itself (Parquet data folders, partitioned by segment, and
  numbered commits that list the folders which make up the table);
* JDBC, for a master table that lives in a database.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType, VariantType

from holdfast.schemas import SECURITIES, SECURITIES_COLUMNS, SNAPSHOT_KEYS
from holdfast.session import create_file_if_absent, file_names, folder_ages, read_small_file, remove_folder

SNAPSHOT = StructType([StructField(key, VariantType()) for key in SNAPSHOT_KEYS] + [StructField("segment", StringType())])


def read_snapshots(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Raw snapshot records: a VARIANT column per JSON key, and the segment.

    ``path`` holds ``segment=<name>/`` folders; Spark's partition discovery
    supplies the segment, as the file name did for the reference's files.
    Lines may hold one record or a whole JSON array each; files are split
    across tasks. ``multi_line=True`` reads records that stretch over lines
    (pretty-printed arrays), and splits those files too. Text that is not JSON
    fails the job.
    """
    if multi_line:
        return _read_spread_records(spark, path)
    return spark.read.schema(SNAPSHOT).option("mode", "FAILFAST").json(path)


# A JSON text, possessive so that long ones cannot exhaust the matcher's stack.
_TEXT = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_CUT = "\x00"     # never stands in JSON itself


def _read_spread_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of JSON files laid out over lines, from as many tasks as the files have splits.

    A line feed cannot stand inside a JSON text, so each line's braces can be
    counted alone. The running depth inside a split, and the depth and the
    records before it (one row per split), say where each record starts; the
    pieces of a record are put together by its number, also across splits.
    """
    lines = spark.read.schema("value string, segment string").text(path).select(
        "segment", "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("line"))
    # a mark after every text and after every "}," that "{" follows, then those after texts removed:
    # what is left separates records that share a line
    marked = F.regexp_replace("value", _TEXT + r"|\}\s*,?\s*(?=\{)", "$0" + _CUT)
    pieces = lines.select("segment", "file", "split", "line", F.posexplode(F.split(F.replace(marked, F.lit('"' + _CUT), F.lit('"')), _CUT)).alias("part", "piece"))
    bare = F.regexp_replace("piece", _TEXT, "")
    count = lambda brace: F.length(bare) - F.length(F.translate(bare, brace, ""))
    pieces = pieces.select("*", count("{").alias("opens"), (count("{") - count("}")).alias("deeper"))

    own = Window.partitionBy("file", "split").orderBy("line", "part")
    inside = pieces.select("*", (F.sum("deeper").over(own) - F.col("deeper")).alias("depth"))
    # how deep a split starts follows from the splits before it
    totals = pieces.groupBy("file", "split").agg(F.sum("deeper").alias("all_deeper"))
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(F.col("file").alias("of"), F.col("split").alias("of_split"), F.coalesce(F.sum("all_deeper").over(earlier), F.lit(0)).alias("before"))
    begun = inside.join(starts, (F.col("file") == F.col("of")) & (F.col("split") == F.col("of_split"))).withColumn(
        "new", ((F.col("depth") + F.col("before") == 0) & (F.col("opens") > 0)).cast("long"))
    in_order = Window.partitionBy("file", "split").orderBy("line", "part")
    numbered = begun.select("segment", "file", "split", "line", "part", "piece", F.sum("new").over(in_order).alias("number"))
    counts = numbered.groupBy("file", "split").agg(F.max("number").alias("records"))
    counts = counts.select(F.col("file").alias("of"), F.col("split").alias("of_split"), F.coalesce(F.sum("records").over(earlier), F.lit(0)).alias("before"))
    placed = numbered.join(counts, (F.col("file") == F.col("of")) & (F.col("split") == F.col("of_split"))).withColumn("record", F.col("before") + F.col("number"))
    whole = placed.groupBy("segment", "file", "record").agg(F.array_sort(F.collect_list(F.struct("split", "line", "part", "piece"))).alias("pieces"))
    text = F.concat_ws("\n", F.col("pieces.piece"))
    # brackets and commas of the array around the records
    text = F.regexp_replace(F.regexp_replace(text, r"^[\s,\[]+", ""), r"[\s,\]]+$", "")
    stray = ~(F.col("text").startswith("{") & F.col("text").endswith("}"))
    checked = F.when(stray, F.raise_error(F.concat(F.lit("not a JSON record: "), F.substring("text", 1, 200)))).otherwise(F.col("text"))
    record = F.from_json(checked, StructType(SNAPSHOT.fields[:-1]), {"mode": "FAILFAST"})
    return (whole.select("segment", text.alias("text")).where("text <> ''").select(record.alias("record"), "segment")
            .select(*(F.col(f"record.{key}").alias(key) for key in SNAPSHOT_KEYS), "segment"))


def write_snapshots(securities: DataFrame, path: str, pretty: bool = False) -> None:
    """Write securities in the listing service's JSON shape, one folder per segment.

    Null fields are left out of the records, as an absent key in the feed. With
    ``pretty`` each segment is one array laid out over lines, as the service
    delivers it; a segment is then one row, so that form is for small tables.
    """
    fields = [F.col(column).alias(key) for key, column in SNAPSHOT_KEYS.items()]
    if not pretty:
        securities.select("segment", *fields).write.mode("overwrite").partitionBy("segment").json(path)
        return
    records = securities.select("segment", F.to_json(F.struct(*fields), {"pretty": "true"}).alias("record"))
    array = F.concat(F.lit("[ "), F.array_join(F.array_sort(F.collect_list("record")), ", "), F.lit(" ]"))
    records.groupBy("segment").agg(array.alias("value")).write.mode("overwrite").partitionBy("segment").text(path)


def _file_schema() -> StructType:
    # partition column last: it comes from the folder, not from the file
    data = [f for f in SECURITIES.fields if f.name != "segment"]
    return StructType(data + [StructField("segment", StringType())])


def write_securities_csv(securities: DataFrame, path: str) -> None:
    """Header CSV, one folder per segment (the hand-over format of the refresh)."""
    (securities.select(*SECURITIES_COLUMNS)
     .write.mode("overwrite").partitionBy("segment").option("header", True).csv(path))


def read_securities_csv(spark: SparkSession, path: str) -> DataFrame:
    """Read the hand-over CSV strictly: header names must match, bad rows fail the load."""
    return (
        spark.read.schema(_file_schema())
        .option("header", True)
        .option("enforceSchema", False)
        .option("columnPruning", False)     # a cut line is one, whatever columns are used
        .option("mode", "FAILFAST")
        .csv(path)
        .select(*SECURITIES_COLUMNS)
    )


MASTER = StructType(SECURITIES.fields + [StructField("id", LongType())])
DATA = "load="     # also a partition column, so that any folders are read by one scan
COMMITS = "commits"

# Access paths beside the segment folders and the scrip_id order: a bloom filter
# in every row group tells that a code or an ISIN is not in it.
BLOOM = ("scrip_code", "isin_number")


def commits(spark: SparkSession, path: str) -> list[str]:
    """The table's commits, oldest first, by name."""
    return file_names(spark, os.path.join(path, COMMITS))


def commit_folders(spark: SparkSession, path: str, commit: str | None) -> list[str]:
    """The data folders that make up the table as of a commit."""
    return json.loads(read_small_file(spark, os.path.join(path, COMMITS, commit))) if commit else []


def new_data_folder() -> str:
    return f"{DATA}{uuid.uuid4().hex}"


def write_data(securities: DataFrame, path: str, folder: str) -> None:
    """Rows of the master to one data folder: partitioned by segment, with bloom filters.

    Nobody reads the folder before a commit names it.
    """
    writer = securities.select(*MASTER.fieldNames()).write.partitionBy("segment")
    for column in BLOOM:
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", True)
    writer.parquet(os.path.join(path, folder))


def commit(spark: SparkSession, path: str, folder: str, append: bool) -> None:
    """Publish a written data folder as the table (or, with ``append``, as a part of it).

    A commit is a file named by its number that lists the table's data folders.
    It is created only if no other writer has created it: of two writers one gets
    the number, and the other lists the winner's folders with its own under the
    next number. No rows are written again, and no writer's rows are lost.
    """
    while True:
        last = (commits(spark, path) or [None])[-1]
        folders = [*(commit_folders(spark, path, last) if append else []), folder]
        name = f"{int(last.split('.')[0]) + 1 if last else 1:012d}.json"
        if create_file_if_absent(spark, os.path.join(path, COMMITS, name), json.dumps(folders)):
            return


def remove_old_versions(spark: SparkSession, path: str, keep: int = 2, orphan_hours: float = 168) -> None:
    """The current commit and the one before stay, for readers that already planned
    on it. Data folders that only older commits name go, and those that no
    commit names once they are older than a writer may take (failed writes)."""
    found = commits(spark, path)
    kept = {f for c in found[-keep:] for f in commit_folders(spark, path, c)}
    dropped = {f for c in found[:-keep] for f in commit_folders(spark, path, c)}
    for folder, age in folder_ages(spark, path).items():
        if folder.startswith(DATA) and folder not in kept and (folder in dropped or age > orphan_hours * 3600):
            remove_folder(spark, os.path.join(path, folder))
    for c in found[:-keep]:
        remove_folder(spark, os.path.join(path, COMMITS, c))


def ensure_securities_table(spark: SparkSession, path: str) -> None:
    """Create the (empty) master table if it does not exist yet."""
    if not commits(spark, path):
        create_file_if_absent(spark, os.path.join(path, COMMITS, f"{1:012d}.json"), "[]")


def read_securities_table(spark: SparkSession, path: str) -> DataFrame:
    """The master table (Parquet, partitioned by segment), with its declared types.

    The schema is given, so ``segment`` stays a string whatever the folder
    names look like, and no job is spent inferring it.
    """
    found = commits(spark, path)
    if not found:
        raise ValueError(f"no securities table at {path}")
    folders = [os.path.join(path, f) for f in commit_folders(spark, path, found[-1])]
    if not folders:
        return spark.createDataFrame([], MASTER)
    return spark.read.schema(MASTER).option("basePath", path).parquet(*folders).select(*MASTER.fieldNames())


def read_securities_jdbc(spark: SparkSession, url: str, properties: dict, table: str = "securities",
                         column: str | None = None, bounds: tuple[int, int] | None = None,
                         partitions: int = 1) -> DataFrame:
    """Master table over JDBC; filters and the column list are pushed to the database.

    With a numeric or date ``column`` and its ``bounds`` the table is read by
    ``partitions`` tasks; without them by one.
    """
    split = {}
    if column is not None:
        if bounds is None:
            raise ValueError("a partition column needs its lower and upper bound")
        split = {"column": column, "lowerBound": bounds[0], "upperBound": bounds[1], "numPartitions": partitions}
    return spark.read.jdbc(url=url, table=table, properties=properties, **split).select(*SECURITIES_COLUMNS)
