"""Line dedup with levelled sorted runs of line hashes.

The corpus is taken in ``batches``, the largest document ids first. What earlier
batches hold is a set of *runs*: tables of (line hash, documents, keeper) sorted
and bucketed by the hash, so that a batch is merged with the runs where they lie;
a run moves only when it is compacted. For each batch

1. its lines are reduced to one entry per hash: how many of its documents hold
   the line (up to the limit that matters) and the largest of their ids;
2. a merge with each run, then an anti-join with what they have settled (enough
   documents already), drops entries that need no more work; a line met first here
   brings its keeper, since no later batch has a larger id, and a known one counts on
   from where the runs stand;
3. the rest is added as a run of its own on level 0. When a level has ``fanout``
   runs they are compacted into one run of the next level.

In the end a hash with ``least`` documents or more is a repeated line, and each
document loses its copies unless it is the keeper. Lines are compared by 128
bits of their SHA-256: two different lines with one hash are not to be expected
in any corpus.

The texts are read twice, to hash their lines and to cut them; in between only
hashes and ids move. A line that a third of all documents hold is spread by their
ids before it is counted, and its count is reduced per task. Runs are Parquet
tables under the shared checkpoint folder: a lost executor repeats a batch's step
at most. They are removed as soon as the list of lines to drop is written.

Defined results: null and empty texts are one empty line; rows with a null id
hold no line and lose none; rows that repeat an id count as one document and
each lose the same lines; a line that repeats inside a document counts once; an
empty table gives an empty result; extra columns are carried in ``row``.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from holdfast.llm.common import ship_package, table, written
from holdfast.llm.textblocks import binary_column
from holdfast.session import remove_folder, scratch_dir

SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, LOWER)


def line_hash(line: Column) -> Column:
    return F.unhex(F.substring(F.sha2(line_key(line).cast("binary"), 256), 1, 32))


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


class Runs:
    """Levels of sorted runs of (hash, docs, keeper), kept as bucketed tables."""

    def __init__(self, spark: SparkSession, least: int, fanout: int):
        self.spark, self.least, self.fanout = spark, least, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.folder, self.name = scratch_dir(spark, "line-runs"), f"line_runs_{uuid.uuid4().hex}"
        self.levels: list[list[str]] = []
        self.made = 0

    def _write(self, entries: DataFrame) -> str:
        """A run: one sorted file per bucket."""
        name, self.made = f"{self.name}_{self.made}", self.made + 1
        (entries.repartition(self.buckets, "hash").sortWithinPartitions("hash").write.format("parquet")
         .bucketBy(self.buckets, "hash").sortBy("hash").option("path", f"{self.folder}/{name}").saveAsTable(name))
        return name

    def merged(self, names: list[str]) -> DataFrame:
        """One entry per hash of several runs.

        Read as plain files: Spark takes a union of bucketed tables for bucketed
        and may then scan its tables as if they were not.
        """
        every = self.spark.read.schema("hash binary, docs int, keeper long").parquet(*(f"{self.folder}/{name}" for name in names))
        return every.groupBy("hash").agg(F.max("docs").alias("docs"), F.max("keeper").alias("keeper"))

    def looked_up(self, entries: DataFrame) -> DataFrame:
        """The batch's entries with the documents counted before (``before``, 0 if
        none) and the keeper. A run is bucketed and sorted by hash, so each of
        these joins merges it with the batch where it lies."""
        found = entries.withColumn("before", F.lit(0))
        for name in self.names():
            run = self.spark.table(name).select("hash", F.col("docs").alias("known"), F.col("keeper").alias("first"))
            found = found.join(run.hint("merge"), "hash", "left").select(
                "hash", "docs", F.greatest("keeper", "first").alias("keeper"), F.greatest("before", F.coalesce("known", F.lit(0))).alias("before"))
        return found

    def add(self, entries: DataFrame) -> None:
        """The entries of a batch whose ids are all smaller than those before it:
        what the runs have settled goes, a known hash counts on."""
        found = self.looked_up(entries).where(F.col("before") < self.least)
        docs = F.least(F.col("docs") + F.col("before"), F.lit(self.least)).cast("int")
        self._place(0, self._write(found.select("hash", docs.alias("docs"), "keeper")))

    def _place(self, level: int, name: str) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) >= self.fanout:
            run = self._write(self.merged(self.levels[level]))
            for old in self.levels[level]:
                self._drop(old)
            self.levels[level] = []
            self._place(level + 1, run)

    def names(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove_folder(self.spark, f"{self.folder}/{name}")

    def close(self) -> None:
        for name in self.names():
            self._drop(name)
        remove_folder(self.spark, self.folder)


def batch_of(docs: DataFrame, id_col: str, batches: int) -> Column:
    """The batch of each row, 0 for the largest ids: about as many rows in each."""
    shares = [k / batches for k in range(1, batches)]
    cuts = docs.where(F.col(id_col).isNotNull()).agg(F.approx_percentile(id_col, shares)).first()[0] if shares else []
    return reduce(lambda n, cut: n + (F.col(id_col) < cut).cast("int"), sorted(set(cuts or [])), F.lit(0))


def held_lines(docs: DataFrame, id_col: str, text_col: str, shortest: int, batches: int) -> DataFrame:
    """(``batch``, ``id``, ``hash``) of the distinct lines of each row that are long
    enough; written once, a folder per batch, so the texts are not read again."""
    spark, known = docs.sparkSession, docs.where(F.col(id_col).isNotNull())
    long = F.filter(lines(F.col(text_col)), lambda x: F.length(line_key(x)) >= shortest)
    held = known.select(
        F.col(id_col).cast("long").alias("id"), F.explode(F.array_distinct(F.transform(long, line_hash))).alias("hash"), batch_of(docs, id_col, batches).alias("batch"))
    path = scratch_dir(spark, "held-lines")
    held.write.partitionBy("batch").parquet(path)
    return spark.read.schema("id long, hash binary, batch int").parquet(path)


def batch_entries(held: DataFrame, least: int) -> DataFrame:
    """(``hash``, ``docs`` up to ``least``, ``keeper``) of a batch.

    First the rows of one id become one document, by hash and id, so that a line
    of very many documents is spread by their ids; then the documents of a hash
    are counted, task by task before they meet.
    """
    once = held.groupBy("hash", "id").agg(F.lit(1).alias("one"))
    return once.groupBy("hash").agg(F.least(F.count("one"), F.lit(least)).cast("int").alias("docs"), F.max("id").alias("keeper"))


def lines_to_drop(held: DataFrame, least: int = 3, batches: int = 4, fanout: int = 3) -> DataFrame:
    """(``id``, ``hashes``) of the documents that lose lines, written."""
    spark, runs = held.sparkSession, Runs(held.sparkSession, least, fanout)
    try:
        for batch in range(batches):
            runs.add(batch_entries(held.where(F.col("batch") == batch), least))
        # written, so that the join's sides are plain exchanges and a line of very many documents can be split
        repeated = written(runs.merged(runs.names()).where(F.col("docs") >= least).select("hash", "keeper"), "repeated-lines")
        goes = held.join(repeated, "hash").where("id <> keeper").groupBy("id").agg(F.collect_set("hash").alias("hashes"))
        return written(goes, "lines-to-drop")
    finally:
        runs.close()


def _without(text_col: str, shortest: int):
    """Takes the listed lines out of each text."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            row = batch.column("row")
            texts, listed = binary_column(row.field(text_col)).to_pylist(), batch.column("hashes").to_pylist()
            kept, before, dropped = [], [], []
            for text, hashes in zip(texts, listed):
                split = (text or b"").split(b"\n")
                before.append(len(split))
                if hashes:
                    goes = set(hashes)
                    split = [x for x in split if not drops(x, goes, shortest)]
                    text = b"\n".join(split)
                dropped.append(before[-1] - len(split))
                kept.append(text)
            yield pa.RecordBatch.from_arrays([
                row, pa.array(kept, pa.binary()).cast(pa.string()), pa.array(before, pa.int64()), pa.array(dropped, pa.int64())], ["row", "text", "n_lines", "n_dropped"])

    return run


def drops(line: bytes, goes: set[bytes], shortest: int) -> bool:
    key = line.strip(SPACE.encode()).lower()  # bytes: A-Z only
    return len(key) >= shortest and sha256(key).digest()[:16] in goes


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 20, least: int = 3, batches: int = 4, fanout: int = 3) -> DataFrame:
    """One row per input row: ``row`` (its columns as they were), ``text`` without
    the repeated lines (null stays null), ``n_lines`` before and ``n_dropped``."""
    ship_package(docs.sparkSession)
    held = held_lines(docs, id_col, text_col, shortest, batches)
    goes = lines_to_drop(held, least, batches, fanout).select(F.col("id").alias("of"), "hashes")
    packed = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"))
    packed = packed.join(goes, F.col(f"row.`{id_col}`").cast("long") == F.col("of"), "left").select("row", "hashes")
    schema = T.StructType([T.StructField("row", T.StructType(docs.schema.fields)), T.StructField("text", T.StringType()),
                           T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    return packed.mapInArrow(_without(text_col, shortest), schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op12: lines, dropped lines and digest of the rest of each document."""
    found = drop_repeated_lines(table(spark, sf_dir, "documents"))
    return found.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS p FROM documents),
k AS (
  SELECT doc_id, line, p, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.*, r.key IS NOT NULL AND doc_id <> keeper AS goes FROM k LEFT JOIN r USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (goes) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT goes), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
