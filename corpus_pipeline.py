"""The corpus pipeline: toxicity, near duplicates, repeated passages, benchmark
leaks, mixture.

Each stage takes (spark, docs, sf_dir) and returns the documents that it keeps,
as it leaves them; all but the last return the columns of ``documents``. Every
stage works on all that its predecessor kept and is written as Parquet before
the next one reads it.

Defined results: null and empty texts pass every filter that judges words and
are never taken by the mix; rows without an id are never near duplicates,
repeated passages or their sources; an empty table stays empty; extra columns
are carried along.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from holdfast.llm import op3_pareto_mixing as mixing
from holdfast.llm import op6_toxic_segments as toxicity
from holdfast.llm import op7_simhash as simhash
from holdfast.llm import op9_decontamination as decontamination
from holdfast.llm import op10_substring_dedup as substrings
from holdfast.llm.common import forget, passing, table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more go; learnt from the labels that op6 may learn from."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), toxicity.remainder(5) != 0)
    return toxicity.score_toxicity(docs, model).where("score < 0.5").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays, the one with the smallest id."""
    return simhash.keep_one(docs, shingle=4, max_bits=4)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 13 words or more that an earlier document holds are cut out;
    a document of which nothing is left goes. ``n_chars`` follows the text."""
    found = substrings.remove_repeated_passages(docs).where(~((substrings.removed_symbols() == F.col("n_symbols")) & (F.col("n_symbols") > 0)))
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        changed = F.size("spans") > 0
        new["n_chars"] = F.when(changed, F.length("text")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)
    return found.select(*(new.get(c, F.col("row")[c]).alias(c) for c in docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with benchmark windows in a twentieth of their words or more go."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with their number of copies."""
    return mixing.mixed(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeated_passages),
    ("benchmark_decontamination", drop_contaminated),
    ("source_mixing", mix_sources),
]

# fingerprints (XXH64) and the fitted toxicity model are beyond SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES, 1):
        if k == len(STAGES):
            return stage(spark, docs, sf_dir)
        with passing(spark):
            docs = written(stage(spark, docs, sf_dir), name)
        if last is not None:
            forget(spark, last)
        last = docs
