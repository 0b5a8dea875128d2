"""Mixing sources to target weights by Pareto order sampling.

1. Sources get their share of all words by weight; no source may give more than
   ``max_copies`` times its words, and what is over is shared again by weight.
2. Inside a source the expected copies of a document are proportional to its
   propensity (here the bit length of its size, so a longer document is a little
   likelier) and at most ``max_copies``; the factor is solved for exactly, so
   the expected words equal the target.
3. The whole part of the expected copies is certain. The rest is the inclusion
   probability p of one more copy: documents are ranked by Pareto's ratio
   (u / (1 - u)) / (p / (1 - p)) with a random u that depends on the id only,
   and taken in that order up to the words still missing; the remaining document
   that fits the last gap best closes it.

Only totals by source and class, and by source and rank cell, are gathered. The
exact order is needed in the one cell of each source where the missing words
are reached; cells are fixed slices of the ratio, so a large source spreads.

Defined results: null or empty texts have no words and are never taken; a null
source is a source, the last one; an empty table gives an empty result; rows
that repeat an id have the same random number and are ranked by their size; a
null id has the random number of an empty id; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from holdfast.llm.common import table, written

WORD = "[^\\x20\\x09-\\x0D]+"
WEIGHTS = (5, 2, 1)
CELLS = 4096


def uniform(key: Column, seed: str = "mix") -> Column:
    """A number in (0, 1) from 52 bits of the key's MD5."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), key).cast("binary")), 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / F.lit(float(1 << 52))


def source_targets(sized: DataFrame, weights=WEIGHTS, max_copies: int = 3) -> DataFrame:
    """(source, source_size, target) with the targets of the sources, in code point order."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    # one row per source: the windows over all of them are small
    rank = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(F.row_number().over(rank) - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sources.select("source", "source_size", weight.alias("weight"), F.sum("source_size").over(Window.partitionBy()).alias("total"))
    # sources that reach the limit come first when sorted by limit / weight
    limit = F.col("source_size") * max_copies
    order = Window.orderBy(limit / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.col("total") - F.coalesce(F.sum(limit).over(before), F.lit(0))) / F.sum("weight").over(after)
    free = ranked.select("*", level.alias("level")).select(
        "*", F.max(F.when(F.col("weight") * F.col("level") <= limit, F.col("level"))).over(Window.partitionBy()).alias("share"))
    target = F.when(F.col("weight") * F.col("level") > limit, limit.cast("double")).otherwise(F.col("weight") * F.col("share"))
    return free.select("source", "source_size", target.cast("double").alias("target"))


def pareto_mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights=WEIGHTS, max_copies: int = 3, seed: str = "mix",
) -> DataFrame:
    """One row per document: ``id``, ``source``, ``size``, ``source_size``,
    ``target``, ``expected`` copies, ``copies`` and ``taken`` words."""
    return _plan(written(_sized(docs, id_col, text_col, source_col), "sized"), weights, max_copies, seed).drop("row")


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, *more: Column) -> DataFrame:
    """What the plan needs of each document, and a number of its ``row``: a name of
    its own for each of several equal rows, once it is written."""
    return docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.monotonically_increasing_id().alias("row"), *more,
    ).withColumn("grade", F.length(F.bin(F.col("size") + 1)))


def _plan(sized: DataFrame, weights, max_copies: int, seed: str) -> DataFrame:

    # expected copies = factor * grade, cut at max_copies: the factor of each source
    grades = sized.groupBy("source", "grade").agg(F.sum("size").alias("words"))
    targets = written(source_targets(grades.withColumnRenamed("words", "size"), weights, max_copies), "targets")
    by_grade = grades.join(targets.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    own = Window.partitionBy("source").orderBy(F.col("grade").desc())
    above = F.coalesce(F.sum("words").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    below = F.sum(F.col("words") * F.col("grade")).over(own.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    factor = F.try_divide(F.col("target") - above * max_copies, below.cast("double"))
    whole = Window.partitionBy("source")
    solved = by_grade.select("*", factor.alias("f")).select(
        "*", F.max_by("f", F.when(F.col("f") * F.col("grade") <= max_copies * (1 + 1e-12), F.col("grade"))).over(whole).alias("factor"))
    full = F.col("target") >= F.col("source_size") * max_copies
    expected = F.when(full | F.col("factor").isNull(), F.lit(float(max_copies))).otherwise(F.least(F.lit(float(max_copies)), F.col("factor") * F.col("grade")))
    shares = solved.select("source", "grade", "words", "source_size", "target", expected.alias("expected"))
    certain = F.floor("expected").cast("long")
    shares = shares.select(
        F.col("source").alias("of"), F.col("grade").alias("of_grade"), "source_size", "target", "expected", certain.alias("certain"),
        (F.col("expected") - certain).alias("p"),
        (F.col("target") - F.sum(F.col("words") * certain).over(whole)).alias("missing"))
    shares = written(shares, "shares")

    u, p = uniform(F.coalesce(F.col("id").cast("string"), F.lit("")), seed), F.col("p")
    ratio = F.when(p > 0, u * (1 - p) / ((1 - u) * p))
    ranked = sized.join(shares, F.col("source").eqNullSafe(F.col("of")) & (F.col("grade") == F.col("of_grade"))).drop("of", "of_grade").withColumn("ratio", ratio)
    ranked = ranked.withColumn("cell", F.floor(F.col("ratio") / (1 + F.col("ratio")) * CELLS))
    cells = ranked.where("ratio IS NOT NULL").groupBy("source", "cell", "missing").agg(F.sum("size").alias("words"))
    running = F.sum("words").over(Window.partitionBy("source").orderBy("cell"))
    # the cell where each source reaches its missing words: all before it are taken, none after
    reached = cells.select(F.col("source").alias("of"), "cell", "words", "missing", running.alias("upto")).where("upto > missing")
    turn = written(reached.groupBy("of").agg(F.min("cell").alias("turn"), F.min_by(F.col("upto") - F.col("words"), "cell").alias("already")), "turn")
    ranked = ranked.join(turn, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
    order = Window.partitionBy("source").orderBy("ratio", "id", "size", "row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inner = ranked.where("cell = turn").withColumn("more", (F.col("already") + F.sum("size").over(order) <= F.col("missing")).cast("long"))
    outer = ranked.where("NOT coalesce(cell = turn, false)").withColumn(
        "more", F.when(F.col("ratio").isNull(), 0).when(F.col("turn").isNull(), 1).otherwise((F.col("cell") < F.col("turn")).cast("int")).cast("long"))
    ranked = written(inner.unionByName(outer), "ranked")

    # what is missing to the last word: one more document, the one that fits best
    gaps = ranked.groupBy("source", "missing").agg(F.sum(F.col("size") * F.col("more")).alias("got")).select(
        F.col("source").alias("of"), (F.col("missing") - F.col("got")).alias("gap"))
    off = F.abs(F.col("size") - F.col("gap"))
    spare = ranked.where("ratio IS NOT NULL AND more = 0").join(written(gaps, "gaps"), F.col("source").eqNullSafe(F.col("of")))
    best = spare.where(off < F.col("gap")).groupBy("source").agg(F.min_by("row", F.struct(off, "ratio", "id", "size", "row")).alias("last"))
    best = written(best.withColumnRenamed("source", "of"), "best")
    ranked = ranked.join(best, F.col("source").eqNullSafe(F.col("of")), "left")
    copies = F.col("certain") + F.col("more") + F.col("row").eqNullSafe(F.col("last")).cast("long")
    return ranked.select(
        "row", "id", "source", "size", "source_size", "target", "expected", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mixed(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, max_copies: int = 3, seed: str = "mix",
) -> DataFrame:
    """The documents that the mix takes, with the number of ``copies`` of each row
    (a ``copies`` column of the input is replaced). The documents are written once
    with their row numbers, so that equal rows can have different numbers of
    copies and a repeated id is no heavy key."""
    whole = F.struct(*(docs[f"`{c}`"].alias(c) for c in docs.columns)).alias("document")
    sized = written(_sized(docs, id_col, text_col, source_col, whole), "sized")
    plan = _plan(sized.drop("document"), weights, max_copies, seed).where("taken > 0").select(F.col("row").alias("of"), "copies")
    return sized.select("row", "document").join(plan, F.col("row") == F.col("of")).select(
        *(F.col(f"document.`{c}`") for c in docs.columns if c != "copies"), "copies")


def query(spark, sf_dir: str) -> DataFrame:
    """op3: words that the mix takes of each document."""
    found = pareto_mix(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


ORACLE = r"""
WITH s AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         (CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
  FROM documents),
src AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight FROM s GROUP BY source),
lev AS (
  SELECT *, ((SELECT sum(source_size)::BIGINT FROM src) - coalesce(sum(3 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)::DOUBLE
            / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM src WINDOW o AS (ORDER BY (3 * source_size)::DOUBLE / weight, source NULLS LAST)),
tgt AS (
  SELECT source, source_size, CASE WHEN weight * level > 3 * source_size THEN (3 * source_size)::DOUBLE
         ELSE weight * (SELECT max(level) FROM lev WHERE weight * level <= 3 * source_size) END AS target FROM lev),
g AS (SELECT source, length(bin(size + 1)) AS grade, sum(size)::BIGINT AS words FROM s GROUP BY ALL),
f AS (
  SELECT g.*, source_size, target,
         (target - 3 * coalesce(sum(words) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)
         / nullif(sum(words * grade) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0)::DOUBLE AS f
  FROM g JOIN tgt ON g.source IS NOT DISTINCT FROM tgt.source WINDOW w AS (PARTITION BY g.source ORDER BY grade DESC)),
e AS (
  SELECT *, CASE WHEN target >= 3 * source_size OR factor IS NULL THEN 3.0::DOUBLE ELSE least(3.0::DOUBLE, factor * grade) END AS expected
  FROM (SELECT *, arg_max(f, CASE WHEN f * grade <= 3 * (1 + 1e-12::DOUBLE) THEN grade END) OVER (PARTITION BY source) AS factor FROM f)),
m AS (
  SELECT *, floor(expected)::BIGINT AS certain, expected - floor(expected) AS p,
         target - sum(words * floor(expected)::BIGINT) OVER (PARTITION BY source)::BIGINT AS missing FROM e),
r AS (
  SELECT s.*, m.source_size, m.target, m.certain, m.missing, CASE WHEN p > 0 THEN u * (1 - p) / ((1 - u) * p) END AS ratio
  FROM s JOIN m ON s.source IS NOT DISTINCT FROM m.source AND length(bin(s.size + 1)) = m.grade),
c AS (
  SELECT *, coalesce(ratio IS NOT NULL AND sum(CASE WHEN ratio IS NULL THEN 0 ELSE size END) OVER (
         PARTITION BY source ORDER BY ratio NULLS LAST, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= missing, false) AS more FROM r),
gap AS (SELECT source, any_value(missing) - sum(CASE WHEN more THEN size ELSE 0 END)::BIGINT AS gap FROM c GROUP BY source),
b AS (
  SELECT c.source, arg_min(doc_id, (abs(size - gap), ratio, doc_id, size)) AS last
  FROM c JOIN gap ON c.source IS NOT DISTINCT FROM gap.source
  WHERE ratio IS NOT NULL AND NOT more AND abs(size - gap) < gap GROUP BY c.source)
SELECT doc_id, size, source_size, target, size * (certain + more::BIGINT + (doc_id IS NOT DISTINCT FROM b.last)::BIGINT) AS taken
FROM c LEFT JOIN b ON c.source IS NOT DISTINCT FROM b.source
"""
