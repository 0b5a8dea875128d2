"""Embedding near-dedup by cross-polytope hashing.

Vectors that are equal (same label, same components) are one node with a
weight. A node is hashed in ``tables`` tables by ``hashes`` pseudo-random
rotations each (three rounds of random signs and a fast Hadamard transform); a
rotation's hash is the axis, with its sign, nearest to the rotated vector. The
node is stored in its own cell of every table and looked up there and in the
``probes`` next nearest cells. Pairs that meet are made distinct and verified by
the cosine in double precision.

Measured by simulation in 64 dimensions, the defaults find over 0.999 of the
pairs at a cosine of 0.93, and more above; the tests measure recall against
brute force. ``hashes`` sets how many cells a table has ((2 * dimensions) **
hashes): raise it with the number of vectors.

Defined results: vectors that are null, empty, zero or hold a null, NaN or
infinite component, or whose label is null, link with nothing and are their own
component; vectors of different lengths do not link; repeated rows are vectors
that link with each other; a null id is never a component's name unless all its
members' are; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from holdfast.llm.common import ship_package, table, written
from holdfast.llm.components import components
from holdfast.llm.textblocks import U64, mix

TOP = 4  # axes of a rotation that a probe may take


def hadamard(x: np.ndarray) -> np.ndarray:
    """Rows times the normalised Hadamard matrix; their length is a power of two."""
    n, d = x.shape
    half = 1
    while half < d:
        x = x.reshape(n, -1, 2, half)
        x = np.concatenate((x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]), axis=2).reshape(n, d)
        half *= 2
    return x / np.sqrt(d)


def cells(vectors: np.ndarray, tables: int, hashes: int, probes: int, seed: int) -> np.ndarray:
    """Cell codes (rows x tables x (1 + probes)), nearest first."""
    n, length = vectors.shape
    d = 1 << max(1, (length - 1).bit_length())
    x = np.zeros((n, d))
    x[:, :length] = vectors
    top = min(TOP, d)
    choices = np.array(list(product(range(top), repeat=hashes)))
    width = min(1 + probes, len(choices))
    out = np.empty((n, tables, width), U64)
    random = np.random.default_rng([seed, d])
    for t in range(tables):
        loss, code, axes = 0.0, np.zeros((n, width), np.int64), []
        for _ in range(hashes):
            rotated = x
            for signs in random.choice([-1.0, 1.0], size=(3, d)):
                rotated = hadamard(rotated * signs)
            order = np.argsort(-np.abs(rotated), axis=1, kind="stable")[:, :top]
            value = np.take_along_axis(rotated, order, 1)
            axes.append(order * 2 + (value < 0))
            value = np.abs(value)
            loss = loss + ((value[:, :1] - value) ** 2)[:, choices[:, len(axes) - 1]]
        nearest = np.argsort(loss, axis=1, kind="stable")[:, :width]
        for k in range(hashes):
            code = code * (2 * d) + np.take_along_axis(axes[k], choices[nearest][:, :, k], 1)
        out[:, t] = mix(code.astype(U64) + U64(t << 56))
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    """The vectors, each divided by its largest component: a cosine does not depend on
    lengths, and squares then neither overflow nor vanish."""
    rows = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return rows / np.abs(rows).max(axis=1, keepdims=True)


def near_links(nodes: DataFrame, threshold: float, tables: int = 10, hashes: int = 3, probes: int = 8, seed: int = 7) -> DataFrame:
    """Verified links (a, b), a < b, of ``nodes`` (node, room, vector); only nodes of the same room link."""

    def hashed(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            node, room = batch.column("node").to_numpy(), batch.column("room").to_numpy().view(U64)
            lengths = batch.column("vector").value_lengths().to_numpy()
            for length in np.unique(lengths):
                at = np.flatnonzero(lengths == length)
                for part in np.array_split(at, -(-len(at) // 2048)):
                    found = cells(_matrix(batch.column("vector").take(pa.array(part))), tables, hashes, probes, seed)
                    found = mix(found ^ room[part][:, None, None])
                    own = np.zeros(found.shape, bool)
                    own[:, :, 0] = True
                    yield pa.RecordBatch.from_arrays([
                        pa.array(found.ravel().view(np.int64)), pa.array(np.repeat(node[part], found[0].size)), pa.array(own.ravel())], ["cell", "node", "own"])

    def verified(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            lengths = [batch.column(c).value_lengths().to_numpy() for c in ("x", "y")]
            for length in np.unique(lengths[0]):
                at = np.flatnonzero((lengths[0] == length) & (lengths[1] == length))
                x, y = (_matrix(batch.column(c).take(pa.array(at))) for c in ("x", "y"))
                cosine = np.einsum("ij,ij->i", x, y) / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y))
                keep = pa.array(at[cosine >= threshold])
                yield pa.RecordBatch.from_arrays([batch.column("a").take(keep), batch.column("b").take(keep)], ["a", "b"])

    dealt = written(nodes.mapInArrow(hashed, "cell long, node long, own boolean"), "cells")
    stored = dealt.where("own").select("cell", F.col("node").alias("x"))
    met = stored.join(dealt, "cell").where("x < node OR (NOT own AND x <> node)")
    pairs = met.select(F.least("x", "node").alias("a"), F.greatest("x", "node").alias("b")).distinct()
    side = lambda n, v: nodes.select(F.col("node").alias(n), F.col("room").alias(n + "_room"), F.col("vector").alias(v))
    both = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").where("a_room = b_room")
    return both.select("a", "b", "x", "y").mapInArrow(verified, "a long, b long")


def near_duplicates(
    embeddings: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", **options,
) -> DataFrame:
    """(``id``, ``n_links``, ``component`` the smallest id reachable by links) for every row."""
    ship_package(embeddings.sparkSession)
    vector = F.col("vector")
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = embeddings.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), F.col(label_col).alias("label"))
    good = F.coalesce(F.col("label").isNotNull() & vector.isNotNull() & F.forall(vector, number) & F.exists(vector, lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("key", F.when(good, F.sha2(F.concat_ws("|", F.col("label").cast("string"), vector.cast("string")).cast("binary"), 256)))

    # one node per label and vector
    nodes = written(rows.where("key IS NOT NULL").groupBy("key").agg(
        F.min("id").alias("least"), F.count("*").alias("weight"), F.first("vector").alias("vector"), F.first("label").alias("label")).select(
        "key", "least", "weight", "vector", F.xxhash64("label", F.size("vector")).alias("room"), F.monotonically_increasing_id().alias("node")), "nodes")
    links = written(near_links(nodes.select("node", "room", "vector"), threshold, **options), "links")
    both = links.union(links.select("b", "a"))
    slim = nodes.select("node", "least", "weight", "key")
    linked = both.join(slim.select(F.col("node").alias("b"), "weight"), "b").groupBy("a").agg(F.sum("weight").alias("others"))
    roots = written(components(links), "roots")
    named = written(slim.join(roots, "node", "left").join(linked.withColumnRenamed("a", "node"), "node", "left").select(
        "key", "least", F.coalesce("component", "node").alias("root"), (F.col("weight") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")), "named")
    first = written(named.groupBy("root").agg(F.min("least").alias("component")), "first")
    found = written(named.join(first, "root").select(F.col("key").alias("of"), "n_links", "component"), "found")
    return rows.select("id", "key").join(found, F.col("key") == F.col("of"), "left").select(
        "id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("of").isNull(), F.col("id")).otherwise(F.col("component")).alias("component"))


def query(spark, sf_dir: str) -> DataFrame:
    """op4: links and component of each vector."""
    found = near_duplicates(table(spark, sf_dir, "embeddings"), 0.93)
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach(a, b) AS (
  SELECT vec_id, vec_id FROM v
  UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a)
SELECT v.vec_id, CAST((SELECT count(*) FROM l WHERE l.a = v.vec_id) AS BIGINT) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON v.vec_id = c.a
"""
