"""Hard-negative mining by angular triangle filtering.

Vectors are made integer (floor of ``scale`` times each component), and a row's
score is its integer inner product with an anchor. For every anchor and each of
its best rows of the same label (positives), the best rows of other labels whose
score lies in a window below the positive's are its hard negatives.

1. A few reference directions are picked from a bounded sample, far from each
   other. Every row's angles to them are stored. A row belongs to the cell of its
   nearest direction, and a cell is dealt into blocks of about ``block`` rows, packed
   and written: in a block rows are sorted by label and angle and cut into chunks,
   each with the least and greatest angle to every direction and norm.
2. By the triangle inequality the angle of an anchor and a row lies between
   |a - b| and min(a + b, 2 pi - a - b) for its angles a and b to any direction. Of all
   directions together this gives an interval of the cosine and, times the
   norms and widened by more than all rounding, one of the score. It is taken for
   a whole cell when an anchor is sent out, and for a whole chunk in a block;
   only chunks whose interval meets what the anchor still looks for are scored, with
   integers.
3. An anchor's own block gives a first bound for its positives; it is then sent
   to the blocks that may hold better ones. With the positives known, it is sent
   to the blocks whose scores may fall into a window of one of them.

Anchors are a stated query set: they meet blocks of rows, never each other, and are
packed by block, so no vectors are joined pair by pair. A block's answer is at most
the best few rows of an anchor (and positive). What is broadcast is the directions and
a summary of each cell, both of fixed size. A direction that most rows are near is
dealt into more blocks, not into larger ones.

Defined results: rows with a null id or label, a null vector or a null or
non-finite component take no part; vectors of different lengths are compared as if the
shorter one ended in zeros (an empty one scores 0); rows that repeat an id are
rows each, and neither positives nor negatives of an anchor with that id; a positive
with a negative score has an empty window; an empty table, or one
without anchors, gives an empty result; other columns are not read. A score
beyond 64 bits is an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from holdfast.llm import blobs
from holdfast.llm.common import ship_package, table, written

INDEX, ANCHORS = 0, 1  # kinds of packed rows
CHUNK = 256
SLACK = 4e-6  # radians: more than angles stored in single precision can be off together
NONE, ANY = np.iinfo(np.int64).min, np.iinfo(np.int64).max  # a range without a lower or an upper end


@dataclass
class Geometry:
    """Reference directions (unit rows), and per cell its blocks and the ranges of its rows."""

    directions: np.ndarray
    first_block: np.ndarray | None = None
    blocks: np.ndarray | None = None
    near: np.ndarray | None = None  # cells x directions: least angle
    far: np.ndarray | None = None
    small: np.ndarray | None = None  # least norm of a cell
    large: np.ndarray | None = None

    @property
    def width(self) -> int:
        return self.directions.shape[1]

    def angles(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Norms, and angles to the directions (0 for a zero vector)."""
        peak = np.maximum(np.abs(vectors).max(axis=1, initial=0), 1)
        scaled = vectors / peak[:, None]  # so that squares neither overflow nor vanish
        norms = np.sqrt(np.einsum("ij,ij->i", scaled, scaled))
        cosine = scaled @ self.directions.T / np.where(norms > 0, norms, 1)[:, None]
        found = np.where(norms[:, None] > 0, np.arccos(np.clip(cosine, -1, 1)), 0)
        return norms * peak, found.astype(np.float32)


def score_bounds(angles: np.ndarray, norms: np.ndarray, near: np.ndarray, far: np.ndarray, small: np.ndarray, large: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least, greatest) possible score of each anchor with any row of each group of rows."""
    low = np.zeros((len(angles), len(near)))
    high = np.full(low.shape, np.pi)
    for r in range(angles.shape[1]):
        a, x, y = angles[:, r, None].astype(np.float64), near[None, :, r], far[None, :, r]
        low = np.maximum(low, np.maximum(a - y, x - a))
        high = np.minimum(high, np.minimum(a + y, 2 * np.pi - a - x))
    best, worst = np.cos(np.maximum(low - SLACK, 0)), np.cos(np.minimum(high + SLACK, np.pi))
    with np.errstate(invalid="ignore", over="ignore"):
        top = norms[:, None] * np.where(best > 0, large, small) * best
        bottom = norms[:, None] * np.where(worst > 0, small, large) * worst
        top, bottom = top + np.abs(top) * 1e-9 + 0.5, bottom - np.abs(bottom) * 1e-9 - 0.5
    return np.where(np.isnan(bottom), -np.inf, bottom), np.where(np.isnan(top), np.inf, top)


def integer_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of integer-valued rows, exact."""
    if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1] < 2.0 ** 53:
        return (a @ b.T).astype(np.int64)  # every partial sum is a whole number that a double holds
    wide = [[int(x) for x in row] for row in b]
    out = [[sum(int(x) * y for x, y in zip(row, other)) for other in wide] for row in a]
    return np.array(out, dtype=object).astype(np.int64).reshape(len(a), len(b))


def _whole(vectors: np.ndarray) -> np.ndarray:
    """Integer-valued vectors in half the space, where that holds them exactly."""
    return vectors.astype(np.float32) if np.abs(vectors).max(initial=0) < 2 ** 24 else vectors


def _matrix(column: pa.Array, width: int, scale: int) -> np.ndarray:
    lengths = column.value_lengths().to_numpy()
    out = np.zeros((len(column), width))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out[np.arange(width)[None, :] < lengths[:, None]] = np.floor(scale * flat)
    return out


def pick_directions(sample: np.ndarray, count: int) -> np.ndarray:
    """Unit rows of the sample, each as far as possible from those before it."""
    length = np.sqrt(np.einsum("ij,ij->i", sample, sample))
    unit = sample[length > 0] / length[length > 0, None]
    if not len(unit):
        return np.eye(1, sample.shape[1])
    chosen, nearest = [0], unit @ unit[0]
    while len(chosen) < min(count, len(unit)):
        chosen.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, unit @ unit[chosen[-1]])
    return unit[chosen]


class Block:
    """The rows of one block, in chunks of one label."""

    def __init__(self, blob: bytes, width: int):
        self.ids, label, names, ends, vectors, self.norms, angles, self.anchor = blobs.unpack(blob)
        self.labels = [bytes(names[a:b]) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
        self.label = label
        self.vectors = vectors.reshape(len(self.ids), width).astype(np.float64)
        self.angles = angles.reshape(len(self.ids), -1)
        starts = np.flatnonzero(np.diff(label, prepend=-1))
        self.starts = np.array([x for a, b in zip(starts, [*starts[1:], len(label)]) for x in range(a, b, CHUNK)], np.int64)
        self.ends = np.append(self.starts[1:], len(label))
        self.near, self.far = (f.reduceat(self.angles.astype(np.float64), self.starts, axis=0) for f in (np.minimum, np.maximum))
        self.small, self.large = (f.reduceat(self.norms, self.starts) for f in (np.minimum, np.maximum))

    @staticmethod
    def pack(ids, labels: list[bytes], vectors, norms, angles, anchor, cell: int) -> bytes:
        names = sorted(set(labels))
        number = {x: i for i, x in enumerate(names)}
        label = np.array([number[x] for x in labels], np.int32)
        order = np.lexsort((ids, angles[:, cell], label))
        text = np.frombuffer(b"".join(names), np.uint8)
        return blobs.pack(ids[order], label[order], text, np.cumsum([len(x) for x in names]).astype(np.int64),
                          _whole(vectors[order]).ravel(), norms[order], angles[order].ravel(), anchor[order].astype(np.uint8))


def best_rows(owner: np.ndarray, ids: np.ndarray, scores: np.ndarray, most: int) -> np.ndarray:
    """Indices of each owner's first ``most`` rows: higher scores first, then smaller ids."""
    order = np.lexsort((ids, -scores, owner))
    run = np.flatnonzero(np.diff(owner[order], prepend=-1))
    place = np.arange(len(order)) - np.repeat(run, np.diff(np.append(run, len(order))))
    return order[place < most]


def search(block: Block, anchors: dict, same: bool, wanted: list[tuple[np.ndarray, np.ndarray]], most: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each (low, high) of ``wanted`` (a score range per anchor; low > high asks for
    nothing) the anchors' best rows of the block in it: (anchor, id, score)."""
    bottom, top = score_bounds(anchors["angles"], anchors["norms"], block.near, block.far, block.small, block.large)
    numbers = {name: i for i, name in enumerate(block.labels)}
    own = np.array([numbers.get(x, -1) for x in anchors["labels"]])
    fits = (own[:, None] == block.label[block.starts][None, :]) == same
    least = [low.copy() for low, _ in wanted]  # rises to the score of the last row kept
    held = [(np.zeros(0, np.int64),) * 3 for _ in wanted]
    # chunks that may score high come first, so that the bound rises early
    for c in np.argsort(-np.where(fits, top, -np.inf).max(axis=0, initial=-np.inf), kind="stable"):
        a, b = block.starts[c], block.ends[c]
        need = np.zeros(len(own), bool)
        for (_, high), low in zip(wanted, least):
            need |= (low <= high) & (top[:, c] >= low) & ((bottom[:, c] <= high) | (high == ANY))
        sub = np.flatnonzero(need & fits[:, c])
        if not len(sub):
            continue
        scores, ids = integer_scores(anchors["vectors"][sub], block.vectors[a:b]), block.ids[a:b]
        other = anchors["ids"][sub][:, None] != ids[None, :]
        for j, ((_, high), low) in enumerate(zip(wanted, least)):
            i, k = np.nonzero((scores >= low[sub][:, None]) & (scores <= high[sub][:, None]) & other)
            if len(i):
                new = [np.concatenate(x) for x in zip(held[j], (sub[i], ids[k], scores[i, k]))]
                keep = best_rows(*new, most)
                held[j] = tuple(x[keep] for x in new)
                count = np.bincount(held[j][0], minlength=len(own))
                last = np.cumsum(count) - 1
                full = count >= most
                low[full] = np.maximum(low[full], held[j][2][last[full]])
    return held


ANCHOR_ROW = "key long, anchor_id long, label string, vector array<double>, norm double, angles array<float>, low array<long>, high array<long>"


def pack_anchors(at: np.ndarray, it: dict) -> bytes:
    labels = [it["labels"][i] for i in at]
    return blobs.pack(it["keys"][at], it["ids"][at], np.frombuffer(b"".join(labels), np.uint8), np.cumsum([len(x) for x in labels]).astype(np.int64),
                      _whole(it["vectors"][at]).ravel(), it["norms"][at], it["angles"][at].ravel(), it["low"][at].ravel(), it["high"][at].ravel())


def unpack_anchors(blob: bytes, width: int) -> dict:
    keys, ids, text, ends, vectors, norms, angles, low, high = blobs.unpack(blob)
    n = len(keys)
    labels = [bytes(text[a:b]) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
    return {"keys": keys, "ids": ids, "labels": labels, "vectors": vectors.reshape(n, width).astype(np.float64), "norms": norms,
            "angles": angles.reshape(n, -1), "low": low.reshape(n, -1), "high": high.reshape(n, -1)}


def anchor_rows(batch: pa.RecordBatch) -> dict:
    n = len(batch)
    flat = lambda c: batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
    return {"keys": batch.column("key").to_numpy(), "ids": batch.column("anchor_id").to_numpy(), "labels": [x.encode() for x in batch.column("label").to_pylist()],
            "vectors": flat("vector"), "norms": batch.column("norm").to_numpy(), "angles": flat("angles"), "low": flat("low"), "high": flat("high")}


def build_index(rows: DataFrame, geometry: Geometry, scale: int, block: int) -> DataFrame:
    """Packed blocks, written; completes ``geometry`` with what each cell holds."""
    spark = rows.sparkSession

    def located(batch: pa.RecordBatch):
        vectors = _matrix(batch.column("vector"), geometry.width, scale)
        norms, angles = geometry.angles(vectors)
        return vectors, norms, angles, np.argmin(angles, axis=1)

    def counted(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            found, n = np.unique(located(batch)[3], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(n, pa.int64())], ["cell", "n"])

    counts = np.zeros(len(geometry.directions), np.int64)  # one row per direction
    for r in rows.mapInArrow(counted, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        counts[r["cell"]] = r["n"]
    geometry.blocks = -(-counts // block)
    geometry.first_block = np.cumsum(geometry.blocks) - geometry.blocks

    def dealt(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            vectors, norms, angles, cell = located(batch)
            deal = batch.column("deal").to_numpy().astype(np.uint64)
            own = geometry.first_block[cell] + (deal % geometry.blocks[cell].astype(np.uint64)).astype(np.int64)
            ids, labels = batch.column("id").to_numpy(), [x.encode() for x in batch.column("label").to_pylist()]
            anchor = batch.column("anchor").to_numpy(zero_copy_only=False)
            yield from blobs.batches(
                (b, int(cell[at[0]]), Block.pack(ids[at], [labels[i] for i in at], vectors[at], norms[at], angles[at], anchor[at], int(cell[at[0]])))
                for b, at in blobs.slices(own))

    def packed(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def items():
            for number, held, _ in blobs.by_bucket(source):
                parts = [Block(blob, geometry.width) for _, blob in held]
                labels = [p.labels[x] for p in parts for x in p.label.tolist()]
                vectors, norms, angles, anchor, ids = (np.concatenate([getattr(p, f) for p in parts]) for f in ("vectors", "norms", "angles", "anchor", "ids"))
                yield number, held[0][0], Block.pack(ids, labels, vectors, norms, angles, anchor, held[0][0])

        yield from blobs.batches(items())

    ship_package(spark)
    index = written(blobs.dealt(rows.mapInArrow(dealt, blobs.SCHEMA), packed, blobs.SCHEMA), "angular-index")

    def ranges(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for cell, blob in zip(batch.column("kind").to_pylist(), batch.column("blob")):
                b = Block(blob.as_py(), geometry.width)
                lo, hi = [*b.near.min(axis=0), b.small.min()], [*b.far.max(axis=0), b.large.max()]
                yield pa.RecordBatch.from_arrays([pa.array([cell] * len(lo), pa.int32()), pa.array(range(len(lo)), pa.int32()), pa.array(lo), pa.array(hi)], ["cell", "of", "lo", "hi"])

    cells, ways = len(counts), len(counts)
    low, high = np.full((cells, ways + 1), np.inf), np.full((cells, ways + 1), -np.inf)
    found = index.mapInArrow(ranges, "cell int, of int, lo double, hi double").groupBy("cell", "of").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    for r in found.collect():  # one row per cell and direction
        low[r["cell"], r["of"]], high[r["cell"], r["of"]] = r["lo"], r["hi"]
    geometry.near, geometry.far, geometry.small, geometry.large = low[:, :-1], high[:, :-1], low[:, -1], high[:, -1]
    return index


def _sent(anchors: DataFrame, geometry: Geometry) -> DataFrame:
    """Packed anchors, to every block of the cells that may hold what they look for."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def items():
            some = np.flatnonzero(geometry.blocks > 0)
            for batch in source:
                for start in range(0, len(batch), 2048):
                    it = anchor_rows(batch.slice(start, 2048))
                    bottom, top = score_bounds(it["angles"], it["norms"], *(getattr(geometry, f)[some] for f in ("near", "far", "small", "large")))
                    need = np.zeros(top.shape, bool)
                    for low, high in zip(it["low"].T, it["high"].T):
                        need |= (low <= high)[:, None] & (top >= low[:, None]) & ((bottom <= high[:, None]) | (high == ANY)[:, None])
                    for c, cell in enumerate(some.tolist()):
                        at = np.flatnonzero(need[:, c])
                        if len(at):
                            blob = pack_anchors(at, it)
                            for block in range(int(geometry.first_block[cell]), int(geometry.first_block[cell] + geometry.blocks[cell])):
                                yield block, ANCHORS, blob

        yield from blobs.batches(items())

    return anchors.mapInArrow(run, blobs.SCHEMA)


def _found(index: DataFrame, sent: DataFrame, geometry: Geometry, same: bool, most: int) -> DataFrame:
    """Best rows of each block for the anchors sent there: (key, which, id, score)."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held, blobs_of_anchors in blobs.by_bucket(source, ANCHORS):
            block = None
            for blob in blobs_of_anchors:
                block = block or Block(held[0][1], geometry.width)
                it = unpack_anchors(blob, geometry.width)
                for which, (owner, ids, scores) in enumerate(search(block, it, same, list(zip(it["low"].T, it["high"].T)), most)):
                    yield pa.RecordBatch.from_arrays([
                        pa.array(it["keys"][owner]), pa.array(np.full(len(owner), which, np.int32)), pa.array(ids), pa.array(scores)], ["key", "which", "id", "score"])

    rows = index.select("bucket", F.lit(INDEX).alias("kind"), "blob").union(sent)
    return blobs.dealt(rows, run, "key long, which int, id long, score long")


def _first(found: DataFrame, most: int) -> DataFrame:
    """The first ``most`` rows of each (key, which), with their ``rank``; cut down before the exchange."""
    order = Window.partitionBy("key", "which").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def mine_hard_negatives(
    embeddings: DataFrame, anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = 256,
    positives: int = 5, negatives: int = 5, low_percent: int = 80, high_percent: int = 100, directions: int = 16, sample: int = 2048, block: int = 16_384,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)
    of the rows for which ``anchor`` holds.

    A negative's score is at least ``low_percent`` and at most ``high_percent`` of the
    positive's. ``directions`` are picked from ``sample`` rows; ``block`` rows are
    packed together.
    """
    spark = embeddings.sparkSession
    ship_package(spark)
    vector = F.col("vector")
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = embeddings.select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"),
        F.coalesce(anchor, F.lit(False)).alias("anchor"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & vector.isNotNull() & F.forall(vector, number))
    rows = rows.withColumn("deal", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit((1 << 31) - 1)))
    result = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"

    width = rows.agg(F.max(F.size("vector"))).first()[0]
    if width is None:
        return spark.createDataFrame([], result)
    width = max(width, 1)
    # a bounded sample by hash of the id: it only decides how well cells prune
    near = rows.orderBy(F.xxhash64("id"), "id").limit(sample).select("vector").collect()
    drawn = np.zeros((len(near), width))
    for i, r in enumerate(near):
        drawn[i, :len(r["vector"])] = r["vector"]
    peak = np.abs(drawn).max(axis=1, initial=0)
    geometry = Geometry(pick_directions(drawn / np.where(peak > 0, peak, 1)[:, None], directions))
    index = build_index(rows, geometry, scale, block)

    def at_home(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The anchors of each block, with the best scores of their label there as bounds."""
        for batch in source:
            for number, blob in zip(batch.column("bucket").to_pylist(), batch.column("blob")):
                b = Block(blob.as_py(), geometry.width)
                own = np.flatnonzero(b.anchor)
                for at in np.split(own, range(512, len(own), 512)):
                    it = {"keys": (number << 32) | at, "ids": b.ids[at], "labels": [b.labels[x] for x in b.label[at]], "vectors": b.vectors[at],
                          "norms": b.norms[at], "angles": b.angles[at]}
                    low, high = np.full(len(at), NONE), np.full(len(at), ANY)
                    owner, _, scores = search(b, it, True, [(low, high)], positives)[0]
                    count = np.bincount(owner, minlength=len(at))
                    full = count >= positives
                    low[full] = scores[(np.cumsum(count) - 1)[full]]
                    yield pa.RecordBatch.from_pylist([
                        {"key": k, "anchor_id": i, "label": x.decode(), "vector": v, "norm": n, "angles": a, "low": [l], "high": [h]}
                        for k, i, x, v, n, a, l, h in zip(it["keys"].tolist(), it["ids"].tolist(), it["labels"], it["vectors"].tolist(), it["norms"].tolist(),
                                                         it["angles"].tolist(), low.tolist(), high.tolist())], schema=anchor_schema)

    def ranged(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The score ranges of the negatives of each positive; a missing positive has none."""
        for batch in source:
            scores = [x + [-1] * (positives - len(x)) for x in batch.column("scores").to_pylist()]
            share = lambda x, percent, up: percent * (x // 100) + (-(-percent * (x % 100) // 100) if up else percent * (x % 100) // 100)
            low = [[share(x, low_percent, True) if x >= 0 else 1 for x in row] for row in scores]
            high = [[share(x, high_percent, False) if x >= 0 else 0 for x in row] for row in scores]
            columns = [batch.column(c) for c in anchor_schema.names[:-2]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(low, pa.list_(pa.int64())), pa.array(high, pa.list_(pa.int64()))], schema=anchor_schema)

    anchor_schema = pa.schema([("key", pa.int64()), ("anchor_id", pa.int64()), ("label", pa.string()), ("vector", pa.list_(pa.float64())), ("norm", pa.float64()),
                               ("angles", pa.list_(pa.float32())), ("low", pa.list_(pa.int64())), ("high", pa.list_(pa.int64()))])
    anchors = written(index.mapInArrow(at_home, ANCHOR_ROW), "anchors")
    best = _first(_found(index, _sent(anchors, geometry), geometry, True, positives), positives)
    best = written(best.select("key", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), (F.col("rank") - 1).alias("which")), "positives")
    scored = best.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("which", "positive_score"))), lambda x: x["positive_score"]).alias("scores"))
    looking = anchors.join(scored, "key").mapInArrow(ranged, ANCHOR_ROW)
    found = _first(_found(index, _sent(looking, geometry), geometry, False, negatives), negatives)
    out = found.join(best, ["key", "which"]).join(anchors.select("key", "anchor_id"), "key")
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def relabelled(embeddings: DataFrame) -> DataFrame:
    """The contract's table: of every seventh id the label is the next one of ten."""
    return embeddings.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))


def query(spark, sf_dir: str) -> DataFrame:
    """op11: hard negatives of every hundredth vector."""
    return mine_hard_negatives(relabelled(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 100 == 0)


ORACLE = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * CAST(x AS DOUBLE)) for x in embedding] AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)
QUALIFY row_number() OVER w <= 5
"""
