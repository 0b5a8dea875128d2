"""Quality classifier by attention-based multiple-instance learning.

A text is a bag of passages of ``WORDS`` words. Each passage is encoded by its
own statistics (byte classes, the classes of first and last bytes of words, word
lengths, novelty and repetition of words, line breaks), then by a learned layer.
A gated attention weighs the passages (tanh branch times sigmoid branch, soft-max
over the text), and the weighted mean of the encodings gives the score. Only
texts have labels; which passages matter is learned.

The network has about a thousand parameters. It is fitted with Adam on a sample
of at most ``sample`` labelled texts of at most ``sample_bytes`` bytes each, the
documented bound of what the driver gathers (passage statistics, not texts);
every whole text is scored.

Defined results: null and empty texts are one empty passage; without labels, or
with one class only, every score is the share of ones in the sample (0.5 without
any); a label that repeats counts once; rows that repeat an id are scored each;
an empty table gives an empty result; extra columns are carried in ``row``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from holdfast.llm.common import ship_package, table
from holdfast.llm.op6_toxic_segments import labelled_sample, remainder
from holdfast.llm.textblocks import NOT_SPACE, U64, binary_column, blocks, joined, ragged, span_hashes, word_spans, words_per_text

WORDS = 48
# byte classes: other, lower, upper, digit, stops, exclamation, table marks, symbols, quotes and brackets, non-ASCII, line feed
CLASSES = np.zeros(256, np.int64)
for _class, _bytes in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:", b"!?", b"|/\\", b"#$%&*@^~+=<>_", b"\"'()[]{}`-"), 1):
    CLASSES[np.frombuffer(_bytes, np.uint8)] = _class
CLASSES[0x80:] = 9
CLASSES[0x0A] = 10
N_CLASSES = 11
N_FEATURES = 3 * N_CLASSES + 7
HIDDEN, GATES = 16, 8


def encode(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Passage statistics of a block of texts, and passages per text (at least one)."""
    buffer, text_starts = joined(texts)
    s, e = word_spans(buffer, NOT_SPACE)
    per = words_per_text(text_starts, s)
    passages = np.maximum(1, -(-per // WORDS))
    total = int(passages.sum())
    text = np.repeat(np.arange(len(texts)), per)
    at = np.arange(len(s)) - (np.cumsum(per) - per)[text]
    passage = (np.cumsum(passages) - passages)[text] + at // WORDS
    words = np.bincount(passage, minlength=total)
    out = np.zeros((total, N_FEATURES))
    if not len(s):
        return out, passages
    share = lambda mask: np.bincount(passage[mask], minlength=total) / np.maximum(words, 1)

    # bytes from a passage's first word to the end of its last
    first = np.flatnonzero(np.concatenate(([True], passage[1:] != passage[:-1])))
    size = e[np.append(first[1:], len(s)) - 1] - s[first]
    classes = CLASSES[buffer]
    counts = np.bincount(np.repeat(passage[first] * N_CLASSES, size) + classes[ragged(s[first], size)], minlength=total * N_CLASSES).reshape(total, N_CLASSES)
    out[:, :N_CLASSES] = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
    for k, edge in enumerate((s, e - 1), 1):
        counts = np.bincount(passage * N_CLASSES + classes[edge], minlength=total * N_CLASSES).reshape(total, N_CLASSES)
        out[:, k * N_CLASSES:(k + 1) * N_CLASSES] = counts / np.maximum(words[:, None], 1)

    length = (e - s).astype(float)
    mean = np.bincount(passage, length, total) / np.maximum(words, 1)
    spread = np.bincount(passage, length * length, total) / np.maximum(words, 1) - mean * mean
    hashes = span_hashes(buffer, s, e)
    _, seen = np.unique((hashes >> U64(24)) | (text.astype(U64) << U64(40)), return_index=True)
    new = np.zeros(len(s), bool)
    new[seen] = True
    again = [np.concatenate((np.zeros(min(k, len(s)), bool), (hashes[k:] == hashes[:-k]) & (text[k:] == text[:-k]))) for k in (1, 2)]
    out[:, 3 * N_CLASSES:] = np.column_stack((
        np.log1p(words), np.log1p(mean), np.sqrt(np.maximum(spread, 0)) / (1 + mean), share(new), share(again[0]), share(again[1]), share(length > 14)))
    return out, passages


class AttentionModel:
    """Encoder, gated attention and classifier; numpy only."""

    def __init__(self, seed: int = 11):
        r = np.random.default_rng(seed)
        init = lambda *shape: r.normal(0, 1 / np.sqrt(shape[0]), shape)
        self.weights = {
            "encoder": init(N_FEATURES, HIDDEN), "encoder0": np.zeros(HIDDEN), "tanh": init(HIDDEN, GATES), "tanh0": np.zeros(GATES),
            "gate": init(HIDDEN, GATES), "gate0": np.zeros(GATES), "attention": init(GATES), "out": init(HIDDEN), "out0": np.zeros(1)}
        self.mean, self.scale = np.zeros(N_FEATURES), np.ones(N_FEATURES)

    def forward(self, x: np.ndarray, per: np.ndarray) -> dict[str, np.ndarray]:
        w = self.weights
        starts = np.cumsum(per) - per
        h = np.tanh(x @ w["encoder"] + w["encoder0"])
        t = np.tanh(h @ w["tanh"] + w["tanh0"])
        g = 1 / (1 + np.exp(-(h @ w["gate"] + w["gate0"])))
        s = (t * g) @ w["attention"]
        a = np.exp(s - np.repeat(np.maximum.reduceat(s, starts), per))
        a /= np.repeat(np.add.reduceat(a, starts), per)
        z = np.add.reduceat(a[:, None] * h, starts)
        return {"h": h, "t": t, "g": g, "a": a, "z": z, "p": 1 / (1 + np.exp(-np.clip(z @ w["out"] + w["out0"], -30, 30)))}

    def gradients(self, x: np.ndarray, per: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        w, f = self.weights, self.forward(x, per)
        h, t, g, a = f["h"], f["t"], f["g"], f["a"]
        starts = np.cumsum(per) - per
        error = (f["p"] - y) / len(y)
        dz = np.repeat(error[:, None] * w["out"], per, axis=0)
        da = (h * dz).sum(axis=1)
        ds = a * (da - np.repeat(np.add.reduceat(a * da, starts), per))
        dt = ds[:, None] * w["attention"] * g * (1 - t * t)
        dg = ds[:, None] * w["attention"] * t * g * (1 - g)
        dh = (a[:, None] * dz + dt @ w["tanh"].T + dg @ w["gate"].T) * (1 - h * h)
        return {"encoder": x.T @ dh, "encoder0": dh.sum(axis=0), "tanh": h.T @ dt, "tanh0": dt.sum(axis=0), "gate": h.T @ dg, "gate0": dg.sum(axis=0),
                "attention": (t * g).T @ ds, "out": f["z"].T @ error, "out0": error.sum(keepdims=True)}

    def fit(self, bags: list[np.ndarray], y: np.ndarray, steps: int = 1500, batch: int = 128, rate: float = 0.01, decay: float = 1e-4) -> None:
        """Adam over random batches of bags."""
        stacked = np.concatenate(bags)
        self.mean, self.scale = stacked.mean(axis=0), stacked.std(axis=0) + 1e-6
        bags = [(b - self.mean) / self.scale for b in bags]
        r = np.random.default_rng(5)
        moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in self.weights.items()}
        for step in range(1, steps + 1):
            pick = r.choice(len(bags), min(batch, len(bags)), replace=False)
            gradients = self.gradients(np.concatenate([bags[i] for i in pick]), np.array([len(bags[i]) for i in pick]), y[pick])
            now = rate * (1 + np.cos(np.pi * step / steps)) / 2
            for k, g in gradients.items():
                m = moments[k]
                g = g + decay * self.weights[k]
                m[0] = 0.9 * m[0] + 0.1 * g
                m[1] = 0.999 * m[1] + 0.001 * g * g
                self.weights[k] = self.weights[k] - now * (m[0] / (1 - 0.9 ** step)) / (np.sqrt(m[1] / (1 - 0.999 ** step)) + 1e-8)

    def score(self, x: np.ndarray, per: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score of each text and attention of each passage."""
        f = self.forward((x - self.mean) / self.scale, per)
        return f["p"], f["a"]


def fit(
    docs: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    sample: int = 4000, sample_bytes: int = 1 << 20, total_bytes: int = 256 << 20,
) -> AttentionModel:
    """Learns from one text of each of at most ``sample`` labelled ids, each of at
    most ``sample_bytes`` and all of at most ``total_bytes``, by hash of the id."""
    spark = docs.sparkSession
    ship_package(spark)
    # at most ``sample`` ids and labels: the bound that allows the broadcast
    chosen = spark.createDataFrame(labelled_sample(labels, id_col, label_col, train, sample).collect(), "__id long, __label int")

    def passages(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            texts = [t or b"" for t in binary_column(batch.column(0)).to_pylist()]
            out = []
            for lo, hi in blocks(texts):
                x, per = encode(texts[lo:hi])
                out += [part.astype(np.float32).tobytes() for part in np.split(x, np.cumsum(per)[:-1])]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), batch.column(1), batch.column(2)], ["bag", "label", "id"])

    texts = docs.select(F.col(id_col).cast("long").alias("__of"), F.col(text_col).alias("text")).join(F.broadcast(chosen), F.col("__of") == F.col("__id"))
    texts = texts.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= sample_bytes)
    # one of the rows that repeat an id; then the first ids whose texts fit together
    texts = texts.groupBy("__id").agg(F.max("__label").alias("__label"), F.min_by("text", F.xxhash64("text")).alias("text"))
    sizes = texts.select("__id", F.xxhash64("__id").alias("place"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")).collect()
    sizes.sort(key=lambda r: (r["place"], r["__id"]))
    if sum(r["size"] for r in sizes) > total_bytes:
        fitting = [r["__id"] for r, upto in zip(sizes, accumulate(r["size"] for r in sizes)) if upto <= total_bytes]
        texts = texts.join(F.broadcast(spark.createDataFrame([(i,) for i in fitting], "__id long")), "__id")
    rows = texts.select("text", "__label", "__id").mapInArrow(passages, "bag binary, label int, id long").collect()
    rows.sort(key=lambda r: (r["id"], r["bag"]))  # the same order on every run
    y = np.array([r["label"] for r in rows], float)
    model = AttentionModel()
    if len(set(y)) < 2:
        share = float(y.mean()) if len(y) else 0.5
        model.weights["out"][:] = 0
        model.weights["out0"][:] = np.clip(np.log(max(share, 1e-13) / max(1 - share, 1e-13)), -30, 30)
        return model
    model.fit([np.frombuffer(r["bag"], np.float32).reshape(-1, N_FEATURES).astype(float) for r in rows], y)
    return model


def score_quality(docs: DataFrame, model: AttentionModel, text_col: str = "text") -> DataFrame:
    """``row`` (the input columns as they were), ``score`` and ``attention`` (the
    weight of each passage) of every text."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in source:
            row = batch.column("row")
            texts = [t or b"" for t in binary_column(row.field(text_col)).to_pylist()]
            scores, weights, counts = [], [], []
            for lo, hi in blocks(texts):
                x, per = encode(texts[lo:hi])
                p, a = model.score(x, per)
                scores.append(p)
                weights.append(a)
                counts.append(per)
            join = lambda parts: np.concatenate(parts) if parts else np.zeros(0)
            offsets = np.concatenate(([0], np.cumsum(join(counts)))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                row, pa.array(join(scores), pa.float64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(join(weights), pa.float64()))], ["row", "score", "attention"])

    schema = T.StructType([
        T.StructField("row", T.StructType(docs.schema.fields)), T.StructField("score", T.DoubleType()), T.StructField("attention", T.ArrayType(T.DoubleType()))])
    return docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row")).mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op1: quality score of each document."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), remainder(3) != 1)
    return score_quality(docs, model).select(
        F.col("row.doc_id").alias("doc_id"), (remainder(3, "row.doc_id") == 1).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("attention").alias("n_passages"))
