"""Toxicity by maximum-scoring segments.

1. Every token (lower-cased letters, digits and non-ASCII characters) and its
   stem (the first five characters) has a key, a 64-bit hash. Keys are counted over
   all documents and over the toxic and the clean documents of a labelled sample,
   once per document, so that no single text dominates. The counts are a table with
   one row per different key, so they grow with the corpus.
2. The score of a key is its log-odds between toxic and clean text under a
   Dirichlet prior proportional to the counts of all documents, shrunk towards
   zero by two standard deviations, minus a small drift. Keys that the sample lacks,
   and those that do not stand out, have the drift alone. A token about which
   nothing is known takes the score of its stem.
3. In each text one linear scan finds all maximal-scoring segments: no segment
   can be extended or joined to score more. Only positive tokens are visited;
   the sums between them come from prefix sums.
4. Segment scores follow an extreme-value law: lambda solves E[exp(lambda s)] = 1
   over the corpus's token scores, K is fitted on the best segments of clean
   sample texts. Segments under an expected-number threshold are significant.
5. The evidence of a text is the sum over its significant segments of
   lambda * S - ln(K * n); a logistic curve fitted on the sample gives the score.

The labelled sample is bounded by ``sample`` rows and ``sample_bytes`` bytes of text
(documented parameters): one row of each id, in the order of the id's hash, texts that
would pass the bound left out. The model holds the keys of the sample that stand out,
so its size is bounded by the sample; counts cover all documents. A long text is
handled in pieces of about a megabyte, and only its scores are held whole.

Defined results: null and empty texts have no segment and the score of a text
without evidence; without a toxic or without a clean labelled document every
score is the share of toxic ones in the sample (0 without any); null labels are
ignored; rows that repeat an id are scored each; a label that repeats counts
once; an empty table gives an empty result; extra columns are carried in ``row``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from holdfast.llm.common import passing, ship_package, table, written
from holdfast.llm.textblocks import ALPHANUMERIC, LOWER, U64, binary_column, blocks, joined, mix, pieces, span_hashes, word_spans, words_per_text

STEM = 5  # characters
STEM_MARK = 0x5354454D
HELD = 1 << 20  # counts a task holds before it passes them on
SIEVE_BITS = 20  # of the bitmap that sets aside tokens the model lacks
PRIOR = 3.0  # weight of the prior, in times the toxic counts
DRIFT = 0.2
EXPECTED = 0.1  # expected number of chance segments under which one is significant


def stem_ends(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where the first five characters of each token end."""
    if (buffer < 0x80).all():
        return np.minimum(ends, starts + STEM)
    first = np.flatnonzero((buffer & 0xC0) != 0x80)
    return np.minimum(ends, np.append(first, [len(buffer)] * STEM)[np.searchsorted(first, starts) + STEM])


def token_keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of every token and of its stem, and tokens per text."""
    buffer, starts = joined(texts)
    s, e = word_spans(buffer, ALPHANUMERIC)
    buffer = LOWER[buffer]
    stems = span_hashes(buffer, s, stem_ends(buffer, s, e)) ^ U64(STEM_MARK)
    return span_hashes(buffer, s, e), mix(stems), words_per_text(starts, s)


def counts_once(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Different keys of some texts and the number of texts that hold each."""
    tokens, stems, per = token_keys(texts)
    known, at, number = np.unique(tokens, return_index=True, return_inverse=True)
    stem_known, stem_number = np.unique(stems[at], return_inverse=True)
    n, m = max(1, len(known)), max(1, len(stem_known))
    text, number = np.divmod(np.unique(np.repeat(np.arange(len(texts)), per) * n + number), n)
    stem_number = np.unique(text * m + stem_number[number]) % m
    return (np.concatenate((known, stem_known)),
            np.concatenate((np.bincount(number, minlength=len(known)), np.bincount(stem_number, minlength=len(stem_known)))))


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    different, number = np.unique(np.concatenate(keys), return_inverse=True)
    return different, np.bincount(number, weights=np.concatenate(counts), minlength=len(different)).astype(np.int64)


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score) of one text, in order.

    Candidates are kept on a stack with the cumulative score left and right of
    each; a new positive token joins back to the nearest candidate that starts
    lower, if that candidate's own end does not already stand higher.
    """
    positive = np.flatnonzero(scores > 0)
    if not len(positive):
        return []
    sums = np.concatenate(([0.0], np.cumsum(scores)))
    # start, end, sum before, sum after, place of the nearest candidate that starts lower
    stack: list[tuple[int, int, float, float, int]] = []
    for at, left, right in zip(positive.tolist(), sums[positive].tolist(), sums[positive + 1].tolist()):
        start, k = at, len(stack) - 1
        while True:
            # candidates passed by start no lower, so no later search needs them
            while k >= 0 and stack[k][2] >= left:
                k = stack[k][4]
            if k < 0 or stack[k][3] >= right:
                stack.append((start, at + 1, left, right, k))
                break
            start, _, left, _, before = stack[k]
            del stack[k:]
            k = before
    return [(start, end, right - left) for start, end, left, right, _ in stack]


@dataclass
class SegmentModel:
    keys: np.ndarray  # in order; all other keys have the score -DRIFT
    scores: np.ndarray  # per key
    decay: float  # lambda
    constant: float = 1.0  # K
    slope: float = 0.0
    intercept: float = 0.0

    def __post_init__(self):
        self.seen = np.zeros(1 << SIEVE_BITS, bool)
        self.seen[self.keys >> U64(64 - SIEVE_BITS)] = True

    def key_scores(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -DRIFT)
        maybe = np.flatnonzero(self.seen[keys >> U64(64 - SIEVE_BITS)])
        at = np.searchsorted(self.keys, keys[maybe])
        inside = at < len(self.keys)
        maybe, at = maybe[inside], at[inside]
        found = self.keys[at] == keys[maybe]
        out[maybe[found]] = self.scores[at[found]]
        return out

    def token_scores(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Score of every token, and tokens per text."""
        if len(texts) == 1:  # perhaps a very long one
            scores = np.concatenate([self._piece_scores([piece])[0] for piece in pieces(texts[0], ALPHANUMERIC)])
            return scores, np.array([len(scores)])
        return self._piece_scores(texts)

    def _piece_scores(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        tokens, stems, per = token_keys(texts)
        scores = self.key_scores(tokens)
        unknown = np.flatnonzero(scores == -DRIFT)
        scores[unknown] = self.key_scores(stems[unknown])
        return scores, per

    def evidence(self, segments: list[tuple[int, int, float]], tokens: int) -> tuple[float, list[tuple[int, int, float]]]:
        """Evidence of a text and its significant segments with their own evidence."""
        found = []
        for start, end, score in segments:
            own = self.decay * score - np.log(self.constant * tokens)
            if own > -np.log(EXPECTED):
                found.append((start, end, float(own)))
        return sum(x[2] for x in found), found

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.intercept + self.slope * np.log1p(evidence), -30, 30)))


def log_odds(counts: np.ndarray, totals: np.ndarray | None = None, distinct: int = 0) -> np.ndarray:
    """Shrunk log-odds of each key from (all, toxic, clean) counts; ``totals`` over all
    keys and their number, where ``counts`` are those of some keys only."""
    everything, toxic, clean = counts.astype(np.float64)
    all_sum, toxic_sum, clean_sum = (counts.sum(axis=1) if totals is None else totals).astype(np.float64)
    weight = PRIOR * toxic_sum
    prior = weight * (everything + 0.5) / (all_sum + 0.5 * (distinct or len(everything)))
    odds = lambda y, total: np.log((y + prior) / (total + weight - y - prior))
    delta = odds(toxic, toxic_sum) - odds(clean, clean_sum)
    spread = 2 * np.sqrt(1 / (toxic + prior) + 1 / (clean + prior))
    return np.sign(delta) * np.maximum(np.abs(delta) - spread, 0) - DRIFT


def decay_rate(scores: np.ndarray, weights: np.ndarray) -> float:
    """The positive root of E[exp(lambda s)] = 1 over the token scores."""
    if not (scores > 0).any() or (scores * weights).sum() >= 0:
        return 1.0
    p = weights / weights.sum()
    low, high = 1e-6, 1.0
    excess = lambda x: float((p * np.expm1(np.minimum(x * scores, 700))).sum())
    while excess(high) < 0 and high < 1e3:
        low, high = high, high * 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if excess(middle) < 0 else (low, middle)
    return high


def logistic_fit(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(slope, intercept) by Newton steps with a little ridge."""
    design, beta = np.column_stack((x, np.ones(len(x)))), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (y - p) - 1e-3 * beta
        hessian = (design * (p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


def _count(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, key, n) from (text, kind): in how many texts of the kind a key occurs, summed
    over a part of the task's texts that is bounded by the number of different keys."""
    held: dict[int, tuple[list[np.ndarray], list[np.ndarray]]] = {}
    size = 0

    def passed_on(least: int) -> Iterator[pa.RecordBatch]:
        nonlocal size
        size = 0
        for kind in list(held):
            keys, counts = summed(*held[kind])
            if len(keys) < least:
                held[kind] = [keys], [counts]
                size += len(keys)
                continue
            del held[kind]
            for lo in range(0, len(keys), 1 << 17):
                some = keys[lo:lo + (1 << 17)].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), kind, np.int32)), pa.array(some), pa.array(counts[lo:lo + (1 << 17)])], ["kind", "key", "n"])

    for batch in source:
        kinds = batch.column(1).to_numpy()
        for kind in np.unique(kinds).tolist():
            texts = [t or b"" for t in binary_column(batch.column(0)).filter(pa.array(kinds == kind)).to_pylist()]
            for lo, hi in blocks(texts):
                if hi - lo > 1:
                    keys, counts = counts_once(texts[lo:hi])
                else:  # perhaps a very long one: all its keys, once
                    keys = np.unique(np.concatenate([counts_once([piece])[0] for piece in pieces(texts[lo], ALPHANUMERIC)]))
                    counts = np.ones(len(keys), np.int64)
                own = held.setdefault(kind, ([], []))
                own[0].append(keys)
                own[1].append(counts)
                size += len(keys)
                if size > HELD:
                    yield from passed_on(HELD // 8)
    yield from passed_on(0)


def labelled_sample(labels: DataFrame, id_col: str, label_col: str, train: Column, sample: int) -> DataFrame:
    """At most ``sample`` labelled rows that may be learned from, by hash of the id."""
    known = labels.where(train & F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    return known.groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("int").alias("__label")).orderBy(F.xxhash64("__id"), "__id").limit(sample)


def bounded_sample(docs: DataFrame, chosen: DataFrame, id_col: str, text_col: str, sample_bytes: int) -> DataFrame:
    """(``id``, ``label``, ``text``): one row of each chosen id, within the bytes."""
    texts = docs.select(F.col(id_col).cast("long").alias("__of"), F.col(text_col).alias("text"))
    once = texts.join(F.broadcast(chosen), F.col("__of") == F.col("__id")).groupBy("__id").agg(
        F.max("__label").alias("label"), F.min_by("text", F.struct(F.xxhash64("text"), F.length("text"))).alias("text"))
    once = written(once.withColumnRenamed("__id", "id"), "sample")
    # at most as many rows as ids were chosen
    sizes = once.select("id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")).orderBy(F.xxhash64("id"), "id").collect()
    left, inside = sample_bytes, []
    for row in sizes:
        if row["size"] <= left:
            left -= row["size"]
            inside.append((row["id"],))
    return once if len(inside) == len(sizes) else once.join(F.broadcast(docs.sparkSession.createDataFrame(inside, "id long")), "id", "left_semi")


def fit(docs: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        sample: int = 20_000, sample_bytes: int = 256 << 20) -> SegmentModel:
    """Learns the token scores from all texts and the labels of the sample."""
    spark = docs.sparkSession
    ship_package(spark)
    # at most ``sample`` ids and labels: the bound that allows the broadcast
    chosen = spark.createDataFrame(labelled_sample(labels, id_col, label_col, train, sample).collect(), "__id long, __label int")
    with passing(spark, keep=0):
        learned = bounded_sample(docs, chosen, id_col, text_col, sample_bytes)
        marked = learned.where("label IN (0, 1)").select("text", F.when(F.col("label") == 1, 1).otherwise(2).alias("kind"))
        parts = docs.select(F.col(text_col).alias("text"), F.lit(0).alias("kind")).union(marked).mapInArrow(_count, "kind int, key long, n long")
        of_kind = [F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(name) for k, name in enumerate(("everything", "toxic", "clean"))]
        counts = written(parts.groupBy("key").agg(*of_kind), "token-counts")
        whole = counts.agg(F.sum("everything"), F.sum("toxic"), F.sum("clean"), F.count("*")).first()
        totals, distinct = np.array([x or 0 for x in whole[:3]], np.int64), whole[3]
        if not totals[1] or not totals[2]:
            labelled = [r["__label"] for r in chosen.collect()]
            share = float(np.mean(labelled)) if labelled else 0.0
            model = SegmentModel(np.zeros(0, U64), np.zeros(0), 1.0)
            model.intercept = float(np.clip(np.log(max(share, 1e-13) / max(1 - share, 1e-13)), -30, 30))
            return model
        # the keys of the sample, whose text is bounded
        sampled = counts.where((F.col("toxic") > 0) | (F.col("clean") > 0)).toArrow()
        keys = sampled.column("key").to_numpy().view(U64)
        order = np.argsort(keys)
        own = np.stack([sampled.column(c).to_numpy()[order] for c in ("everything", "toxic", "clean")])
        keys, scores = keys[order], log_odds(own, totals, distinct)
        decay = decay_rate(np.append(scores, -DRIFT), np.append(own[0], totals[0] - own[0].sum()))
        known = scores != -DRIFT
        model = SegmentModel(keys[known], scores[known], decay)

        # the sample's texts again: the best segments of clean ones give K, all of them the curve
        best = _scan(learned.select(F.struct("text", "label", "id").alias("row")), "text", model, significant=False)
        rows = best.select(F.col("row.label").alias("y"), "row.id", "n_tokens", F.transform("passages", lambda p: p["evidence"]).alias("scores")).collect()
    rows.sort(key=lambda r: r["id"])  # the same order on every run
    extremes = [model.decay * max(r["scores"]) - np.log(r["n_tokens"]) for r in rows if r["y"] == 0 and r["scores"]]
    if extremes:
        model.constant = float(np.exp(np.mean(extremes) - np.euler_gamma))
    x = np.array([model.evidence([(0, 0, s) for s in r["scores"]], max(1, r["n_tokens"]))[0] for r in rows])
    model.slope, model.intercept = logistic_fit(np.log1p(x), np.array([r["y"] for r in rows], float))
    return model


def _scan(rows: DataFrame, text_col: str, model: SegmentModel, significant: bool = True) -> DataFrame:
    """Segments of every text; their own evidence, or the plain score if not ``significant``."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    passage = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("evidence", pa.float64())])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in source:
            row = batch.column("row")
            texts = [t or b"" for t in binary_column(row.field(text_col)).to_pylist()]
            counts, evidence, passages = [], np.zeros(len(texts)), []
            for lo, hi in blocks(texts):
                scores, per = model.token_scores(texts[lo:hi])
                counts.append(per)
                ends = np.cumsum(per)
                for text, a, b in zip(range(lo, hi), (ends - per).tolist(), ends.tolist()):
                    found = maximal_segments(scores[a:b])
                    if significant:
                        evidence[text], found = model.evidence(found, max(1, b - a))
                    passages.append([{"start": s, "end": e, "evidence": v} for s, e, v in found])
            yield pa.RecordBatch.from_arrays([
                row, pa.array(np.concatenate(counts) if counts else [], pa.int64()), pa.array(passages, pa.list_(passage)),
                pa.array(model.probability(evidence)),
            ], ["row", "n_tokens", "passages", "score"])

    schema = T.StructType([
        rows.schema["row"], T.StructField("n_tokens", T.LongType()),
        T.StructField("passages", T.ArrayType(T.StructType([
            T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("evidence", T.DoubleType())]))),
        T.StructField("score", T.DoubleType()),
    ])
    return rows.mapInArrow(run, schema)


def score_toxicity(docs: DataFrame, model: SegmentModel, text_col: str = "text") -> DataFrame:
    """``row`` (the input columns as they were), ``n_tokens``, the significant
    ``passages`` (token ranges with their evidence) and ``score`` of every text."""
    ship_package(docs.sparkSession)
    return _scan(docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row")), text_col, model)


def remainder(divisor: int, id_col: str = "doc_id") -> Column:
    """crc32 of the id's text modulo ``divisor``; decides what is held out."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(divisor))


def query(spark, sf_dir: str) -> DataFrame:
    """op6: toxicity score of each document."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), remainder(5) != 0)
    return score_toxicity(docs, model).select(
        F.col("row.doc_id").alias("doc_id"), (remainder(5, "row.doc_id") == 0).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))
