"""op6 and op1: segments, fitting, held-out accuracy, gradients."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from helpers import docs_frame
from pyspark.sql import functions as F

from holdfast.llm.op1_passage_attention import N_FEATURES, WORDS, AttentionModel, encode, fit as fit_quality, query as quality_query, score_quality
from holdfast.llm.op6_toxic_segments import (
    DRIFT, EXPECTED, PRIOR, counts_once, decay_rate, fit as fit_toxicity, log_odds, maximal_segments, query as toxicity_query, remainder, score_toxicity, token_keys)
from holdfast.llm.textblocks import ALPHANUMERIC, NOT_SPACE, pieces


def brute_segments(scores):
    """The best segment, then the same left and right of it (shortest of equals)."""
    best = None
    for a in range(len(scores)):
        for b in range(a + 1, len(scores) + 1):
            s = sum(scores[a:b])
            if s > 0 and (best is None or s > best[2] or (s == best[2] and b - a < best[1] - best[0])):
                best = (a, b, s)
    if best is None:
        return []
    a, b, _ = best
    return brute_segments(scores[:a]) + [best] + [(x + b, y + b, s) for x, y, s in brute_segments(scores[b:])]


def test_maximal_segments():
    r = random.Random(1)
    for _ in range(300):
        # powers of two apart enough that no two sums tie
        scores = [r.choice([-1, 1]) * r.uniform(0.1, 3) for _ in range(r.randint(0, 14))]
        got = maximal_segments(np.array(scores))
        want = brute_segments(scores)
        assert [x[:2] for x in got] == [x[:2] for x in want]
        assert np.allclose([x[2] for x in got], [x[2] for x in want])
    assert maximal_segments(np.array([4, -5, 3, -3, 1, 2, -2, 2, -2, 1, 5.0])) == [(0, 1, 4.0), (2, 3, 3.0), (4, 11, 7.0)]


def test_decay_rate_and_log_odds():
    scores, weights = np.array([1.0, -1.0]), np.array([1.0, 3.0])
    assert decay_rate(scores, weights) == pytest.approx(np.log(3), abs=1e-6)
    assert decay_rate(-np.abs(scores), weights) == 1.0
    counts = np.array([[50, 1000, 2], [40, 100, 1], [1, 900, 1]])
    s = log_odds(counts)
    assert s[0] > 1 and s[1] < 0 and s[2] == pytest.approx(-0.2)


def toxic_texts(n=240):
    r = random.Random(2)
    clean = [f"word{k}" for k in range(300)]
    texts, labels = [], []
    for k in range(n):
        tokens = [r.choice(clean) for _ in range(r.randint(20, 120))]
        bad = k % 4 == 0
        if bad:
            at = r.randint(0, len(tokens))
            tokens[at:at] = [r.choice(["vile", "grotty", "beastly"]) for _ in range(4)]
        texts.append(" ".join(tokens))
        labels.append((k, int(bad)))
    return texts, labels


def test_toxicity_on_planted_passages(spark):
    texts, labels = toxic_texts()
    texts += [None, "", "x " * 100_000, "word1 " * 50 + "VILE, grotty vile! beastly" + " word2" * 50]
    docs = docs_frame(spark, texts)
    marks = spark.createDataFrame([*labels, labels[0], (None, 1), (5000, None)], "doc_id long, toxic int")
    model = fit_toxicity(docs, marks, remainder(5) != 0)
    got = {x.row.doc_id: x for x in score_toxicity(docs, model).collect()}
    assert len(got) == len(texts)
    wrong = [k for k, y in labels if (got[k].score >= 0.5) != bool(y)]
    assert len(wrong) <= 2, wrong
    planted = got[len(texts) - 1]
    assert planted.score >= 0.5 and [(p.start, p.end) for p in planted.passages] == [(50, 54)]
    assert got[240].score < 0.5 and got[241].score == got[240].score and got[240].passages == [] and got[242].score < 0.5
    again = {x.row.doc_id: x.score for x in score_toxicity(docs.repartition(2), fit_toxicity(docs.repartition(5), marks, remainder(5) != 0)).collect()}
    assert again == {k: x.score for k, x in got.items()}


def tokens_of(text: str) -> list[str]:
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", "".join(c.lower() if c < "\x80" else c for c in text))


def keys_of(text: str) -> set[tuple[str, str]]:
    return {("token", t) for t in tokens_of(text)} | {("stem", t[:5]) for t in tokens_of(text)}


def test_counts_and_pieces():
    texts = ["Straße straßenbahn A-a a1", "", "éàüöñç éàüöñx éàüö z", "straßenbahnen " * 9, "日本語日本語 日本語日本人"]
    want = Counter(k for t in texts for k in keys_of(t))
    keys, counts = counts_once([t.encode() for t in texts])
    assert len(keys) == len(want) == len(set(keys.tolist())) and sorted(counts.tolist()) == sorted(want.values())
    alone = {k: int(v) for kind, t in want for v, k in [(token_keys([t.encode()])[kind == "stem"][0], (kind, t))]}
    got = dict(zip(keys.tolist(), counts.tolist()))
    assert {k: got[v] for k, v in alone.items()} == want
    assert counts_once([b"", b" "])[0].size == 0
    for text in (b"", b"abc", b"a" * 50, b"ab cd  efg " * 9, b" " * 40, b"a" * 30 + b" b " + b"c" * 30):
        for size in (1, 7, 16):
            cut = list(pieces(text, NOT_SPACE, size))
            assert b"".join(cut) == text and [w for p in cut for w in p.split()] == text.split()
    assert len(list(pieces(b"ab cd  efg " * 9, ALPHANUMERIC, 16))) > 5


def test_toxicity_against_a_plain_model(spark):
    """Scores of keys and of whole texts by dictionaries and plain sums."""
    texts, labels = toxic_texts(120)
    texts += ["beastlyish vile words", "Ünrühmlichste vile grotty", "word1 " * 400_000 + "vile grotty beastly vile", None]
    docs = docs_frame(spark, texts)
    model = fit_toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), F.lit(True))
    of = lambda wanted: Counter(k for i, y in labels if y == wanted for k in keys_of(texts[i]))
    everything, toxic, clean = Counter(k for t in texts for k in keys_of(t or "")), of(1), of(0)
    weight, plain = PRIOR * toxic.total(), {}
    for k in toxic | clean:
        prior = weight * (everything[k] + 0.5) / (everything.total() + 0.5 * len(everything))
        odds = [math.log((y[k] + prior) / (y.total() + weight - y[k] - prior)) for y in (toxic, clean)]
        delta = odds[0] - odds[1]
        spread = 2 * math.sqrt(1 / (toxic[k] + prior) + 1 / (clean[k] + prior))
        plain[k] = math.copysign(max(abs(delta) - spread, 0), delta) - DRIFT
    by_weight = Counter({plain.get(k, -DRIFT): 0 for k in everything})
    for k, n in everything.items():
        by_weight[plain.get(k, -DRIFT)] += n
    assert sum(n * math.exp(model.decay * s) for s, n in by_weight.items()) == pytest.approx(everything.total())
    for row in score_toxicity(docs, model).collect():
        tokens = tokens_of(row.row.text or "")
        scores = [plain.get(("token", t), -DRIFT) for t in tokens]
        scores = [plain.get(("stem", t[:5]), -DRIFT) if s == -DRIFT else s for t, s in zip(tokens, scores)]
        own = [(a, b, model.decay * s - math.log(model.constant * len(tokens))) for a, b, s in maximal_segments(np.array(scores))]
        own = [x for x in own if x[2] > -math.log(EXPECTED)]
        assert row.n_tokens == len(tokens) and [(p.start, p.end) for p in row.passages] == [x[:2] for x in own]
        score = 1 / (1 + math.exp(-(model.intercept + model.slope * math.log1p(sum(x[2] for x in own)))))
        assert row.score == pytest.approx(score, abs=1e-9)


def test_toxicity_sample_is_bounded(spark):
    texts, labels = toxic_texts(80)
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    docs = docs_frame(spark, texts)
    whole = fit_toxicity(docs, marks, F.lit(True))
    # a labelled text beyond the bound is counted, but not learnt from; repeated rows of an id are one
    long = docs_frame(spark, texts + ["vile " * 300_000] + texts[:40], list(range(81)) + [3] * 40)
    more = spark.createDataFrame([*labels, (80, 0)], "doc_id long, toxic int")
    bounded = fit_toxicity(long, more, F.lit(True), sample_bytes=1_000_000)
    assert len(bounded.keys) and bounded.token_scores([b"vile"])[0][0] > 0 and whole.token_scores([b"vile"])[0][0] > 0
    nothing = fit_toxicity(docs, marks, F.lit(True), sample_bytes=0)
    assert len(nothing.keys) == 0 and nothing.slope == 0


def test_classifiers_without_labels(spark):
    docs = docs_frame(spark, ["a b", None, ""])
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    assert max(x.score for x in score_toxicity(docs, fit_toxicity(docs, none, remainder(5) != 0)).collect()) < 1e-9
    assert {x.score for x in score_quality(docs, fit_quality(docs, none, remainder(3) != 1)).collect()} == {0.5}
    one = spark.createDataFrame([(0, 1, 1), (2, 1, 1)], "doc_id long, toxic int, quality int")
    assert {x.score > 0.99 for x in score_toxicity(docs, fit_toxicity(docs, one, remainder(99) != 98)).collect()} == {True}
    assert {x.score > 0.99 for x in score_quality(docs, fit_quality(docs, one, remainder(99) != 98)).collect()} == {True}
    clash = docs.selectExpr("doc_id", "text", "1 AS score", "2 AS row", "3 AS attention", "4 AS passages")
    model = fit_toxicity(clash, one, remainder(99) != 98)
    assert score_toxicity(clash, model).first().row.passages == 4
    assert score_toxicity(docs.limit(0), model).count() == 0
    quality = fit_quality(clash, none, remainder(3) != 1)
    assert score_quality(clash, quality).first().row.attention == 3 and score_quality(docs.limit(0), quality).count() == 0


def accuracy(rows, labels):
    truth = {x.doc_id: x[1] for x in labels.collect()}
    held = [(x.predicted, truth[x.doc_id]) for x in rows if x.held_out and x.doc_id in truth]
    return sum(p == y for p, y in held) / len(held), len(held)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    right, n = accuracy(quality_query(spark, sf).collect(), labels.select("doc_id", "quality"))
    assert n > 80 and right > 0.95
    right, n = accuracy(toxicity_query(spark, sf).collect(), labels.select("doc_id", "toxic"))
    assert n > 50 and right > 0.93


def test_encoding():
    texts = [b"", b"word " * 100, "É!! Ünd\nx".encode(), b"a" * 5000]
    x, per = encode(texts)
    assert per.tolist() == [1, -(-100 // WORDS), 1, 1] and x.shape == (sum(per), N_FEATURES) and np.isfinite(x).all()
    assert not x[0].any()
    whole = np.concatenate([encode([t])[0] for t in texts])
    assert np.allclose(whole, x)  # a passage does not depend on its neighbours in the block


def test_gradients():
    r = np.random.default_rng(0)
    model, per = AttentionModel(), np.array([1, 4, 2])
    x, y = r.normal(size=(7, N_FEATURES)), np.array([0.0, 1.0, 1.0])

    def loss():
        p = model.forward(x, per)["p"]
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    for name, g in model.gradients(x, per, y).items():
        w = model.weights[name]
        for _ in range(3):
            at = tuple(r.integers(0, n) for n in w.shape)
            keep = w[at]
            w[at] = keep + 1e-5
            up = loss()
            w[at] = keep - 1e-5
            down = loss()
            w[at] = keep
            assert g[at] == pytest.approx((up - down) / 2e-5, abs=1e-6), name


def test_attention_finds_the_passage():
    r = np.random.default_rng(1)
    bags, y = [], []
    for k in range(300):
        bag = r.normal(size=(r.integers(2, 9), N_FEATURES))
        if k % 2:
            bag[r.integers(0, len(bag)), 0] = 6.0
        bags.append(bag)
        y.append(float(k % 2))
    model = AttentionModel()
    model.fit(bags, np.array(y), steps=400)
    p, a = model.score(np.concatenate(bags), np.array([len(b) for b in bags]))
    assert ((p >= 0.5) == np.array(y, bool)).mean() > 0.97
    at, hits = 0, 0
    for bag, label in zip(bags, y):
        hits += label and int(np.argmax(a[at:at + len(bag)]) == np.argmax(bag[:, 0]))
        at += len(bag)
    assert hits > 120


def test_segments_of_many_isolated_positives_take_linear_time():
    import time

    scores = np.where(np.arange(400_000) % 2 == 0, 1.0, -1.1)
    began = time.time()
    assert len(maximal_segments(scores)) == 200_000
    falling = np.where(np.arange(400_000) % 2 == 0, 1.0 + np.arange(400_000) * 1e-7, -1.0)
    assert len(maximal_segments(falling)) >= 1
    assert time.time() - began < 5


def test_samples_take_one_row_of_a_repeated_id(spark):
    """A labelled id that very many rows repeat adds one text to the sample."""
    from holdfast.llm import op1_passage_attention as quality

    texts = ["a good text of words " * 5, "bad bad bad text " * 5]
    docs = spark.createDataFrame([(k % 2, texts[k % 2] + ("" if k < 200 else str(k))) for k in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 1)], "doc_id long, quality int, toxic int")
    seen = []
    real = quality.AttentionModel.fit
    try:
        quality.AttentionModel.fit = lambda self, bags, y: seen.append(len(bags)) or real(self, bags, y)
        quality.fit(docs, labels, F.lit(True))
        quality.fit(docs, labels, F.lit(True), total_bytes=110)
    finally:
        quality.AttentionModel.fit = real
    assert seen == [2]                    # the second sample holds one label only
