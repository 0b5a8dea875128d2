"""Hard-negative mining against brute force."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from holdfast.llm import op11_angular_negatives as op


def brute(rows, positives=5, negatives=5, low=80, high=100, scale=256):
    good = [(i, l, [math.floor(scale * x) for x in v]) for i, l, v in rows
            if i is not None and l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, l, v in good:
        if i % 100:
            continue
        scored = sorted(((-sum(a * b for a, b in zip(v, w)), j, m) for j, m, w in good if j != i))
        same = [(j, -s) for s, j, m in scored if m == l][:positives]
        for j, p in same:
            window = [(k, -s) for s, k, m in scored if m != l and low * p <= -100 * s <= high * p][:negatives]
            out += [(i, j, r, k, p, s) for r, (k, s) in enumerate(window, 1)]
    return sorted(out)


def vectors(seed, n=1500, width=12):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(12, width))
    found = centres[r.integers(0, 12, n)] + r.normal(size=(n, width)) * r.choice([0.02, 0.3, 1.0], (n, 1))
    return [(i, int(r.integers(0, 4)), [float(x) for x in v]) for i, v in enumerate(found)]


def frame(spark, rows, partitions=4):
    return spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(partitions)


def mined(df, **options):
    return sorted(map(tuple, op.mine_hard_negatives(df, F.col("vec_id") % 100 == 0, **options).collect()))


@pytest.mark.parametrize("options", [{}, {"block": 60, "directions": 5, "sample": 100}, {"block": 17, "directions": 1}])
def test_equals_brute_force(spark, options):
    rows = vectors(1)
    rows += [(2000, 1, None), (2100, None, rows[0][2]), (2200, 1, [0.0] * 12), (2300, 2, []), (2400, 2, rows[5][2][:7]), (2500, 1, [float("nan")] + [0.0] * 11),
             (2600, 1, [float("inf")] + [0.0] * 11), (None, 1, rows[3][2]), (2700, 3, [None] + [1.0] * 11)]
    rows += [(5000 + k, k % 3, rows[7][2]) for k in range(400)]       # a very common vector: all scores tie
    rows += [rows[10], rows[100], rows[100]]                          # repeated rows, also of an anchor
    assert mined(frame(spark, rows), **options) == brute(rows)


def test_other_windows_and_counts(spark):
    rows = vectors(2, 700, 5)
    got = mined(frame(spark, rows, 3), positives=2, negatives=3, low_percent=50, high_percent=90, scale=64, block=100)
    assert got == brute(rows, 2, 3, 50, 90, 64)


def test_tables_without_rows_or_anchors(spark):
    assert mined(frame(spark, [])) == []
    assert mined(frame(spark, [(1, 1, [1.0]), (2, 1, [2.0])])) == []
    assert mined(frame(spark, [(100, 1, None)])) == []
    assert mined(frame(spark, [(100, 1, [1.0])])) == []


def test_large_components_are_scored_exactly(spark):
    big = float(1 << 22)
    rows = [(100, 1, [big, 1.0]), (1, 1, [big, 3.0]), (2, 1, [big, 2.0]), (3, 2, [big, 2.5]), (4, 2, [big, 1.0]), (5, 2, [big - 1, 0.0])]
    got = mined(frame(spark, rows))
    assert got == brute(rows) and len(got) == 5 and got[0][4] > 1 << 53
    with pytest.raises(Exception, match="OverflowError"):
        mined(frame(spark, [(100, 1, [1e18]), (1, 1, [1e18])]))


def test_other_columns_and_their_names_do_not_matter(spark):
    rows = vectors(3, 300, 4)
    df = frame(spark, rows).withColumns({c: F.lit(1) for c in ("id", "key", "which", "vector", "anchor", "deal", "score", "rank")})
    assert mined(df) == brute(rows)


def test_score_bounds_hold():
    r = np.random.default_rng(5)
    rows = np.floor(r.normal(size=(400, 9)) * r.choice([1, 100, 5000], (400, 1)))
    rows[7] = 0
    geometry = op.Geometry(op.pick_directions(r.normal(size=(50, 9)), 6))
    norms, angles = geometry.angles(rows)
    wide = angles.astype(np.float64)
    bottom, top = op.score_bounds(angles, norms, wide, wide, norms, norms)
    scores = op.integer_scores(rows, rows)
    assert (bottom <= scores).all() and (scores <= top).all()
    groups = [slice(k, k + 20) for k in range(0, 400, 20)]
    near, far = (np.array([f(wide[g], axis=0) for g in groups]) for f in (np.min, np.max))
    small, large = (np.array([f(norms[g]) for g in groups]) for f in (np.min, np.max))
    bottom, top = op.score_bounds(angles, norms, near, far, small, large)
    for c, g in enumerate(groups):
        assert (bottom[:, c] <= scores[:, g].min(axis=1)).all() and (scores[:, g].max(axis=1) <= top[:, c]).all()


def test_chunks_out_of_reach_are_not_scored(monkeypatch):
    """Clustered rows: most chunks are left out by their bounds."""
    r = np.random.default_rng(6)
    centres = np.eye(8) * 1000
    rows = np.floor(np.repeat(centres, 512, axis=0) + r.normal(size=(4096, 8)) * 20)
    geometry = op.Geometry(op.pick_directions(rows[::64], 8))
    norms, angles = geometry.angles(rows)
    block = op.Block(op.Block.pack(np.arange(4096), [b"1"] * 4096, rows, norms, angles, np.zeros(4096, bool), 0), 8)
    seen = []
    real = op.integer_scores
    monkeypatch.setattr(op, "integer_scores", lambda a, b: seen.append(len(a) * len(b)) or real(a, b))
    anchors = {"ids": np.array([-1]), "labels": [b"1"], "vectors": rows[:1], "norms": norms[:1], "angles": angles[:1]}
    (owner, ids, scores), = op.search(block, anchors, True, [(np.array([op.NONE]), np.array([op.ANY]))], 5)
    want = sorted(((-int(s), i) for i, s in enumerate((rows @ rows[0]).astype(np.int64))))[:5]
    assert sorted(zip((-scores).tolist(), ids.tolist())) == want
    assert sum(seen) < 4096 / 3
