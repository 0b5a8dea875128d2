"""op7 and op4: fingerprints, links and components against brute force."""

from __future__ import annotations

import math
import random

import numpy as np
import xxhash
from helpers import components as brute_components, docs_frame

from holdfast.llm.components import components
from holdfast.llm.op4_cross_polytope import cells, hadamard, near_duplicates as near_vectors
from holdfast.llm.op7_simhash import fingerprint, grown_links, keep_one, linked_in_groups, near_duplicates, near_links, probe_plan, segments_for


def slow_fingerprint(text: str, shingle: int = 4) -> int:
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).encode()
    words = lowered.split()
    shingles = [b" ".join(words[k:k + shingle]) for k in range(max(1, len(words) - shingle + 1))] if words else []
    counts = [sum(xxhash.xxh64_intdigest(s, 42) >> bit & 1 for s in shingles) for bit in range(64)]
    return sum(1 << bit for bit in range(64) if 2 * counts[bit] > len(shingles))


def test_fingerprints():
    for text in ("", " \n", "One", "one two THREE", "a b c d", "a  b\tc d É é", "x " * 70_000, "w " + "y z " * 30):
        assert fingerprint(text.encode()) == slow_fingerprint(text)
        if len(text) < 1000:
            for shingle in (1, 2, 4, 9):  # pieces of a few bytes: shingles across them
                assert {fingerprint(text.encode(), shingle, size) for size in (1, 5, 40)} == {slow_fingerprint(text, shingle)}


def test_number_of_parts(spark):
    assert (segments_for(0), segments_for(1 << 26), segments_for((1 << 26) + 1), segments_for(10**10)) == (3, 3, 2, 2)
    texts = [" ".join(f"g{k // 6}w{n}" for n in range(120) if n % 40 != k % 6) for k in range(60)]
    df = docs_frame(spark, texts)
    two, three = (sorted(map(tuple, near_duplicates(df, segments=n).collect())) for n in (2, 3))
    assert two == three and 1 < len({x[2] for x in two}) < 60


def clustered(seed: int, centres: int, each: int) -> list[int]:
    r = random.Random(seed)
    out = set()
    for _ in range(centres):
        centre = r.getrandbits(64)
        for _ in range(each):
            value = centre
            for bit in r.sample(range(64), r.randint(0, 5)):
                value ^= 1 << bit
            out.add(value)
    return sorted(out)


def test_every_link_within_the_bits_is_found(spark):
    values = [0, 2**64 - 1, 1 << 63, *clustered(1, 30, 25), *clustered(2, 1, 300)]
    values = sorted(set(values))
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    frame = spark.createDataFrame([(v,) for v in signed], "fingerprint long")
    links = [(a, b) for k, a in enumerate(values) for b in values[k + 1:] if (a ^ b).bit_count() <= 4]
    want = brute_components(values, links)
    for segments, cell in ((3, 50_000), (2, 50_000), (4, 20), (5, 50_000)):
        found = [(x.a % 2**64, x.b % 2**64) for x in near_links(frame, 4, segments, cell).collect()]
        assert brute_components(values, found) == want, segments
    assert len(set(want.values())) < len(values)


def test_probe_plan_covers_the_radius():
    for segments in range(1, 9):
        for bits in range(0, 9):
            plan = probe_plan(segments, bits)
            assert sum(radius + 1 for _, _, radius in plan) == bits + 1  # pigeonhole
            assert all(0 <= a and a + n <= 64 for a, n, _ in plan)


def test_dense_groups_give_few_links():
    values = np.array(clustered(3, 2, 400), np.uint64)
    a, b = grown_links(values, 4)
    assert len(a) < len(values)
    group = np.repeat([0, 1, 2], [len(values), 1, 3])
    more = np.concatenate((values, values[:1], values[:3]))
    a, b = linked_in_groups(group, more, 4)
    assert len(a) <= len(more) + 3
    assert linked_in_groups(group[:0], more[:0], 4)[0].size == 0


def test_components_of_paths_stars_and_random_graphs(spark):
    r = random.Random(4)
    edges = [(k, k + 1) for k in range(100, 160)] + [(500, 501 + k) for k in range(300)] + [(900, 900)]
    edges += [(r.randint(1000, 1400), r.randint(1000, 1400)) for _ in range(250)] + [(1, -5), (-5, 1)]
    nodes = {n for e in edges for n in e if e[0] != e[1]}
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == brute_components(nodes, [e for e in edges if e[0] != e[1]])
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_documents_in_groups(spark):
    base = " ".join(f"w{k}" for k in range(400))
    near = base.replace("w7 ", "changed ")
    texts = ["other words entirely here", near, base, base, None, "", " ", near.upper(), "short", "short"]
    ids = [10, 7, 3, 3, 20, 21, 22, 5, 31, 30]
    df = docs_frame(spark, texts, ids)
    want = {10: 10, 7: 3, 3: 3, 20: 20, 21: 20, 22: 20, 5: 3, 31: 30, 30: 30}
    got = near_duplicates(df).collect()
    assert len(got) == len(texts)
    assert {x.id: x.component for x in got} == want
    assert {x.id: x.fingerprint % 2**64 for x in got}[10] == slow_fingerprint(texts[0])
    kept = keep_one(df).collect()
    assert sorted(x.doc_id for x in kept) == [3, 10, 20, 30]
    unnamed = docs_frame(spark, [base, base, None], [1, None, None])
    assert sorted(str(x.doc_id) for x in keep_one(unnamed).collect()) == ["1", "None", "None"]
    assert near_duplicates(df.limit(0)).count() == 0 and keep_one(df.limit(0)).columns == df.columns


def test_hadamard_is_a_rotation():
    x = np.random.default_rng(0).normal(size=(5, 16))
    y = hadamard(x)
    assert np.allclose((x * x).sum(axis=1), (y * y).sum(axis=1))
    assert np.allclose(hadamard(y), x)
    assert cells(x[:, :5], 3, 2, 4, 1).shape == (5, 3, 5)


def test_recall_at_the_threshold(spark):
    """Pairs just above the cosine of 0.93, the hardest to meet."""
    r = np.random.default_rng(2)
    rows, k = [], 0
    for _ in range(150):
        a = r.normal(size=64)
        a /= np.linalg.norm(a)
        n = r.normal(size=64)
        n -= (n @ a) * a
        n /= np.linalg.norm(n)
        c = r.uniform(0.931, 0.95)
        for v in (a, 3.0 * (c * a + math.sqrt(1 - c * c) * n)):
            rows.append((k, [float(x) for x in v], int(k // 2 % 3)))
            k += 1
    got = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sum(x.n_links for x in got) >= 0.98 * 300


def test_vectors_against_brute_force(spark):
    r = np.random.default_rng(3)
    rows = []
    for centre in range(6):
        c = r.normal(size=8)
        for k in range(12):
            rows.append((len(rows) * 3 % 101, [float(x) for x in np.float32(c + r.normal(size=8) * 0.12)], centre % 2))
    rows += [(300, rows[0][1], rows[0][2]), (301, rows[0][1], 1 - rows[0][2]), (301, rows[0][1], 1 - rows[0][2])]
    odd = [(400, None, 1), (401, [0.0] * 8, 1), (402, [float("nan")] * 8, 1), (403, [1.0, None] * 4, 1), (404, rows[0][1], None),
           (405, [float("inf")] * 8, 1), (406, [], 1), (407, [1.0] * 5, 1)]
    keyed = [(k, *row) for k, row in enumerate(rows)]
    links = []
    for k, _, a, p in keyed:
        for j, _, b, q in keyed:
            if k < j and p == q:
                x, y = np.array(a), np.array(b)
                if x @ y / math.sqrt((x @ x) * (y @ y)) >= 0.93:
                    links.append((k, j))
    root = brute_components(range(len(rows)), links)
    least = {}
    for k, i, _, _ in keyed:
        least[root[k]] = min(least.get(root[k], i), i)
    degree = [sum(k in e for e in links) for k in range(len(rows))]
    want = sorted((i, degree[k], least[root[k]]) for k, i, _, _ in keyed) + [(i, 0, i) for i, _, _ in odd]
    df = spark.createDataFrame([(*x, 1, 2) for x in rows + odd], "vec_id long, embedding array<double>, label int, id int, component int")
    assert sorted((x.id, x.n_links, x.component) for x in near_vectors(df).collect()) == sorted(want)
    assert near_vectors(df.limit(0)).count() == 0


def test_one_row_of_each_group_whatever_the_order(spark):
    """Repeated ids with other texts, equal rows, null ids: decided by row."""
    import random
    from collections import defaultdict

    from pyspark.sql import functions as F

    base = {c: " ".join(f"{c}{k}" for k in range(300)) for c in "ABCD"}
    rows = [(3, base["B"]), (5, base["A"]), (5, base["B"]), (5, base["C"]), (9, base["C"]), (4, base["D"]), (4, base["D"]), (4, base["D"].replace("D7 ", "other ")),
            (None, base["A"]), (None, base["A"]), (8, None), (8, ""), (8, "")]
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        df = docs_frame(spark, [t for _, t in rows], [i for i, _ in rows], 1 + seed).withColumns({c: F.lit(c) for c in ("__kept", "row", "of_id", "stays")})
        marked = [(x.id, x.fingerprint) for x in near_duplicates(df).collect()]
        prints = sorted({f for _, f in marked})
        group = brute_components(prints, [(f, g) for f in prints for g in prints if f < g and bin((f ^ g) % 2**64).count("1") <= 4])
        members = defaultdict(set)
        for i, f in marked:
            if i is not None:
                members[group[f]].add(i)
        kept = keep_one(df)
        assert kept.columns == df.columns
        got = kept.collect()
        found = [(x.doc_id, slow_fingerprint(x.text or "")) for x in got if x.doc_id is not None]
        as_signed = lambda f: f - 2**64 if f >= 2**63 else f
        assert sorted((group[as_signed(f)], i) for i, f in found) == sorted((g, min(ids)) for g, ids in members.items())
        assert sum(x.doc_id is None for x in got) == 2 and {x["__kept"] for x in got} == {"__kept"}
        texts = sorted((str(x.doc_id), str(x.text)) for x in got)
        assert seed == 0 or texts == first
        first = texts


def test_links_do_not_depend_on_magnitude(spark):
    from holdfast.llm.op4_cross_polytope import near_duplicates as near_vectors

    r = np.random.default_rng(3)
    a, rows = r.normal(size=32), []
    for k, scale in enumerate((1e160, 1e-170, 1e300, 1.0)):
        rows += [(2 * k, k, (a * scale).tolist()), (2 * k + 1, k, ((a + 0.01 * r.normal(size=32)) * scale).tolist())]
    rows += [(20, 9, (a * 1e-160).tolist()), (21, 9, (a * 1e150).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    assert [x.n_links for x in near_vectors(df).collect()] == [1] * 10
