"""op5 and op10 against window-by-window brute force."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from helpers import docs_frame, repeats, repetitive_texts, space_words

from holdfast.llm.automaton import SuffixAutomaton
from holdfast.llm.op10_substring_dedup import WordRepeats, remove_reference_passages, remove_repeated_passages
from holdfast.llm.op5_prefix_free_parsing import ByteRepeats, remove_repeated_bytes, suffix_order
from holdfast.llm.blobs import by_bucket, rows
from holdfast.llm.repeats import ROWS, pack_rows, remove_repeats, unpack_rows
from holdfast.llm.textblocks import NOT_SPACE, rolling_hashes, sliding_minimum, span_hashes, word_spans


def spans_of(mask: bytes):
    return [m.span() for m in re.finditer(rb"\x01+", mask)]


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("binary", [False, True])
def test_against_brute_force(spark, seed, binary):
    texts = repetitive_texts(seed)
    r = random.Random(seed)
    ids = r.sample(range(-50, 1000), len(texts))
    ids[5] = ids[4]  # rows that repeat an id, with other texts
    ids[9], texts[9] = ids[8], texts[8]  # a repeated row
    ids[20] = None
    length = 50 if binary else 13
    run = remove_repeated_bytes if binary else remove_repeated_passages
    found = run(docs_frame(spark, texts, ids)).collect()
    parts, masks = repeats(texts, ids, length, (lambda t: t.encode()) if binary else space_words)
    want = sorted((str(i), t or "", len(p), spans_of(m)) for i, t, p, m in zip(ids, texts, parts, masks))
    got = sorted((str(x.row.doc_id), x.row.text or "", x.n_symbols, [(s.start, s.end) for s in x.spans]) for x in found)
    assert got == want
    assert any(w[3] for w in want)
    for x in found:
        removed = {k for s in x.spans for k in range(s.start, s.end)}
        if binary:
            whole = (x.row.text or "").encode()
            assert bytes(x.text) == bytes(c for k, c in enumerate(whole) if k not in removed)
        elif x.row.text is None:
            assert x.text is None
        else:
            words = space_words(x.row.text)
            assert space_words(x.text) == [w for k, w in enumerate(words) if k not in removed]
            if not removed:
                assert x.text == x.row.text


def test_small_flushes_and_repeated_ids(spark):
    """What a task decides alone does not depend on how its rows are packed."""
    texts = repetitive_texts(3, 80)
    r = random.Random(8)
    ids = [r.randint(0, 25) for _ in texts]  # many rows share an id
    for finder, binary in ((WordRepeats(), False), (ByteRepeats(), True)):
        finder.flush, finder.flush_bytes = 40, 2000
        found = remove_repeats(docs_frame(spark, texts, ids, 2), finder, "doc_id", "text", binary).collect()
        parts, masks = repeats(texts, ids, finder.length, (lambda t: t.encode()) if binary else space_words)
        want = sorted((i, t or "", spans_of(m)) for i, t, m in zip(ids, texts, masks))
        assert sorted((x.row.doc_id, x.row.text or "", [(s.start, s.end) for s in x.spans]) for x in found) == want


def test_given_reference(spark):
    """Spans of 13 words or more of a reference, whatever the shards."""
    texts = repetitive_texts(11, 60)
    reference = [t for t in texts[:25] if t]
    grams = {tuple(w[k:k + 13]) for w in map(space_words, reference) for k in range(len(w) - 12)}
    frame = spark.createDataFrame([(t,) for t in reference] + [(None,), ("",)], "text string")
    for shard_words in (100_000, 300):
        for x in remove_reference_passages(docs_frame(spark, texts), frame, shard_words=shard_words).collect():
            words = space_words(x.row.text or "")
            mask = bytearray(len(words))
            for k in range(len(words) - 12):
                if tuple(words[k:k + 13]) in grams:
                    mask[k:k + 13] = b"\1" * 13
            assert [(s.start, s.end) for s in x.spans] == spans_of(bytes(mask)) and x.n_symbols == len(words)
            assert (x.text is None) == (x.row.text is None)
            assert space_words(x.text or "") == [w for w, m in zip(words, mask) if not m]
    assert remove_reference_passages(docs_frame(spark, texts), frame.limit(0)).where("size(spans) > 0").count() == 0


def test_empty_table_and_clashing_columns(spark):
    rows = [(1, "a b", 7, "x", 5), (2, None, 8, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans int, row string, n_symbols int")
    for run in (remove_repeated_passages, remove_repeated_bytes):
        assert run(df.limit(0)).count() == 0
        got = {x.row.doc_id: x for x in run(df).collect()}
        assert got[1].row.spans == 7 and got[1].row.row == "x" and got[1].spans == [] and got[2].row.text is None


def test_one_very_long_text_and_a_hot_passage(spark):
    r = random.Random(5)
    passage = " ".join(f"p{k}" for k in range(40))
    long = " ".join(f"w{r.randint(0, 10**6)}" for _ in range(300_000))
    texts = [long, *(f"{passage} tail{k} x{k}" for k in range(400)), long[: len(long) // 2]]
    got = {x.row.doc_id: x for x in remove_repeated_passages(docs_frame(spark, texts)).collect()}
    assert got[0].spans == [] and got[1].spans == []
    assert all([(s.start, s.end) for s in got[k].spans] == [(0, 40)] for k in range(2, 401))
    n = len(texts[-1].split())
    assert got[401].n_symbols == n and sum(s.end - s.start for s in got[401].spans) in (n, n - 1)


def test_automaton_accepts_exactly_the_substrings():
    r = random.Random(0)
    for _ in range(60):
        texts = ["".join(r.choice("abc") for _ in range(r.randint(0, 14))) for _ in range(r.randint(1, 4))]
        automaton = SuffixAutomaton()
        for t in texts:
            states = automaton.add(t)
            assert [automaton.length[v] for v in states] == list(range(1, len(t) + 1))
        every = {t[a:b] for t in texts for a in range(len(t)) for b in range(a + 1, len(t) + 1)}
        probe = "".join(r.choice("abcd") for _ in range(40))
        for at, (_, size) in enumerate(automaton.match(probe), 1):
            assert size == max([k for k in range(at + 1) if k == 0 or probe[at - k:at] in every])


def test_text_helpers():
    data = np.frombuffer("  größe a\tb a \n".encode(), np.uint8)
    s, e = word_spans(data, NOT_SPACE)
    assert [data[a:b].tobytes().decode() for a, b in zip(s, e)] == ["größe", "a", "b", "a"]
    h = span_hashes(data, s, e)
    assert h[1] == h[3] and len(set(h.tolist())) == 3
    text = np.frombuffer(b"abcabcabd" * 3, np.uint8)
    rolled = rolling_hashes(text, 4)
    assert (rolled[0] == rolled[3]) == (text[0:4].tobytes() == text[3:7].tobytes())
    assert len({(text[k:k + 4].tobytes()) for k in range(24)}) == len(set(rolled.tolist()))
    values = np.random.default_rng(0).integers(0, 1000, 200).astype(np.uint64)
    for width in (1, 2, 9, 27):
        assert sliding_minimum(values, width).tolist() == [values[k:k + width].min() for k in range(201 - width)]


def test_suffix_order_to_depth():
    r = np.random.default_rng(3)
    data = r.integers(0, 3, 400).astype(np.uint8)
    starts = np.arange(350)
    order, same = suffix_order(data, starts, 50)
    strings = [data[k:k + 50].tobytes() for k in order]
    assert strings == sorted(strings)
    assert same.tolist() == [False, *(a == b for a, b in zip(strings, strings[1:]))]


def test_equal_windows_have_equal_triggers():
    r = random.Random(1)
    shared = " ".join(r.choice("abcdef") * r.randint(1, 4) for _ in range(30))
    for finder, length in ((WordRepeats(), 13), (ByteRepeats(), 50)):
        keys = {}
        for _ in range(5):
            text = " ".join(str(r.random()) for _ in range(20)) + " " + shared + " " + str(r.random())
            seg = finder.segments([text.encode()])
            for a, n, lo, key in zip(seg.start, seg.windows, seg.lo, seg.key):
                if finder.length == 50:
                    for k in range(n):
                        keys.setdefault(text.encode()[a + k:a + k + length], set()).add(int(key))
                else:
                    words = space_words(text)
                    for k in range(n):
                        keys.setdefault(tuple(words[a + k:a + k + length]), set()).add(int(key))
        assert all(len(v) == 1 for v in keys.values())


@pytest.mark.parametrize("binary", [False, True])
def test_a_trigger_with_many_contents_is_not_one_group(spark, binary):
    """A phrase in every text, between other words: compared by window, with the same results."""
    r = random.Random(21)
    phrase = " ".join(f"p{k}" for k in range(16))
    ends = [" ".join(f"e{r.randint(0, 3)}" for _ in range(6)) for _ in range(40)]
    texts = repetitive_texts(22, 40) + [f"{r.choice(ends)} {phrase} {r.choice(ends)}" for _ in range(150)]
    ids = r.sample(range(1000), len(texts))
    ids[60] = ids[61]
    parts, masks = repeats(texts, ids, 50 if binary else 13, (lambda t: t.encode()) if binary else space_words)
    want = sorted((i, t or "", spans_of(m)) for i, t, m in zip(ids, texts, masks))
    for flush_bytes in (32 << 20, 2000):  # found wide in a task; found wide in the bucket
        class Finder(ByteRepeats if binary else WordRepeats):
            widest = 8

            def matched(self, buffer, lo, hi, group, first):
                assert np.bincount(group).max() <= self.widest
                return super().matched(buffer, lo, hi, group, first)

        finder = Finder()
        finder.flush_bytes = flush_bytes
        found = remove_repeats(docs_frame(spark, texts, ids, 2), finder, "doc_id", "text", binary).collect()
        assert sorted((x.row.doc_id, x.row.text or "", [(s.start, s.end) for s in x.spans]) for x in found) == want


def test_rows_without_an_id_and_of_one_id_spread():
    """A third of all rows with a null id and a third with one id are not one bucket."""
    ids = [None, 7, 3] * 400
    texts = [f"text {k}" if k % 2 else "same" for k in range(1200)]
    for k in range(1200):
        ids[k] = k if ids[k] == 3 else ids[k]
    batch = pa.record_batch({"doc_id": pa.array(ids, pa.int64()), "text": texts})
    for all_rows in (True, False):
        found, most = [], 0
        for out in pack_rows("doc_id", "text", 101, all_rows)(iter([batch])):
            for bucket, kind, blob in zip(*(c.to_pylist() for c in out.columns)):
                mine = [r for b in unpack_rows(blob) for r in b.to_pylist()]
                assert kind == ROWS
                found += mine
                most = max(most, sum(r["doc_id"] is None for r in mine), sum(r["doc_id"] == 7 and r["text"] != "same" for r in mine))
        want = [(i, t) for i, t in zip(ids, texts) if all_rows or i is not None]
        assert sorted(map(str, ((r["doc_id"], r["text"]) for r in found))) == sorted(map(str, want))
        assert most <= 20


def test_packed_rows_of_a_bucket_are_not_held():
    drawn = []

    def source():
        for k in range(5):
            drawn.append(k)
            yield rows([(1, 0, b"small"), (1, ROWS, b"0")] if k == 0 else [(1, ROWS, b"%d" % k)])

    for bucket, held, rest in by_bucket(source(), ROWS):
        assert (bucket, held, drawn) == (1, [(0, b"small")], [0])
        assert list(rest) == [b"%d" % k for k in range(5)]


@pytest.mark.parametrize("binary", [False, True])
def test_many_rows_of_one_id_and_none(spark, binary):
    texts = repetitive_texts(31, 150)
    ids = [None if k % 3 == 0 else 40 if k % 3 == 1 else k for k in range(len(texts))]
    texts += [texts[7]] * 30  # one row many times
    ids += [40] * 30
    run = remove_repeated_bytes if binary else remove_repeated_passages
    found = run(docs_frame(spark, texts, ids)).collect()
    _, masks = repeats(texts, ids, 50 if binary else 13, (lambda t: t.encode()) if binary else space_words)
    want = sorted((str(i), t or "", spans_of(m)) for i, t, m in zip(ids, texts, masks))
    assert sorted((str(x.row.doc_id), x.row.text or "", [(s.start, s.end) for s in x.spans]) for x in found) == want


def test_contents_with_one_hash_are_compared_by_their_bytes(spark, monkeypatch):
    """A hash that tells nothing apart changes no result."""
    from holdfast.llm import repeats as module

    one, other = b"a", b"b"
    for _ in range(10):
        one, other = one + other, other + one
    texts = [" ".join([one.decode()] * 13), " ".join([other.decode()] * 13), " ".join([one.decode()] * 14)]
    got = {r["row"]["doc_id"]: len(r["spans"]) for r in remove_repeated_passages(docs_frame(spark, texts)).collect()}
    assert got == {0: 0, 1: 0, 2: 1}
    order = np.arange(4)
    data = np.frombuffer(b"abcabcabdabc", np.uint8)
    same = module.other_content(np.zeros(4, np.uint64), np.zeros(4, np.uint64), data, np.arange(0, 12, 3), np.full(4, 3), order)
    assert same.tolist() == [True, False, True, True]


def test_hashes_of_long_spans_and_comparison_in_parts():
    from holdfast.llm.textblocks import same_bytes

    r = np.random.default_rng(2)
    data = r.integers(0, 2, 5000).astype(np.uint8)
    data[2500:] = data[:2500]
    size = r.integers(0, 200, 300)
    a = r.integers(0, 2300, 300)
    h, g = span_hashes(data, a, a + size), span_hashes(data, a + 2500, a + 2500 + size)
    assert (h == g).all() and len(set(h.tolist())) == len({data[x:x + n].tobytes() for x, n in zip(a, size)})
    b = np.where(r.random(300) < 0.5, a + 2500, r.integers(0, 2300, 300))
    want = [data[x:x + n].tobytes() == data[y:y + n].tobytes() for x, y, n in zip(a, b, size)]
    for most in (1, 100, 1 << 20):
        assert same_bytes(data, a, data, b, size, most).tolist() == want
