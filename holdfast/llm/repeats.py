"""Exact repeated-passage removal, shared by the byte and the word operator.

A *window* is L consecutive symbols of one text. A window is removed from a
text when the same window also starts in a text with a smaller id. All windows
whose least rolling hash (over short grams) is equal are routed together: the
run of such windows in a text is a *segment*, and the least hash its trigger.
Equal windows have equal triggers, whatever surrounds them.

Map stages over shuffles of packed arrays and the texts:

1. ``triggers``: every segment's trigger goes to a bucket; a trigger met in one
   text only cannot hold a repeated window and is dropped.
2. ``contexts``: the texts meet their surviving segments again; each distinct
   segment content goes once per task, with its occurrences, to its trigger.
3. ``resolve``: contents that share a trigger are compared exactly (by the
   operator's own structure) and windows that an earlier text holds are marked.
   A trigger with more than ``widest`` distinct contents, in a task or in all, is
   *wide*: each of its windows becomes a content of its own, whose trigger is the
   hash of the whole window, and a second ``resolve`` compares these in the same way.
4. ``apply``: the texts meet their marked spans and are cut.

What one task can decide alone is decided there, before any shuffle: a trigger
that two of its texts hold is shared, and a content that an earlier text of the
task holds is a repeat. One or two occurrences per task speak for the others, so a
passage or a text that a third of all rows hold sends a few rows per task to its
bucket, not one per copy. Decided occurrences travel to their texts beside
the open ones. No step gathers a text collection, a group of copies is handled
once per distinct content, and memory in a task is bounded by a bucket, whose number
follows the size of the texts and the shuffle partitions. Rows are dealt by id and a
few bits of their text, so rows that repeat an id spread too, and are read one packed
row at a time; rows without an id have no spans and go anywhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, types as T

from holdfast.llm import blobs
from holdfast.llm.common import ship_package
from holdfast.llm.textblocks import U64, binary_column, blocks, mix, ragged, same_bytes, span_hashes

# kinds of packed rows: still to be compared; decided and on the way to its text; single
# windows of wide triggers, still to be compared; triggers found wide; whole rows
OPEN, SETTLED, SPLIT, WIDE, ROWS = 0, 1, 2, 3, 4

@dataclass
class Segments:
    """Segments of a block of texts, ascending by text and position."""

    text: np.ndarray  # index of the text in the block
    start: np.ndarray  # first window, in symbols of the text
    windows: np.ndarray  # number of windows
    key: np.ndarray  # trigger
    buffer: np.ndarray  # bytes in which the contents lie
    lo: np.ndarray  # content of each segment: buffer[lo:hi]
    hi: np.ndarray


def window_runs(least: np.ndarray, starts: np.ndarray, counts: np.ndarray, length: int):
    """(text, first window, windows, trigger) of each run of equal least hashes inside a text."""
    n = len(least)
    if not n:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, least
    edge = np.zeros(n + 1, np.int8)
    has = counts >= length
    edge[starts[has]] += 1
    edge[starts[has] + counts[has] - length + 1] -= 1
    valid = np.cumsum(edge, dtype=np.int8)[:n].astype(bool)
    joined = valid[1:] & valid[:-1] & (least[1:] == least[:-1])
    first, last = valid.copy(), valid.copy()
    first[1:] &= ~joined
    last[:-1] &= ~joined
    a, b = np.flatnonzero(first), np.flatnonzero(last)
    text = np.searchsorted(starts, a, "right") - 1
    return text, a - starts[text], b - a + 1, mix(least[a])


class RepeatFinder:
    """What an operator supplies: how texts divide into symbols and how contents are compared."""

    length: int
    flush = 4_000_000  # segments packed at a time
    flush_bytes = 32 << 20  # content bytes packed at a time
    widest = 256  # distinct contents of a trigger that are compared as one group

    def segments(self, texts: list[bytes]) -> Segments:
        raise NotImplementedError

    def windows_of(self, buffer: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Windows in each content."""
        raise NotImplementedError

    def window_bounds(self, buffer: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each window of each content starts and ends; the contents fill the buffer."""
        raise NotImplementedError

    def matched(self, buffer: np.ndarray, lo: np.ndarray, hi: np.ndarray, group: np.ndarray, first: np.ndarray) -> np.ndarray:
        """For every window of every content: is it also in a content of the same
        group with a smaller ``first``? Contents ascend by (group, first)."""
        raise NotImplementedError

    def cut(self, texts: list[bytes], runs: list[np.ndarray | None]) -> tuple[list[bytes], np.ndarray]:
        """Texts without the runs (k x 2 arrays of symbol ranges), and symbols per text."""
        raise NotImplementedError


def text_mark(text: bytes) -> int:
    """32 bits of a text: tells rows with the same id apart."""
    return xxhash.xxh32_intdigest(text)


def _ids_texts(batch: pa.RecordBatch, id_col: str, text_col: str):
    ids = batch.column(id_col)
    known = ids.is_valid().to_numpy(zero_copy_only=False)
    ids = ids.fill_null(0).cast(pa.int64()).to_numpy()
    texts = [t or b"" for t in binary_column(batch.column(text_col)).to_pylist()]
    return ids, known, texts


def text_marks(texts: list[bytes]) -> np.ndarray:
    return np.fromiter(map(text_mark, texts), np.uint32, len(texts))


def pack_rows(id_col: str, text_col: str, buckets: int, all_rows: bool):
    """Rows to the bucket of their id and text, as compressed Arrow messages. Rows with
    a null id are dealt out by their number, or left out."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def items():
            options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=5))
            for batch in source:
                ids, known, texts = _ids_texts(batch, id_col, text_col)
                marks = text_marks(texts)
                own = blobs.id_bucket(ids, marks, buckets)
                null = np.flatnonzero(~known)
                own[null] = (null + int(marks[:1].sum())) % buckets
                rows = np.arange(len(ids)) if all_rows else np.flatnonzero(known)
                for bucket, at in blobs.slices(own[rows]):
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, batch.schema, options=options) as writer:
                        writer.write_batch(batch.take(pa.array(rows[at])))
                    yield bucket, ROWS, sink.getvalue().to_pybytes()

        yield from blobs.batches(items())

    return run


def unpack_rows(blob: bytes) -> Iterator[pa.RecordBatch]:
    with pa.ipc.open_stream(blob) as reader:
        yield from reader


def surviving(ids: np.ndarray, salts: np.ndarray, ordinals: np.ndarray, buckets: int, kind: int):
    """Rows that tell the texts which of their segments survive."""
    for bucket, i in blobs.slices(blobs.id_bucket(ids, salts, buckets)):
        i = i[np.lexsort((ordinals[i], ids[i]))]
        i = i[changed(ids[i], ordinals[i])]
        yield bucket, kind, blobs.pack(np.diff(ids[i], prepend=0), ordinals[i].astype(np.uint32))


def covered(ids: np.ndarray, marks: np.ndarray, start: np.ndarray, symbols: np.ndarray, buckets: int, kind: int):
    """Rows that tell the texts which of their symbols are repeated."""
    for bucket, i in blobs.slices(blobs.id_bucket(ids, marks, buckets)):
        i = i[np.lexsort((start[i], marks[i], ids[i]))]
        i = i[changed(ids[i], marks[i], start[i], symbols[i])]
        run = np.flatnonzero(changed(ids[i], marks[i]))
        count = np.diff(np.append(run, len(i)))
        step = np.diff(start[i].astype(np.int64), prepend=0)
        step[run] = start[i][run]
        yield bucket, kind, blobs.pack(
            np.diff(ids[i][run], prepend=0), marks[i][run], count.astype(np.uint32), step.astype(np.uint32), symbols[i].astype(np.uint32), level=3)


def changed(*columns: np.ndarray) -> np.ndarray:
    """Is the row another one than its predecessor?"""
    new = np.ones(len(columns[0]), bool)
    new[1:] = False
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def trigger_map(finder: RepeatFinder, id_col: str, text_col: str, buckets: int):
    def flush(keys, ids, salts, ordinals):
        key, doc, salt, at = np.concatenate(keys), np.concatenate(ids), np.concatenate(salts), np.concatenate(ordinals)
        order = np.argsort(key, kind="stable")
        new = changed(key[order], doc[order], salt[order], at[order])
        if not new.all():  # copies of one row say the same
            order = np.sort(order[new])
            key, doc, salt, at = key[order], doc[order], salt[order], at[order]
            order = np.argsort(key, kind="stable")
        edges = np.concatenate(([0], np.flatnonzero(np.diff(key[order])) + 1))
        shared = np.minimum.reduceat(doc[order], edges) != np.maximum.reduceat(doc[order], edges)
        # met in two texts here: known to be shared, and two occurrences speak for all
        known = order[np.repeat(shared, np.diff(np.append(edges, len(key))))]
        yield from surviving(doc[known], salt[known], at[known], buckets, SETTLED)
        rest = np.ones(len(key), bool)
        rest[known] = False
        known = known[np.lexsort((doc[known], key[known]))]
        last = np.append(np.diff(key[known]) != 0, True)[:len(known)]
        rest[known[last]] = True
        rest[known[np.roll(last, 1)]] = True
        rest = np.flatnonzero(rest)
        key, doc, salt, at = key[rest], doc[rest], salt[rest], at[rest]
        for bucket, i in blobs.slices(((key & U64(0xFFFFFF)) % U64(buckets)).astype(np.int32)):
            d, o = doc[i], at[i]
            new = changed(d, salt[i])
            new[1:] |= o[1:] <= o[:-1]
            run = np.flatnonzero(new)
            step = np.diff(o, prepend=o[:1] * 0)
            step[run] = o[run]
            yield bucket, OPEN, blobs.pack(d[run], np.diff(np.append(run, len(d))).astype(np.uint32), step.astype(np.uint32), blobs.short_key(key[i]), salt[i][run])

    def run(source):
        def items():
            keys, docs, salts, ordinals, held = [], [], [], [], 0
            for batch in source:
                ids, known, texts = _ids_texts(batch, id_col, text_col)
                salt = blobs.salt(text_marks(texts))
                for lo, hi in blocks(texts):
                    seg = finder.segments(texts[lo:hi])
                    keep = known[lo:hi][seg.text]
                    ordinal = np.arange(len(seg.text)) - np.searchsorted(seg.text, seg.text)
                    keys.append(seg.key[keep])
                    docs.append(ids[lo:hi][seg.text[keep]])
                    salts.append(salt[lo:hi][seg.text[keep]])
                    ordinals.append(ordinal[keep])
                    held += len(keys[-1])
                    if held >= finder.flush:
                        yield from flush(keys, docs, salts, ordinals)
                        keys, docs, salts, ordinals, held = [], [], [], [], 0
            if held:
                yield from flush(keys, docs, salts, ordinals)

        yield from blobs.batches(items())

    return run


def trigger_reduce(buckets: int):
    """Occurrences of the triggers that two or more ids hold, to the bucket of their id."""

    def run(source):
        def items():
            for bucket, held, _ in blobs.by_bucket(source):
                yield from ((bucket, kind, b) for kind, b in held if kind == SETTLED)
                parts = [blobs.unpack(b) for kind, b in held if kind == OPEN]
                if not parts:
                    continue
                ids = np.concatenate([np.repeat(p[0], p[1]) for p in parts])
                salt = np.concatenate([np.repeat(p[4], p[1]) for p in parts])
                key = blobs.long_key(np.concatenate([p[3] for p in parts]))
                ordinal = np.concatenate([_undelta(p[1], p[2]) for p in parts])
                order = np.argsort(key)
                k, d = key[order], ids[order]
                starts = np.concatenate(([0], np.flatnonzero(k[1:] != k[:-1]) + 1))
                shared = np.minimum.reduceat(d, starts) != np.maximum.reduceat(d, starts)
                keep = order[np.repeat(shared, np.diff(np.append(starts, len(k))))]
                yield from surviving(ids[keep], salt[keep], ordinal[keep], buckets, SETTLED)

        yield from blobs.batches(items())

    return run


def _undelta(counts: np.ndarray, steps: np.ndarray) -> np.ndarray:
    total = np.cumsum(steps.astype(np.int64))
    first = np.cumsum(counts.astype(np.int64)) - counts
    return total - np.repeat(total[first] - steps[first], counts)


def other_content(key, content, data, at, size, order) -> np.ndarray:
    """Is the content another one than its predecessor in ``order``? Contents of one
    trigger and one hash are compared byte by byte. (Two of them may alternate: a
    content then is met twice, as any two contents that share windows.)"""
    new = changed(key[order], content[order], size[order])
    same = np.flatnonzero(~new)
    a, b = order[same - 1], order[same]
    new[same] = ~same_bytes(data, at[a], data, at[b], size[b])
    return new


def send_contents(finder: RepeatFinder, held, buckets: int, kind: int):
    """Each distinct content once, with the occurrences of its first text here, to the
    bucket of its trigger. Contents of wide triggers go on as single windows."""
    key, doc, mark, start, windows, size, data = held
    at = np.cumsum(size) - size
    content = span_hashes(data, at, at + size)
    settled, spread = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for bucket, i in blobs.slices((key % U64(buckets)).astype(np.int32)):
        i = i[np.lexsort((content[i], key[i]))]
        i = i[changed(content[i], key[i], doc[i], mark[i], start[i])]
        new = np.flatnonzero(other_content(key, content, data, at, size, i))
        one, count = i[new], np.diff(np.append(new, len(i)))
        # the first text that holds a content here speaks for it; in the others it is a repeat
        later = doc[i] > np.repeat(np.minimum.reduceat(doc[i], new), count)
        settled.append(i[later])
        count = count - np.add.reduceat(later.astype(np.int64), new)
        i = i[~later]
        if kind == OPEN:
            trigger, contents = np.unique(key[one], return_counts=True)
            wide = trigger[contents > finder.widest]
            if len(wide):
                yield bucket, WIDE, blobs.pack(blobs.short_key(wide))
                wide = np.isin(key[one], wide)
                spread.append(i[np.repeat(wide, count)])
                i, one, count = i[~np.repeat(wide, count)], one[~wide], count[~wide]
        if len(one):
            yield bucket, kind, blobs.pack(
                blobs.short_key(key[one]), size[one].astype(np.uint32), data[ragged(at[one], size[one])],
                count.astype(np.uint32), np.diff(doc[i], prepend=0), mark[i], start[i].astype(np.uint32), level=3)
    i = np.concatenate(settled)
    yield from covered(doc[i], mark[i], start[i], windows[i] + finder.length - 1, buckets, SETTLED)
    i = np.concatenate(spread)
    yield from send_windows(finder, doc[i], mark[i], start[i], windows[i], at[i], size[i], data, buckets)


def send_windows(finder: RepeatFinder, doc, mark, start, windows, at, size, data, buckets: int, most: int = 16 << 20):
    """Every window of the contents as a content of its own, its hash as the trigger."""
    if not len(doc):
        return
    part = np.cumsum(windows * size * finder.length // (windows + finder.length - 1)) // most
    for p in np.split(np.arange(len(doc)), np.flatnonzero(np.diff(part)) + 1):
        own = data[ragged(at[p], size[p])]
        lo = np.cumsum(size[p]) - size[p]
        a, b = finder.window_bounds(own, lo, lo + size[p])
        own, n = own[ragged(a, b - a)], b - a
        a = np.cumsum(n) - n
        owner = np.repeat(p, windows[p])
        step = np.arange(len(owner)) - np.repeat(np.cumsum(windows[p]) - windows[p], windows[p])
        yield from send_contents(
            finder, (span_hashes(own, a, a + n), doc[owner], mark[owner], start[owner] + step, np.ones(len(owner), np.int64), n, own), buckets, SPLIT)


def context_map(finder: RepeatFinder, id_col: str, text_col: str, buckets: int):
    def flush(held):
        yield from send_contents(finder, [np.concatenate(x) for x in zip(*held)], buckets, OPEN)

    def survivors(held):
        parts = [blobs.unpack(b) for kind, b in held if kind == SETTLED]
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        ids = np.concatenate([np.cumsum(p[0]) for p in parts])
        ordinal = np.concatenate([p[1] for p in parts]).astype(np.int64)
        order = np.lexsort((ordinal, ids))
        ids, ordinal = ids[order], ordinal[order]
        new = np.concatenate(([True], (ids[1:] != ids[:-1]) | (ordinal[1:] != ordinal[:-1])))
        return ids[new], ordinal[new]

    def run(source):
        def items():
            out, size = [], 0
            for _, held, rows_held in blobs.by_bucket(source, ROWS):
                sids, sordinals = survivors(held)
                if not len(sids):
                    continue
                for blob in rows_held:
                    for batch in unpack_rows(blob):
                        ids, known, texts = _ids_texts(batch, id_col, text_col)
                        lo, hi = np.searchsorted(sids, ids), np.searchsorted(sids, ids, "right")
                        rows = np.flatnonzero(known & (hi > lo))
                        texts = [texts[r] for r in rows]
                        for a, b in blocks(texts):
                            r = rows[a:b]
                            seg = finder.segments(texts[a:b])
                            first = np.searchsorted(seg.text, np.arange(b - a + 1))
                            n = np.minimum(hi[r] - lo[r], np.diff(first))  # a row has no more segments than it has
                            owner = np.repeat(np.arange(b - a), n)
                            pick = first[owner] + sordinals[ragged(lo[r], n)]
                            # a row with another text under the same id may have fewer segments
                            fits = pick < first[owner + 1]
                            pick, owner = pick[fits], owner[fits]
                            marks = text_marks(texts[a:b])
                            n = seg.hi[pick] - seg.lo[pick]
                            out.append((seg.key[pick], ids[r][owner], marks[owner], seg.start[pick], seg.windows[pick], n, seg.buffer[ragged(seg.lo[pick], n)]))
                            size += int(n.sum())
                            if size >= finder.flush_bytes:
                                yield from flush(out)
                                out, size = [], 0
            if out:
                yield from flush(out)

        yield from blobs.batches(items())

    return run


@dataclass
class Contents:
    """The distinct contents of a bucket and their occurrences."""

    data: np.ndarray
    lo: np.ndarray  # content: data[lo:lo + size]
    size: np.ndarray
    group: np.ndarray  # contents of one trigger
    wide: np.ndarray  # are there too many of them to be compared as one group?
    first: np.ndarray  # least id that holds the content
    owner: np.ndarray  # occurrence: its content
    ids: np.ndarray
    marks: np.ndarray
    start: np.ndarray


def contents_of(held: list[tuple[int, bytes]], kind: int, widest: int) -> Contents | None:
    parts = [blobs.unpack(b) for found, b in held if found == kind]
    if not parts:
        return None
    key, size, data, count, marks, start = (np.concatenate([p[k] for p in parts]) for k in (0, 1, 2, 3, 5, 6))
    ids = np.concatenate([np.cumsum(p[4]) for p in parts])
    key, size, count = blobs.long_key(key), size.astype(np.int64), count.astype(np.int64)
    lo = np.cumsum(size) - size
    content = span_hashes(data, lo, lo + size)
    # the same content from several tasks becomes one
    order = np.lexsort((content, key))
    new = other_content(key, content, data, lo, size, order)
    merged = np.empty(len(key), np.int64)
    merged[order] = np.cumsum(new) - 1
    one = order[new]
    owner = np.repeat(merged, count)
    by = np.argsort(owner, kind="stable")
    edges = np.concatenate(([0], np.flatnonzero(np.diff(owner[by])) + 1))
    first = np.minimum.reduceat(ids[by], edges)
    group = np.cumsum(np.concatenate(([True], key[one][1:] != key[one][:-1]))) - 1
    wide = np.zeros(len(one), bool)
    if kind == OPEN:
        known = [blobs.long_key(blobs.unpack(b)[0]) for found, b in held if found == WIDE]
        wide = (np.bincount(group)[group] > widest) | np.isin(key[one], np.concatenate([np.zeros(0, U64), *known]))
    return Contents(data, lo[one], size[one], group, wide, first, owner, ids, marks, start)


def resolve(finder: RepeatFinder, buckets: int, kind: int = OPEN):
    """Marks the windows that an earlier text holds; spans go to the bucket of their id.
    Of wide triggers only the later occurrences of whole contents are marked; the
    windows of the first ones go to the buckets of their own hashes."""

    def run(source):
        def items():
            for bucket, held, _ in blobs.by_bucket(source):
                yield from ((bucket, found, b) for found, b in held if found == SETTLED or found == SPLIT != kind)
                it = contents_of(held, kind, finder.widest)
                if it is None:
                    continue
                windows = finder.windows_of(it.data, it.lo, it.lo + it.size)
                offset = np.cumsum(windows) - windows
                matched = np.zeros(int(windows.sum()), bool)
                several = np.flatnonzero((np.bincount(it.group)[it.group] > 1) & ~it.wide)
                if len(several):
                    several = several[np.lexsort((it.first[several], it.group[several]))]
                    lo, hi = it.lo[several], it.lo[several] + it.size[several]
                    matched[ragged(offset[several], windows[several])] = finder.matched(it.data, lo, hi, it.group[several], it.first[several])
                n = windows[it.owner]
                repeated = matched[ragged(offset[it.owner], n)]
                repeated |= np.repeat(it.ids > it.first[it.owner], n)
                which = np.repeat(np.arange(len(it.owner)), n)
                joined = repeated[1:] & repeated[:-1] & (which[1:] == which[:-1])
                begins, ends = repeated.copy(), repeated.copy()
                begins[1:] &= ~joined
                ends[:-1] &= ~joined
                a, b = np.flatnonzero(begins), np.flatnonzero(ends)
                w = which[a]
                a = it.start[w] + (a - (np.cumsum(n) - n)[w])
                b = it.start[w] + (b - (np.cumsum(n) - n)[w]) + finder.length
                yield from covered(it.ids[w], it.marks[w], a, b - a, buckets, SETTLED)
                left = np.flatnonzero(it.wide[it.owner] & (it.ids == it.first[it.owner]))
                own = it.owner[left]
                yield from send_windows(finder, it.ids[left], it.marks[left], it.start[left].astype(np.int64), windows[own], it.lo[own], it.size[own], it.data, buckets)

        yield from blobs.batches(items())

    return run


def merged_runs(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Maximal runs of spans that ascend by start."""
    reach = np.maximum.accumulate(end)
    new = np.flatnonzero(np.concatenate(([True], start[1:] > reach[:-1])))
    return np.column_stack((start[new], reach[np.append(new[1:], len(start)) - 1]))


def apply_spans(finder: RepeatFinder, id_col: str, text_col: str, binary: bool):
    pairs = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def run(source):
        for _, held, rows_held in blobs.by_bucket(source, ROWS):
            parts = [blobs.unpack(b) for kind, b in held if kind == SETTLED]
            if parts:
                sid = np.concatenate([np.repeat(np.cumsum(p[0]), p[2]) for p in parts])
                marks = np.concatenate([np.repeat(p[1], p[2]) for p in parts])
                a = np.concatenate([_undelta(p[2], p[3]) for p in parts])
                n = np.concatenate([p[4] for p in parts])
                order = np.lexsort((n, a, marks, sid))
                order = order[changed(sid[order], marks[order], a[order], n[order])]
                sid, marks, a, n = sid[order], marks[order], a[order].astype(np.int64), n[order].astype(np.int64)
            else:
                sid = np.zeros(0, np.int64)
            for blob in rows_held:
                for batch in unpack_rows(blob):
                    ids, known, texts = _ids_texts(batch, id_col, text_col)
                    lo, hi = np.searchsorted(sid, ids), np.searchsorted(sid, ids, "right")
                    runs: list[np.ndarray | None] = [None] * len(texts)
                    for r in np.flatnonzero(known & (hi > lo)):
                        x, y = lo[r] + np.searchsorted(marks[lo[r]:hi[r]], [text_mark(texts[r]), text_mark(texts[r]) + 1])
                        if y > x:
                            runs[r] = merged_runs(a[x:y], a[x:y] + n[x:y])
                    kept, symbols = finder.cut(texts, runs)
                    values = np.concatenate([np.zeros((0, 2), np.int64), *(x for x in runs if x is not None)])
                    offsets = np.cumsum([0, *(0 if x is None else len(x) for x in runs)])
                    spans = pa.ListArray.from_arrays(
                        pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(values[:, 0]), pa.array(values[:, 1])], fields=list(pairs)))
                    out = pa.array(kept, pa.binary())
                    if not binary:
                        null = batch.column(text_col).is_null().to_numpy(zero_copy_only=False)
                        out = pa.array([None if x else k for x, k in zip(null, kept)], pa.binary()).cast(pa.string())
                    row = pa.StructArray.from_arrays(batch.columns, fields=list(batch.schema))
                    yield pa.RecordBatch.from_arrays([row, out, spans, pa.array(symbols, pa.int64())], ["row", "text", "spans", "n_symbols"])

    return run


def remove_repeats(docs: DataFrame, finder: RepeatFinder, id_col: str, text_col: str, binary: bool) -> DataFrame:
    """One row per input row: ``row`` (the input columns as they were), ``text``
    (what is left), ``spans`` (removed symbol ranges) and ``n_symbols``."""
    ship_package(docs.sparkSession)
    buckets = blobs.bucket_count(docs, text_col)
    slim = docs.select(id_col, text_col)
    triggers = slim.mapInArrow(trigger_map(finder, id_col, text_col, buckets), blobs.SCHEMA)
    surviving = blobs.dealt(triggers, trigger_reduce(buckets), blobs.SCHEMA)
    texts = slim.mapInArrow(pack_rows(id_col, text_col, buckets, all_rows=False), blobs.SCHEMA)
    contexts = blobs.dealt(surviving.union(texts), context_map(finder, id_col, text_col, buckets), blobs.SCHEMA)
    resolved = blobs.dealt(contexts, resolve(finder, buckets), blobs.SCHEMA)
    spans = blobs.dealt(resolved, resolve(finder, buckets, SPLIT), blobs.SCHEMA)
    rows = docs.mapInArrow(pack_rows(id_col, text_col, buckets, all_rows=True), blobs.SCHEMA)
    schema = T.StructType([
        T.StructField("row", T.StructType(docs.schema.fields)),
        T.StructField("text", T.BinaryType() if binary else T.StringType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
        T.StructField("n_symbols", T.LongType()),
    ])
    return blobs.dealt(spans.union(rows), apply_spans(finder, id_col, text_col, binary), schema)
