"""Suffix-array dedup by prefix-free parsing.

A rolling hash over ``gram`` bytes sets triggers, and triggers cut the corpus
into phrases. A trigger here is the least rolling hash of a window instead of a
hash that is 0 modulo some p: then no 50-byte string lacks a trigger, and no
corner case is left out. A phrase is kept with the text up to the end of its
last window, so a suffix of length 50 that starts in a phrase never leaves it.

The dictionary is the set of distinct phrases, met once whatever their number
of copies; the parse is the list of their occurrences (document, position). The
suffix array of the dictionary phrases that share a trigger, to depth 50, puts
equal strings next to each other; with the documents of the parse it tells the
first document of every string, in corpus order.

Defined results: null and empty texts have no bytes and an empty remainder;
texts under 50 bytes are unchanged; rows with a null id neither remove nor are
removed; rows that repeat an id do not remove each other; an empty table gives
an empty result; extra columns are carried in ``row``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from holdfast.llm.repeats import RepeatFinder, Segments, remove_repeats, window_runs
from holdfast.llm.textblocks import ragged, rolling_hashes, sliding_minimum


def suffix_order(buffer: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes at ``starts`` by their first ``depth`` bytes, and
    whether each one equals its predecessor to that depth."""
    padded = np.concatenate((buffer, np.zeros(8, np.uint8)))
    columns = []
    for at in range(0, depth, 8):
        width = min(8, depth - at)
        eight = np.zeros((len(starts), 8), np.uint8)
        for k in range(width):
            eight[:, k] = padded[starts + at + k]
        columns.append(eight.view(">u8").ravel().astype(np.uint64))
    order = np.lexsort(columns[::-1])
    same = np.ones(len(starts), bool)
    same[:1] = False
    for c in columns:
        same[1:] &= c[order][1:] == c[order][:-1]
    return order, same


class ByteRepeats(RepeatFinder):
    def __init__(self, length: int = 50, gram: int = 24):
        self.length, self.gram = length, min(gram, length)

    def segments(self, texts: list[bytes]) -> Segments:
        buffer = np.frombuffer(b"".join(texts), np.uint8)
        counts = np.fromiter(map(len, texts), np.int64, len(texts))
        starts = np.cumsum(counts) - counts
        least = sliding_minimum(rolling_hashes(buffer, self.gram), self.length - self.gram + 1)
        text, start, windows, key = window_runs(least, starts, counts, self.length)
        lo = starts[text] + start
        return Segments(text, start, windows, key, buffer, lo, lo + windows + self.length - 1)

    def windows_of(self, buffer, lo, hi):
        return hi - lo - self.length + 1

    def window_bounds(self, buffer, lo, hi):
        at = ragged(lo, self.windows_of(buffer, lo, hi))
        return at, at + self.length

    def matched(self, buffer, lo, hi, group, first):
        windows = self.windows_of(buffer, lo, hi)
        order, same = suffix_order(buffer, ragged(lo, windows), self.length)
        edges = np.flatnonzero(~same)
        doc = np.repeat(first, windows)
        earliest = np.minimum.reduceat(doc[order], edges)
        out = np.empty(len(order), bool)
        out[order] = np.repeat(earliest, np.diff(np.append(edges, len(order)))) < doc[order]
        return out

    def cut(self, texts, runs):
        kept = []
        for text, run in zip(texts, runs):
            if run is not None:
                bounds = [0, *run.ravel().tolist(), len(text)]
                text = b"".join(text[x:y] for x, y in zip(bounds[0::2], bounds[1::2]))
            kept.append(text)
        return kept, np.fromiter(map(len, texts), np.int64, len(texts))


def remove_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50) -> DataFrame:
    """Removes every byte covered by a ``length``-byte string that also starts in
    a document with a smaller id.

    Returns ``row`` (the input columns as they were), ``text`` (the bytes left),
    ``spans`` (removed byte ranges, maximal) and ``n_symbols`` (bytes).
    """
    return remove_repeats(docs, ByteRepeats(length), id_col, text_col, binary=True)


def query(spark, sf_dir: str) -> DataFrame:
    """op5: bytes, removed bytes, removed runs and digest of the rest of each document."""
    found = remove_repeated_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        F.col("n_symbols").alias("n_bytes"),
        F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("text", 256).alias("kept_sha256"),
    )
