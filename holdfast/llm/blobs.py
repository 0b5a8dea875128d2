"""Packed arrays as shuffle rows.

Positions and hashes of a corpus are many small numbers. Tasks pack those that
go to one bucket into one compressed binary row, so Spark shuffles a few
kilobyte rows instead of hundreds of millions of tiny ones; partitioning,
shuffling and recovery stay Spark's.
"""

from __future__ import annotations

import itertools
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from holdfast.llm.textblocks import U64

SCHEMA = "bucket int, kind int, blob binary"
_ARROW = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("blob", pa.binary())])


def bucket_count(docs: DataFrame, text_col: str) -> int:
    """One bucket per megabyte of text, at most a few times the shuffle partitions,
    which the cluster sets to fit the data; odd, so that regular ids spread."""
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    most = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return min(most, size >> 20) | 1


def pack(*arrays: np.ndarray, level: int = 1) -> bytes:
    """The arrays, first bytes before second bytes: small numbers have equal high bytes."""
    parts = []
    for a in arrays:
        parts += [struct.pack("<cQ", a.dtype.char.encode(), a.nbytes), np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes() if a.itemsize > 1 and len(a) else a.tobytes()]
    return zstandard.ZstdCompressor(level=level).compress(b"".join(parts))


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    out, at = [], 0
    while at < len(raw):
        kind, size = struct.unpack_from("<cQ", raw, at)
        at += 9
        dtype = np.dtype(kind.decode())
        planes = np.frombuffer(raw, np.uint8, size, at).reshape(dtype.itemsize, -1)
        out.append(planes[0] if dtype == np.uint8 else np.ascontiguousarray(planes.T).view(dtype).ravel())
        at += size
    return out


def rows(items: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in items], _ARROW.field(i).type) for i in range(3)], schema=_ARROW)


def batches(items: Iterator[tuple[int, int, bytes]], limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches of at most about ``limit`` bytes."""
    held, size = [], 0
    for item in items:
        held.append(item)
        size += len(item[2]) + 16
        if size >= limit:
            yield rows(held)
            held, size = [], 0
    if held:
        yield rows(held)


def by_bucket(source: Iterator[pa.RecordBatch], last: int | None = None) -> Iterator[tuple[int, list[tuple[int, bytes]], Iterator[bytes]]]:
    """(bucket, [(kind, blob), ..], blobs of kind ``last``) from batches sorted by bucket
    and kind; those of kind ``last``, the greatest, are not held but read one by one."""

    def items():
        for batch in source:
            buckets, kinds = (batch.column(i).to_pylist() for i in range(2))
            for i, b in enumerate(buckets):
                yield b, kinds[i], batch.column(2)[i].as_py()

    for bucket, group in itertools.groupby(items(), key=lambda item: item[0]):
        held, rest = [], iter(())
        for item in group:
            if item[1] == last:
                rest = (x[2] for x in itertools.chain([item], group))
                break
            held.append(item[1:])
        yield bucket, held, rest


def dealt(df: DataFrame, reduce: Callable, schema: str) -> DataFrame:
    """Brings the rows of each bucket together and runs ``reduce`` over the sorted buckets."""
    return df.repartition("bucket").sortWithinPartitions("bucket", "kind").mapInArrow(reduce, schema)


def salt(marks: np.ndarray) -> np.ndarray:
    """Six bits of a text's mark, so that rows that repeat one id spread over 64 buckets."""
    return (marks & 63).astype(np.uint8)


def id_bucket(ids: np.ndarray, marks: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of a document id with the mark, or its salt, of the document's text."""
    return (((ids ^ (ids >> 17)) % buckets + salt(marks)) % buckets).astype(np.int32)


def slices(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, indices) for each bucket that occurs; indices keep their order."""
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    found = bucket[order]
    edges = np.concatenate(([0], np.flatnonzero(found[1:] != found[:-1]) + 1, [len(found)]))
    for lo, hi in zip(edges[:-1], edges[1:]):
        yield int(found[lo]), order[lo:hi]


def short_key(keys: np.ndarray) -> np.ndarray:
    """40 bits of a 64-bit key as five bytes each; with the bucket they make a sieve, not a proof."""
    return (keys >> U64(24)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].ravel()


def long_key(five: np.ndarray) -> np.ndarray:
    out = np.zeros((len(five) // 5, 8), np.uint8)
    out[:, :5] = five.reshape(-1, 5)
    return out.view("<u8").ravel()
