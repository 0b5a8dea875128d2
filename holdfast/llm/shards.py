"""Broadcast reference shards of which a task has one in memory at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import Broadcast


class Shards:
    """The shards of a reference, each broadcast for itself. Spark keeps a broadcast
    value as a file beside the Python worker; it is loaded where it is read.

    A task takes its batches in groups of about ``hold`` bytes and loads the shards
    in turn for each group, back and forth: the shard that ends a group begins the
    next one, so a single shard is loaded once.
    """

    def __init__(self, shards: list[Broadcast], hold: int = 32 << 20):
        self.shards = shards
        self.hold = hold if len(shards) > 1 else 0

    def groups(self, source: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in source:
            held.append(batch)
            size += batch.nbytes
            if size >= self.hold:
                yield held
                held, size = [], 0
        if held:
            yield held

    def each(self, use: Callable[[object], None]) -> None:
        for i, shard in enumerate(self.shards):
            if i:
                vars(self.shards[i - 1]).pop("_value", None)  # the loaded copy; the file stays
            use(shard.value)
        self.shards = self.shards[::-1]
