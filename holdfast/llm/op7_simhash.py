"""SimHash near-dedup with multi-index hashing.

Fingerprints: 64 bits, each the majority of that bit over the XXH64 hashes of
the text's word shingles. Equal fingerprints are one node. The 64 bits are cut
into ``segments`` parts; two fingerprints within ``max_bits`` agree in some part
up to a small radius (if r = segments * k + rest, one of the first rest + 1
parts to k bits or one of the others to k - 1), so each part's small Hamming
ball is enumerated and looked up among the others' parts. To meet a pair once
per part, a probe clears bits only: of two parts that differ in one bit, one
clears it to reach the other. Fingerprints that meet are verified over all 64
bits.

Three parts of 21 or 22 bits cost 24 cells a fingerprint and hold few in a cell up
to tens of millions of distinct fingerprints; beyond, two parts of 32 bits cost
some 150 cells each and stay sparse for billions. ``segments_for`` chooses by the
count; the groups are the same with either.

A table cell that holds more than ``cell`` fingerprints is dealt into pairs of
blocks, each its own group. Within a group links are found by growing
components, so a dense cluster of n fingerprints gives n - 1 links and not n².
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from holdfast.llm.common import ship_package, table, written
from holdfast.llm.components import components
from holdfast.llm.textblocks import BLOCK_BYTES, NOT_SPACE, U64, binary_column, pieces

BLOCK = 1 << 14


def fingerprint(text: bytes, shingle: int = 4, size: int = BLOCK_BYTES) -> int:
    """SimHash of the lower-cased text, read in pieces of about ``size`` bytes; 0 without words."""
    total, n, words = np.zeros(64, np.int64), 0, []
    for piece in pieces(text, NOT_SPACE, size):
        words += piece.lower().split()  # bytes: A-Z and ASCII white space only
        if len(words) >= shingle:
            n += add_shingles(words, shingle, total)
            words = words[len(words) - shingle + 1:]  # those a shingle of the next piece may begin with
    if not n and words:
        n = add_shingles(words, len(words), total)
    return int(np.packbits(2 * total > n).view(U64)[0]) if n else 0


def add_shingles(words: list[bytes], take: int, total: np.ndarray) -> int:
    """Adds the bits of every run of ``take`` words to ``total``; the number of runs."""
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    lo, hi = starts[: len(words) - take + 1].tolist(), ends[take - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(lo), BLOCK):
        hashes = np.array([digest(joined[a:b], 42) for a, b in zip(lo[at:at + BLOCK], hi[at:at + BLOCK])], U64)
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return len(lo)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(``id``, ``fingerprint`` as a signed long) of every row; null text: 0."""
    ship_package(docs.sparkSession)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            texts = binary_column(batch.column(1))
            values = np.fromiter((fingerprint(t.as_py() or b"", shingle) for t in texts), U64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], ["id", "fingerprint"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, fingerprint long")


def segments_for(distinct: int, small: int = 32) -> int:
    """Three parts while an average cell of theirs holds at most ``small`` fingerprints
    (which are compared in one sweep), two beyond."""
    return 3 if distinct <= small << (64 // 3) else 2


def probe_plan(segments: int, max_bits: int) -> list[tuple[int, int, int]]:
    """(first bit, bits, radius) of each part."""
    edges = [64 * i // segments for i in range(segments + 1)]
    k, rest = divmod(max_bits, segments)
    return [(a, b - a, k if i <= rest else k - 1) for i, (a, b) in enumerate(zip(edges, edges[1:])) if (k if i <= rest else k - 1) >= 0]


def table_cells(values: np.ndarray, plan: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """(cell, index): every fingerprint in its own cells and in those a ball around it reaches by clearing bits.

    A pair at distance d in a part has its d bits set on one side or the other;
    both clear theirs and meet in the cell where all d are clear.
    """
    cells, owners = [], []
    index = np.arange(len(values))
    for part, (first, bits, radius) in enumerate(plan):
        own = (values >> U64(first)) & U64((1 << bits) - 1)
        tag = U64(part << 58)
        for flips in range(radius + 1):
            for chosen in combinations(range(bits), flips):
                mask = U64(sum(1 << c for c in chosen))
                hit = (own & mask) == mask
                cells.append((own[hit] & ~mask) | tag)
                owners.append(index[hit])
    return np.concatenate(cells), np.concatenate(owners)


def grown_links(values: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect each component of a group (n - 1 for n fingerprints)."""
    left, right = [], []
    rest = values
    while len(rest) > 1:
        seed, rest = rest[:1], rest[1:]
        frontier = seed
        while len(frontier) and len(rest):
            near = np.bitwise_count(rest ^ frontier[0]) <= max_bits
            found, frontier = rest[near], frontier[1:]
            if len(found):
                left.append(np.repeat(seed, len(found)))
                right.append(found)
                frontier = np.concatenate((frontier, found))
                rest = rest[~near]
    empty = values[:0]
    return np.concatenate([empty, *left]), np.concatenate([empty, *right])


def linked_in_groups(group: np.ndarray, values: np.ndarray, max_bits: int, small: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """Links inside the groups of a sorted array: neighbours at each offset for
    small groups, grown components for larger ones."""
    edges = np.concatenate(([0], np.flatnonzero(group[1:] != group[:-1]) + 1, [len(group)])) if len(group) else np.zeros(1, np.int64)
    size = np.diff(edges)
    left, right = [values[:0]], [values[:0]]
    for g in np.flatnonzero(size > small):
        a, b = grown_links(np.unique(values[edges[g]:edges[g + 1]]), max_bits)
        left.append(a)
        right.append(b)
    remaining = np.repeat(np.where(size > small, 0, size) - 1, size)
    remaining -= np.arange(len(group)) - np.repeat(edges[:-1], size)  # followers in the group
    at, step = np.flatnonzero(remaining > 0), 1
    while len(at):
        near = np.bitwise_count(values[at] ^ values[at + step]) <= max_bits
        left.append(values[at[near]])
        right.append(values[at[near] + step])
        step += 1
        at = at[remaining[at] >= step]
    return np.concatenate(left), np.concatenate(right)


def near_links(distinct: DataFrame, max_bits: int = 4, segments: int = 3, cell: int = 50_000) -> DataFrame:
    """Links (a, b) that connect the distinct fingerprints within ``max_bits``."""
    plan = probe_plan(segments, max_bits)

    def expand(source):
        for batch in source:
            values = batch.column(0).to_numpy().view(U64)
            for lo in range(0, len(values), 4096):
                part = values[lo:lo + 4096]
                cells, owner = table_cells(part, plan)
                yield pa.RecordBatch.from_arrays([pa.array(cells.view(np.int64)), pa.array(part[owner].view(np.int64))], ["cell", "fingerprint"])

    def verify(source):
        held: list[np.ndarray] = []
        for batch in source:
            rows = np.stack([batch.column(i).to_numpy() for i in range(4)])
            rows = np.concatenate((*held, rows), axis=1)
            change = np.flatnonzero((rows[:3, 1:] != rows[:3, :-1]).any(axis=0)) + 1
            if not len(change):
                held = [rows]
                continue
            held = [rows[:, change[-1]:]]
            yield links(rows[:, :change[-1]])
        if held:
            yield links(held[0])

    def links(rows):
        new = np.concatenate(([0], (rows[:3, 1:] != rows[:3, :-1]).any(axis=0)))[: rows.shape[1]]
        a, b = linked_in_groups(np.cumsum(new), rows[3].view(U64), max_bits)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    cells = distinct.select("fingerprint").mapInArrow(expand, "cell long, fingerprint long")
    full = written(cells.groupBy("cell").count().where(F.col("count") > cell).select(F.col("cell").alias("full"), F.ceil(F.col("count") / cell).cast("int").alias("parts")), "full-cells")
    dealt = cells.join(full, F.col("cell") == F.col("full"), "left").select(
        "cell", "fingerprint", F.coalesce("parts", F.lit(1)).alias("parts"))
    own = F.pmod(F.xxhash64("fingerprint"), F.col("parts")).cast("int")
    dealt = dealt.select("cell", "fingerprint", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")).select(
        "cell", F.least("own", "other").cast("long").alias("p"), F.greatest("own", "other").cast("long").alias("q"), "fingerprint")
    return dealt.repartition("cell", "p", "q").sortWithinPartitions("cell", "p", "q").mapInArrow(verify, "a long, b long")


def grouped(marked: DataFrame, max_bits: int = 4, segments: int | None = None) -> DataFrame:
    """(``key`` a fingerprint, ``root`` of its group, ``component`` the group's
    smallest id) for the fingerprints of (``id``, ``fingerprint``)."""
    distinct = written(marked.groupBy("fingerprint").agg(F.min("id").alias("least")), "distinct")
    roots = written(components(near_links(distinct, max_bits, segments or segments_for(distinct.count()))), "roots")
    named = distinct.join(roots, F.col("fingerprint") == F.col("node"), "left").select(
        "fingerprint", "least", F.coalesce("component", "fingerprint").alias("root"))
    named = written(named, "named")
    first = written(named.groupBy("root").agg(F.min("least").alias("first")).withColumnRenamed("root", "of"), "first")
    return written(named.join(first, F.col("root") == F.col("of")).select(F.col("fingerprint").alias("key"), "root", F.col("first").alias("component")), "found")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, max_bits: int = 4, segments: int | None = None) -> DataFrame:
    """(``id``, ``fingerprint`` long, ``component`` the smallest id reachable by
    links of ``max_bits`` or fewer differing bits) for every row.

    Null or empty texts have fingerprint 0 and link like any other; a text
    shorter than a shingle is one shingle; rows that repeat an id keep a row
    each; a null id is never a component (null if all its members are null); an
    empty table gives an empty result; other columns are not read.
    """
    marked = written(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    return marked.join(grouped(marked, max_bits, segments), F.col("fingerprint") == F.col("key")).select("id", "fingerprint", "component")


def text_key(text: F.Column) -> F.Column:
    """128 bits of a text; a null text is not an empty one."""
    return F.coalesce(F.md5(text.cast("binary")), F.lit(""))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, max_bits: int = 4, segments: int | None = None) -> DataFrame:
    """One row of each group of near duplicates: of those with the group's smallest
    id the one whose text has the smallest hash (of equal rows any one). Rows
    without an id all stay.

    Which rows go is decided on (id, text hash, fingerprint) alone; the documents
    then meet only the keys that go or repeat, so where these are few no text moves.
    """
    ship_package(docs.sparkSession)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            texts = binary_column(batch.column(1))
            values = np.fromiter((fingerprint(t.as_py() or b"", shingle) for t in texts), U64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(values.view(np.int64))], ["id", "text_key", "fingerprint"])

    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), text_key(F.col(text_col)).alias("text_key"))
    marked = written(narrow.mapInArrow(run, "id long, text_key string, fingerprint long"), "fingerprints")
    rows = marked.where("id IS NOT NULL").groupBy("id", "text_key", "fingerprint").agg(F.count("*").alias("rows"))
    rows = written(rows.join(grouped(marked, max_bits, segments), F.col("fingerprint") == F.col("key")).select("id", "text_key", "rows", "root"), "rows")
    best = written(rows.groupBy("root").agg(F.min(F.struct("id", "text_key")).alias("best")).withColumnRenamed("root", "of"), "best")
    stays = F.struct("id", "text_key") == F.col("best")
    touched = rows.join(best, F.col("root") == F.col("of")).where(~stays | (F.col("rows") > 1))
    touched = written(touched.select(F.col("id").alias("of_id"), F.col("text_key").alias("of_text"), stays.alias("stays")), "touched")

    packed = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"))
    key, text = F.col(f"row.`{id_col}`").cast("long"), text_key(F.col(f"row.`{text_col}`"))
    met = packed.join(touched, (key == F.col("of_id")) & (text == F.col("of_text")), "left")
    single = met.where("of_id IS NULL").select("row")
    if touched.where("stays").head() is not None:  # equal rows, of which one stays
        single = single.union(met.where("stays").dropDuplicates(["of_id", "of_text"]).select("row"))
    return single.select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    """op7: fingerprint and group of each document."""
    found = near_duplicates(table(spark, sf_dir, "documents"), shingle=4, max_bits=4)
    return found.select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )
