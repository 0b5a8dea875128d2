"""Benchmark decontamination with a generalised suffix automaton of the test items.

The items are normalised and added to a generalised suffix automaton. Each
training text is streamed through it, tracking the longest matching length: at
a length of ``window`` words the last words are a window of some item, and the
automaton's state says of which ones. A word the items do not have resets the
stream, so only runs of item words long enough to hold a window are streamed.

The automaton is broadcast, and its size is bounded: the items are dealt into
blocks of about ``block_words`` words (an item is never split), one automaton each,
and a task has one of them in memory at a time. Words are looked up by hash and
compared byte by byte.

Defined results: null or empty texts have no words and are never contaminated;
items without words have no window; items shorter than a window are one window;
items without an id, and repeated rows of an item, add nothing; an empty item
table marks nothing; repeated documents are judged each for itself; extra
columns are carried in ``row``, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from holdfast.llm.automaton import SuffixAutomaton
from holdfast.llm.common import ship_package, table
from holdfast.llm.shards import Shards
from holdfast.llm.textblocks import ALPHANUMERIC, LOWER, Vocabulary, binary_column, blocks, joined, word_spans, words_per_text


def normalised_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts' bytes, lower-cased, their words' starts and ends, and words per text."""
    buffer, starts = joined(texts)
    s, e = word_spans(buffer, ALPHANUMERIC)
    return LOWER[buffer], s, e, words_per_text(starts, s)


class ItemAutomaton:
    """Windows of the items of one block and the items they belong to."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.window = window
        words = [normalised_words([text])[:3] for _, text in items]
        self.vocabulary = Vocabulary(words)
        sizes = [len(starts) for _, starts, _ in words if len(starts)]
        self.shortest = min([window, *sizes])
        shard = self.shard = SuffixAutomaton()
        prefixes = [shard.add(self.vocabulary.numbers(*w).tolist()) for w in words]
        order = sorted(range(len(shard.link)), key=shard.length.__getitem__)
        # the state that holds the last ``window`` words of a state's strings
        self.holder = [-1] * len(order)
        for v in order:
            if shard.length[v] >= window:
                up = shard.link[v]
                self.holder[v] = v if shard.length[up] < window else self.holder[up]
        self.owners: dict[int, set[str]] = {}
        short: dict[int, set[str]] = {}
        for (name, _), states in zip(items, prefixes):
            if len(states) >= window:
                for v in states[window - 1:]:
                    self.owners.setdefault(self.holder[v], set()).add(name)
            elif states:
                short.setdefault(states[-1], set()).add(name)
        # whole short items that are suffixes of a state's longest string
        self.short: list[tuple] = [()] * len(order)
        for v in order[1:]:
            inherited = self.short[shard.link[v]]
            self.short[v] = (*inherited, (shard.length[v], short[v])) if v in short else inherited

    def occurrences(self, words: list[int]) -> tuple[list[tuple[int, int]], set[str]]:
        """Word ranges of the windows in a run of item words, and their items."""
        spans, names = [], set()
        for at, (state, size) in enumerate(self.shard.match(words), 1):
            if size >= self.window:
                spans.append((at - self.window, at))
                names |= self.owners[self.holder[state]]
            for length, owners in self.short[state]:
                if size >= length:
                    spans.append((at - length, at))
                    names |= owners
        return spans, names


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def _stream(shards: Shards, text_col: str):
    pairs = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def search(shard: ItemAutomaton, texts: list[bytes], hits: list[list], items: list[set]) -> np.ndarray:
        """Adds what one block's items have in the texts; returns the texts' numbers of words."""
        counts = [np.zeros(0, np.int64)]
        for lo, hi in blocks(texts):
            *words, per = normalised_words(texts[lo:hi])
            counts.append(per)
            first = np.cumsum(per) - per
            numbers = shard.vocabulary.numbers(*words)
            owner, starts, ends = Vocabulary.runs(numbers, per, shard.shortest)
            for text, x, y in zip(owner.tolist(), starts.tolist(), ends.tolist()):
                spans, names = shard.occurrences(numbers[x:y].tolist())
                if spans:
                    shift = x - int(first[text])
                    hits[lo + text] = merged([*hits[lo + text], *((s + shift, e + shift) for s, e in spans)])
                    items[lo + text] |= names
        return np.concatenate(counts)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in shards.groups(source):
            rows = [batch.column("row") for batch in group]
            hits, items = [[[] for _ in range(len(r))] for r in rows], [[set() for _ in range(len(r))] for r in rows]
            counts = [np.zeros(0, np.int64)] * len(rows)

            def against(shard: ItemAutomaton) -> None:
                for k, row in enumerate(rows):
                    counts[k] = search(shard, [t or b"" for t in binary_column(row.field(text_col)).to_pylist()], hits[k], items[k])

            shards.each(against)
            for row, n, spans, names in zip(rows, counts, hits, items):
                yield pa.RecordBatch.from_arrays([
                    row, pa.array(n, pa.int64()),
                    pa.array([[{"start": s, "end": e} for s, e in x] for x in spans], pairs),
                    pa.array([sorted(x) for x in names], pa.list_(pa.string())),
                ], ["row", "n_words", "hits", "items"])

    return run


def find_contamination(
    docs: DataFrame, items: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text",
    window: int = 13, block_words: int = 100_000,
) -> DataFrame:
    """One row per document: ``row`` (its columns as they were), ``n_words``,
    ``hits`` (word ranges inside item windows, merged) and ``items`` (ids, as
    strings, of the items with a window in it)."""
    spark = docs.sparkSession
    ship_package(spark)
    known = items.select(F.col(item_id_col).cast("string").alias("name"), F.col(item_text_col).alias("text")).where("name IS NOT NULL AND text IS NOT NULL").distinct()
    total = known.agg(F.sum(F.regexp_count("text", F.lit("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")))).first()[0] or 0
    n_blocks = -(-total // block_words) or 1
    out = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"))
    schema = T.StructType([
        T.StructField("row", T.StructType(docs.schema.fields)), T.StructField("n_words", T.LongType()),
        T.StructField("hits", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
        T.StructField("items", T.ArrayType(T.StringType())),
    ])
    shards = []
    for block in range(n_blocks):
        own = known.where(F.pmod(F.xxhash64("name"), F.lit(n_blocks)) == block).collect()
        shards.append(spark.sparkContext.broadcast(ItemAutomaton(sorted((r["name"], r["text"].encode()) for r in own), window)))
    return out.mapInArrow(_stream(Shards(shards), text_col), schema)


def contaminated(max_coverage_divisor: int = 20) -> F.Column:
    """At least one hit, and hits in at least 1/divisor of the words."""
    hit = hit_words()
    return (hit > 0) & (hit * max_coverage_divisor >= F.col("n_words"))


def hit_words() -> F.Column:
    return F.aggregate("hits", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", spans: bool = False, max_length: int = 0, max_coverage_divisor: int = 20) -> DataFrame:
    """The documents without what leaked into them.

    By default a document over the coverage limit is removed whole, since most of
    what surrounds a leaked item describes it, and all others stay as they are.
    With ``spans`` every hit run of more than ``max_length`` words is cut out of its
    document, and so are all hits of a document over the coverage limit; documents
    stay, with what is left of them.
    """
    found = find_contamination(docs, items, text_col)
    if not spans:
        return found.where(~contaminated(max_coverage_divisor)).select("row.*")
    cut = F.when(contaminated(max_coverage_divisor), F.col("hits")).otherwise(F.filter("hits", lambda s: s["end"] - s["start"] > max_length))
    return found.select("row", cut.alias("spans")).mapInArrow(_without_spans(text_col), T.StructType(docs.schema.fields))


def _without_spans(text_col: str):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            row, lists = batch.column("row"), batch.column("spans").to_pylist()
            kept = []
            for text, spans in zip(binary_column(row.field(text_col)).to_pylist(), lists):
                if spans:
                    _, s, e, _ = normalised_words([text])
                    bounds = [0, *(x for p in spans for x in (int(s[p["start"]]), int(e[p["end"] - 1]))), len(text)]
                    text = b"".join(text[a:b] for a, b in zip(bounds[0::2], bounds[1::2]))
                kept.append(text)
            texts = pa.array(kept, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([texts if f.name == text_col else row.field(i) for i, f in enumerate(row.type)], [f.name for f in row.type])

    return run


def query(spark, sf_dir: str) -> DataFrame:
    """op9: hits of the benchmark in each document."""
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("row.doc_id").alias("doc_id"), "n_words", hit_words().alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"), contaminated().alias("contaminated"),
    )


ORACLE = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, least(len(words), 13) AS n, array_to_string(words[p : p + least(len(words), 13) - 1], ' ') AS win
  FROM (SELECT item_id, words, unnest(range(1, len(words) - least(len(words), 13) + 2)) AS p FROM i WHERE len(words) > 0)),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (
  SELECT doc_id, n, p, array_to_string(words[p : p + n - 1], ' ') AS win
  FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS p FROM w, sizes WHERE len(words) >= n)),
m AS (SELECT dw.doc_id, dw.n, dw.p, iw.item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.win = iw.win),
h AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(s, ',' ORDER BY s)) AS digest
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(digest, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w.words) AS contaminated
FROM w LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
