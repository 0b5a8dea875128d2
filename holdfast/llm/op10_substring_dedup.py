"""Substring dedup with suffix automata over reference shards.

Every text is streamed against the texts with smaller ids. The reference is the
corpus itself, so its shards cannot be broadcast: they grow with the input.
Instead each shard is the set of passages that share a trigger (see
``repeats``), and the passages travel to the shard. In a shard a generalised
suffix automaton takes the passages in the order of their first document; each
passage is streamed through the automaton of the earlier ones before it is
added, and where the matching length reaches the threshold the last words are a
repeated window.

A reference that is given (licence texts, boilerplate, another corpus's sample)
is dealt into shards of a bounded number of words; their automata are broadcast
one after the other (``remove_reference_passages``).

Defined results: null text has no words and stays null; texts shorter than the
threshold are unchanged; rows with a null id neither remove nor are removed;
rows that repeat an id do not remove each other, whatever their texts; an empty
table gives an empty result; extra columns are carried in ``row``, so their
names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from holdfast.llm.automaton import SuffixAutomaton
from holdfast.llm.common import ship_package
from holdfast.llm.repeats import RepeatFinder, Segments, merged_runs, remove_repeats, window_runs
from holdfast.llm.shards import Shards
from holdfast.llm.textblocks import NOT_SPACE, Vocabulary, binary_column, blocks, gram_hashes, joined, ragged, sliding_minimum, span_hashes, word_spans, words_per_text


class WordRepeats(RepeatFinder):
    """Windows of ``length`` words; triggers are least hashes of ``gram`` words."""

    def __init__(self, length: int = 13, gram: int = 5):
        self.length, self.gram = length, min(gram, length)

    def segments(self, texts: list[bytes]) -> Segments:
        buffer, starts = joined(texts)
        s, e = word_spans(buffer, NOT_SPACE)
        counts = words_per_text(starts, s)
        first_word = np.cumsum(counts) - counts
        least = sliding_minimum(gram_hashes(span_hashes(buffer, s, e), self.gram), self.length - self.gram + 1)
        text, start, windows, key = window_runs(least, first_word, counts, self.length)
        # words with one space after each, so that contents do not depend on white space
        size = e - s + 1
        at = np.cumsum(size) - size
        spaced = np.append(buffer, np.uint8(0x20))[ragged(s, size)]
        spaced[at + size - 1] = 0x20
        begin = first_word[text] + start
        last = begin + windows + self.length - 2
        return Segments(text, start, windows, key, spaced, at[begin], at[last] + size[last] - 1)

    def windows_of(self, buffer, lo, hi):
        spaces = np.flatnonzero(buffer == 0x20)
        return np.searchsorted(spaces, hi) - np.searchsorted(spaces, lo) + 1 - self.length + 1

    def window_bounds(self, buffer, lo, hi):
        spaces = np.flatnonzero(buffer == 0x20)
        windows = self.windows_of(buffer, lo, hi)
        words = windows + self.length - 1
        first = np.cumsum(words) - words
        begin, end = np.empty(int(words.sum()), np.int64), np.empty(int(words.sum()), np.int64)
        inner = np.ones(len(begin), bool)
        inner[first] = False
        begin[first], begin[inner] = lo, spaces + 1
        inner = np.ones(len(end), bool)
        inner[first + words - 1] = False
        end[first + words - 1], end[inner] = hi, spaces
        at = ragged(first, windows)
        return begin[at], end[at + self.length - 1]

    def matched(self, buffer, lo, hi, group, first):
        data, length, out = buffer.tobytes(), self.length, []
        edges = np.concatenate(([0], np.flatnonzero(np.diff(group)) + 1, [len(group)]))
        for g, h in zip(edges[:-1].tolist(), edges[1:].tolist()):
            shard, waiting = SuffixAutomaton(), []
            for i in range(g, h):
                words = data[lo[i]:hi[i]].split(b" ")
                if waiting and first[i] != first[i - 1]:  # passages of one document do not match each other
                    for earlier in waiting:
                        shard.add(earlier)
                    waiting = []
                waiting.append(words)
                out += [size >= length for _, size in shard.match(words)[length - 1:]]
        return np.array(out, bool)

    def cut(self, texts, runs):
        kept, counts = list(texts), []
        for lo, hi in blocks(texts):
            buffer, starts = joined(texts[lo:hi])
            s, e = word_spans(buffer, NOT_SPACE)
            per = words_per_text(starts, s)
            first = np.cumsum(per) - per
            counts.append(per)
            for r in range(lo, hi):
                if runs[r] is not None:
                    a = s[first[r - lo] + runs[r][:, 0]] - starts[r - lo]
                    b = e[first[r - lo] + runs[r][:, 1] - 1] - starts[r - lo]
                    bounds = [0, *np.column_stack((a, b)).ravel().tolist(), len(texts[r])]
                    kept[r] = b"".join(texts[r][x:y] for x, y in zip(bounds[0::2], bounds[1::2]))
        return kept, np.concatenate(counts) if counts else np.zeros(0, np.int64)


def remove_repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 13) -> DataFrame:
    """Removes every word covered by ``length`` consecutive words that also start
    in a document with a smaller id; the white space around a cut stays.

    Returns ``row`` (the input columns as they were), ``text`` (what is left),
    ``spans`` (removed word ranges, maximal) and ``n_symbols`` (words).
    """
    return remove_repeats(docs, WordRepeats(length), id_col, text_col, binary=False)


def _against(shards: Shards, text_col: str, length: int):
    """Each row's spans that match in any shard."""
    pairs = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def search(vocabulary: Vocabulary, automaton: SuffixAutomaton, texts: list[bytes], found: list[list]) -> None:
        for lo, hi in blocks(texts):
            buffer, starts = joined(texts[lo:hi])
            s, e = word_spans(buffer, NOT_SPACE)
            per = words_per_text(starts, s)
            first = np.cumsum(per) - per
            numbers = vocabulary.numbers(buffer, s, e)
            for text, a, b in zip(*(x.tolist() for x in Vocabulary.runs(numbers, per, length))):
                shift = a - int(first[text])
                ends = [at for at, (_, size) in enumerate(automaton.match(numbers[a:b].tolist()), 1) if size >= length]
                if ends:
                    # windows one word apart are one span: only its first start and last end are kept
                    ends = np.array(ends)
                    cut = np.flatnonzero(np.diff(ends) > 1)
                    begins, last = ends[np.concatenate(([0], cut + 1))] - length, ends[np.append(cut, len(ends) - 1)]
                    found[lo + text] += zip((begins + shift).tolist(), (last + shift).tolist())

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in shards.groups(source):
            rows = [batch.column("row") for batch in group]
            found = [[[] for _ in range(len(r))] for r in rows]

            def against(shard: tuple[Vocabulary, SuffixAutomaton]) -> None:
                for row, spans in zip(rows, found):
                    search(*shard, [t or b"" for t in binary_column(row.field(text_col)).to_pylist()], spans)

            shards.each(against)
            for row, every in zip(rows, found):
                spans = [[] if not x else merged_runs(*(np.array(c) for c in zip(*sorted(x)))).tolist() for x in every]
                yield pa.RecordBatch.from_arrays([row, pa.array([[{"start": a, "end": b} for a, b in x] for x in spans], pairs)], ["row", "spans"])

    return run


def _cut(text_col: str):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            texts = binary_column(batch.column("row").field(text_col)).to_pylist()
            runs = [np.array([(s["start"], s["end"]) for s in x]) if x else None for x in batch.column("spans").to_pylist()]
            kept, words = WordRepeats().cut([t or b"" for t in texts], runs)
            kept = pa.array([None if t is None else k for t, k in zip(texts, kept)], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("row"), kept, batch.column("spans"), pa.array(words, pa.int64())], ["row", "text", "spans", "n_symbols"])

    return run


def remove_reference_passages(docs: DataFrame, reference: DataFrame, text_col: str = "text", length: int = 13, shard_words: int = 100_000) -> DataFrame:
    """Removes the maximal spans of at least ``length`` words that also stand in a
    text of ``reference``. Output as ``remove_repeated_passages``.

    The reference texts are dealt into shards of about ``shard_words`` words (a text
    is never split), whose suffix automata are broadcast; a task has one of them in
    memory at a time and streams its documents through it. Meant for a reference of
    bounded size: the work is the number of shards times the documents.
    """
    spark = docs.sparkSession
    ship_package(spark)
    known = reference.select(F.col(text_col).alias("text")).where("text IS NOT NULL").distinct()
    total = known.agg(F.sum(F.regexp_count("text", F.lit("[^\\x20\\x09-\\x0D]+")))).first()[0] or 0
    n_shards = -(-total // shard_words) or 1
    row = T.StructField("row", T.StructType(docs.schema.fields))
    spans = T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))
    out = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"))
    shards = []
    for number in range(n_shards):
        own = known.where(F.pmod(F.xxhash64("text"), F.lit(n_shards)) == number).collect()
        words = []
        for text in sorted(r["text"].encode() for r in own):
            buffer, _ = joined([text])
            words.append((buffer, *word_spans(buffer, NOT_SPACE)))
        vocabulary, automaton = Vocabulary(words), SuffixAutomaton()
        for w in words:
            automaton.add(vocabulary.numbers(*w).tolist())
        shards.append(spark.sparkContext.broadcast((vocabulary, automaton)))
    out = out.mapInArrow(_against(Shards(shards), text_col, length), T.StructType([row, spans]))
    return out.mapInArrow(_cut(text_col), T.StructType([row, T.StructField("text", T.StringType()), spans, T.StructField("n_symbols", T.LongType())]))


def removed_symbols(spans: str = "spans") -> F.Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def query(spark, sf_dir: str) -> DataFrame:
    """op10: words, removed words and digest of the kept words of each document."""
    found = remove_repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    words = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        F.col("n_symbols").alias("n_words"),
        removed_symbols().alias("n_removed"),
        F.sha2(words.cast("binary"), 256).alias("kept_sha256"),
    )


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
win AS (
  SELECT doc_id, p, array_to_string(words[p : p + 12], ' ') AS k
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS p FROM w WHERE len(words) >= 13)),
f AS (SELECT k, min(doc_id) AS first FROM win GROUP BY k),
r AS (SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS q FROM win JOIN f USING (k) WHERE first < doc_id),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY q) AS rest
  FROM (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS q FROM w) ANTI JOIN r USING (doc_id, q) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(rest, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
