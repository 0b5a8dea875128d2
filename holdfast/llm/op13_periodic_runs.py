"""Periodic run detection by a suffix automaton with link-cut access.

A run is a maximal stretch of words with a smallest period q that is at least
``exponent`` periods and ``shortest`` words long.

1. The suffix automaton of the words is built; its suffix links form a tree
   whose paths to the root hold the suffixes of each prefix.
2. The prefixes are then appended one after the other: the path from a prefix's
   state to the root takes the colour of its end. A link-cut tree keeps paths of
   one colour together, so a step meets one segment per distinct last
   occurrence on the path, O(log n) amortised, and recolours them all at once.
3. A segment that last ended at c, met by the prefix that ends at i, has its
   longest string, of L words, at both ends. If i - c is at most L, these
   occurrences overlap or touch: a square of period i - c, whose left end is as
   far left as the period reaches. The last prefix that meets it gives the right
   end, and the square has been extended to its run. In a run of three periods
   or more no other period can come between, so the run's own is found.

Before that a sieve cuts each text into stretches that could hold a run: in a run
of period q, every three words have an equal three at distance q, and q is at most
the stretch's length by ``exponent``. It compares hashes of the words, so it can only keep
too much; the automaton compares the words. Most texts have no such stretch and
never reach the automaton. All work is by text: nothing is shuffled.

Defined results: null and empty texts have no words and no runs, null stays null;
rows that repeat an id or a text are each judged; an empty table gives an empty
result; extra columns are carried in ``row``, so their names cannot clash.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from holdfast.llm.common import ship_package, table
from holdfast.llm.textblocks import NOT_SPACE, binary_column, blocks, gram_hashes, joined, span_hashes, word_spans, words_per_text

GRAM = 3  # words the sieve compares
FAR = np.int64(1) << 60
RUN = "struct<start:bigint,length:bigint,period:bigint>"


def suffix_links(words: Sequence[int]) -> tuple[array, array, array]:
    """Suffix link and longest length of every state, and the state of every prefix.

    Most states have one transition, kept in two arrays; a dictionary takes the rest.
    """
    link, longest, word, target = array("i", [-1]), array("i", [0]), array("i", [-1]), array("i", [-1])
    more: dict[int, dict[int, int]] = {}
    states, last = array("i"), 0
    for w in words:
        new = len(link)
        link.append(0)
        longest.append(longest[last] + 1)
        word.append(-1)
        target.append(-1)
        p, known = last, -1
        while p >= 0:
            if word[p] == w:
                known = target[p]
                break
            if word[p] < 0:
                word[p], target[p] = w, new
            else:
                others = more.setdefault(p, {})
                known = others.get(w, -1)
                if known >= 0:
                    break
                others[w] = new
            p = link[p]
        if p >= 0 and longest[p] + 1 == longest[known]:
            link[new] = known
        elif p >= 0:
            copy = len(link)
            link.append(link[known])
            longest.append(longest[p] + 1)
            word.append(word[known])
            target.append(target[known])
            if known in more:
                more[copy] = more[known].copy()
            link[known] = link[new] = copy
            while p >= 0:
                if word[p] == w:
                    if target[p] != known:
                        break
                    target[p] = copy
                elif p in more and more[p].get(w, -1) == known:
                    more[p][w] = copy
                else:
                    break
                p = link[p]
        states.append(new)
        last = new
    return link, longest, states


def periodic_runs(words: Sequence[int], exponent: int = 4, shortest: int = 6) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of a word sequence, by start, then period."""
    if exponent < 3 or shortest < 4:
        raise ValueError("runs of at least 3 periods and 4 words")
    link, longest, states = suffix_links(words)
    # a tree of trees: within a path, ``left`` is nearer the root of the links; above its top, ``up`` is the path's parent
    up, left, right = link, array("i", [-1]) * len(link), array("i", [-1]) * len(link)
    ended = array("i", [-1]) * len(link)  # of the root of each path's tree: where its strings last ended

    def splay(x: int) -> None:
        top = x
        while True:
            p = up[top]
            if p < 0 or (left[p] != top and right[p] != top):
                break
            top = p
        if top == x:
            return
        colour = ended[top]
        while True:
            p = up[x]
            if p < 0 or (left[p] != x and right[p] != x):
                break
            g = up[p]
            inner = g >= 0 and (left[g] == p or right[g] == p)
            turns = (p, x) if inner and (left[g] == p) == (left[p] == x) else (x, x) if inner else (x,)
            for node in turns:  # zig-zig turns the parent first
                q = up[node]
                above = up[q]
                if above >= 0:
                    if left[above] == q:
                        left[above] = node
                    elif right[above] == q:
                        right[above] = node
                if left[q] == node:
                    child = left[q] = right[node]
                    right[node] = q
                else:
                    child = right[q] = left[node]
                    left[node] = q
                if child >= 0:
                    up[child] = q
                up[q] = node
                up[node] = above
        ended[x] = colour

    found: dict[tuple[int, int], int] = {}
    for i, state in enumerate(states):
        x, below = state, -1
        while x >= 0:
            splay(x)
            colour, size = ended[x], longest[x]
            period = i - colour
            if colour >= 0 and size >= (exponent - 1) * period and size + period >= shortest:
                found[(colour - size + 1, period)] = i
            rest = right[x]
            if rest >= 0:
                ended[rest] = colour  # what hangs below the path keeps its end
            right[x] = below
            below, x = x, up[x]
        splay(state)
        ended[state] = i
    return sorted((start, end - start + 1, period) for (start, period), end in found.items())


def stretches(hashes: np.ndarray, per: np.ndarray, exponent: int, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the stretches of a block's words that could hold a run."""
    n = len(hashes)
    grams = gram_hashes(hashes, GRAM)
    text = np.repeat(np.arange(len(per)), per)
    order = np.argsort(grams, kind="stable")
    near = np.full(len(grams), FAR)
    same = (grams[order[1:]] == grams[order[:-1]]) & (text[order[1:]] == text[order[:-1]])
    step = np.where(same, order[1:] - order[:-1], FAR)
    near[order[1:]] = step
    near[order[:-1]] = np.minimum(near[order[:-1]], step)
    near[text[GRAM - 1:] != text[:len(grams)]] = FAR  # three words of two texts
    ends = np.cumsum(per)
    lo, hi = ends - per, ends
    while True:
        keep = hi - lo >= shortest
        lo, hi = lo[keep], hi[keep]
        if not len(lo):
            return lo, hi
        limit = np.zeros(n, np.int64)
        edge = np.zeros(n + 1, np.int64)
        np.add.at(edge, lo, (hi - lo) // exponent)
        np.add.at(edge, hi, -((hi - lo) // exponent))
        limit = np.cumsum(edge[:-1])
        good = near <= limit[:len(near)]
        cover = np.zeros(n + 1, np.int64)
        cover[:len(good)] += good
        cover[GRAM:GRAM + len(good)] -= good
        alive = (np.cumsum(cover[:-1]) > 0) & (limit > 0)
        # a stretch ends where words do not count, or where the last one ended
        opens, closes = alive.copy(), alive.copy()
        opens[1:] &= ~alive[:-1]
        closes[:-1] &= ~alive[1:]
        opens[lo] |= alive[lo]
        closes[hi - 1] |= alive[hi - 1]
        new_lo, new_hi = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        if len(new_lo) == len(lo) and (new_lo == lo).all() and (new_hi == hi).all():
            return lo, hi
        lo, hi = new_lo, new_hi


def runs_of_texts(texts: list[bytes], exponent: int = 4, shortest: int = 6) -> tuple[list[list[tuple[int, int, int]]], np.ndarray]:
    """Runs of each text, and its words."""
    buffer, at = joined(texts)
    s, e = word_spans(buffer, NOT_SPACE)
    per = words_per_text(at, s)
    runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    lo, hi = stretches(span_hashes(buffer, s, e), per, exponent, shortest)
    first = np.cumsum(per) - per
    for a, b, t in zip(lo.tolist(), hi.tolist(), (np.searchsorted(first, lo, "right") - 1).tolist()):
        data, start = buffer[s[a]:e[b - 1]].tobytes(), int(a - first[t])
        numbers: dict[bytes, int] = {}
        words = [numbers.setdefault(w, len(numbers)) for w in data.split()]
        runs[t] += [(start + x, length, period) for x, length, period in periodic_runs(words, exponent, shortest)]
    for found in runs:
        found.sort(key=lambda r: (r[0], r[2]))
    return runs, per


def collapsed(text: bytes, runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by one space; of each run only its first period stays."""
    words = text.split()
    if runs:
        drop = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            drop[start + period] += 1
            drop[start + length] -= 1
        words = [words[i] for i in np.flatnonzero(np.cumsum(drop[:-1]) == 0).tolist()]
    return b" ".join(words)


def find_periodic_runs(docs: DataFrame, text_col: str = "text", exponent: int = 4, shortest: int = 6) -> DataFrame:
    """One row per input row: ``row`` (its columns as they were), ``n_words``,
    ``runs`` (start, length and period in words, by start, then period) and
    ``text`` (the kept words, joined by one space)."""
    ship_package(docs.sparkSession)
    if exponent < 3 or shortest < 4:
        raise ValueError("runs of at least 3 periods and 4 words")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            texts = binary_column(batch.column("row").field(text_col)).to_pylist()
            known = [t or b"" for t in texts]
            for lo, hi in blocks(known):
                found, per = runs_of_texts(known[lo:hi], exponent, shortest)
                kept = [None if t is None else collapsed(t, r) for t, r in zip(texts[lo:hi], found)]
                yield pa.RecordBatch.from_arrays([
                    batch.column("row").slice(lo, hi - lo), pa.array(per, pa.int64()),
                    pa.array([[dict(zip(("start", "length", "period"), r)) for r in x] for x in found], kind),
                    pa.array(kept, pa.binary()).cast(pa.string()),
                ], ["row", "n_words", "runs", "text"])

    schema = T.StructType([
        T.StructField("row", T.StructType(docs.schema.fields)), T.StructField("n_words", T.LongType()),
        T.StructField("runs", T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))),
        T.StructField("text", T.StringType()),
    ])
    return docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row")).mapInArrow(run, schema)


def made_periodic(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, a tenth of them (by their id's CRC-32) with the end of the
    text replaced by repetitions of one part of it, as the contract of op13 says."""
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")
    words = docs.select("*", h.alias("__h"), g.alias("__g"), F.when(h % 10 == 0, F.regexp_extract_all(text_col, F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))).alias("__words"))
    n = F.when(F.size("__words") > 0, F.size("__words").cast("long"))
    words = words.select("*", (F.col("__g") % n).alias("__a"), n.alias("__n")).withColumn(
        "__p", 1 + F.floor((F.col("__n") - F.col("__a")) / (3 + F.col("__g") % 8)))
    part = lambda start, length: F.slice("__words", start.cast("int"), length.cast("int"))
    a, p, n = F.col("__a"), F.col("__p"), F.col("__n")
    unit = part(a + 1, F.least(p, n - a))
    tail = F.slice(F.flatten(F.array_repeat(unit, F.ceil((n - a) / p).cast("int"))), F.lit(1), (n - a).cast("int"))
    text = F.when(n > 0, F.array_join(F.concat(part(F.lit(1), a), tail), " ")).otherwise(F.col(text_col))
    return words.select(*(text.alias(c) if c == text_col else docs[f"`{c}`"] for c in docs.columns))


def query(spark, sf_dir: str) -> DataFrame:
    """op13: the runs of each document's words, and what is left without their repetitions."""
    found = find_periodic_runs(made_periodic(table(spark, sf_dir, "documents").select("doc_id", "text")))
    best = F.element_at(F.array_sort("runs", lambda x, y: F.when(x["length"] != y["length"], (y["length"] - x["length"]).cast("int")).when(
        x["start"] != y["start"], (x["start"] - y["start"]).cast("int")).otherwise((x["period"] - y["period"]).cast("int"))), 1)
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    lines = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    some = F.when(F.size("runs") > 0, best)
    return found.select(
        F.col("row.doc_id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), some["start"].alias("start"),
        some["length"].alias("length"), some["period"].alias("period"),
        F.floor(F.lit(1000) * some["length"] / some["period"]).cast("long").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("collapsed_sha256"))
