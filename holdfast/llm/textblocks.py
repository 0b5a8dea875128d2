"""Vectorised text work inside tasks: word spans, word hashes, rolling hashes.

Texts are handled as UTF-8 bytes in blocks of about a megabyte, so the
temporary arrays stay small whatever the size of a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

U64 = np.uint64
BLOCK_BYTES = 1 << 20

# byte classes: True where the byte belongs to a word
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
ALPHANUMERIC = np.zeros(256, bool)
ALPHANUMERIC[0x30:0x3A] = ALPHANUMERIC[0x41:0x5B] = ALPHANUMERIC[0x61:0x7B] = ALPHANUMERIC[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_CODES = np.random.default_rng(42).integers(1, 1 << 63, 256, dtype=np.uint64)
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64; kept up to a few blocks' length."""
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        known = np.full(max(n, BLOCK_BYTES + 4096), base, U64)
        known[0] = 1
        known = np.cumprod(known)
        if len(known) <= 4 * BLOCK_BYTES:
            _POWERS[base] = known
    return known[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that any bits of a hash can be used."""
    x = x ^ (x >> U64(32))
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


def binary_column(column: pa.Array) -> pa.Array:
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        return column
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())


def blocks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Row ranges of about BLOCK_BYTES each; a longer text is a range of its own."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > BLOCK_BYTES:
            yield start, i
            start, size = i, 0
        size += len(text) + 1
    if start < len(texts):
        yield start, len(texts)


def pieces(text: bytes, is_word: np.ndarray, size: int = BLOCK_BYTES) -> Iterator[bytes]:
    """The text in pieces of about ``size`` bytes that end between words; a longer word stays whole."""
    at = 0
    while len(text) - at > size:
        end, look = at, size
        while end == at and look < len(text) - at:
            gaps = np.flatnonzero(~is_word[np.frombuffer(text, np.uint8, look, at)])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
            look *= 2
        if end == at:
            break
        yield text[at:end]
        at = end
    yield text[at:]


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts with a line feed between them, and where each one starts."""
    buffer = np.frombuffer(b"\n".join(texts), np.uint8)
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    return buffer, np.cumsum(lengths) - lengths


def word_spans(buffer: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of word bytes."""
    if not len(buffer):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = is_word[buffer]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edges = np.concatenate(([0], edges))
    if inside[-1]:
        edges = np.concatenate((edges, [len(buffer)]))
    return edges[0::2], edges[1::2]


def words_per_text(text_starts: np.ndarray, word_starts: np.ndarray) -> np.ndarray:
    """How many of the words start in each text."""
    at = np.searchsorted(word_starts, text_starts)
    return np.diff(np.append(at, len(word_starts)))


LANES = 8  # words of up to 8 * LANES bytes are hashed together, longer ones one by one
_LANE = U64(0x9FB21C651E98DF25)
_SEED = 0x5851F42D4C957F2D


def span_hashes(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span's bytes.

    Eight bytes at a time go through a bijective mix, so strings that follow a
    pattern do not collide more than others, as they do under a polynomial modulo
    2^64. Equal hashes still are no proof of equal bytes: see ``same_bytes``.
    """
    size = (ends - starts).astype(np.int64)
    out = mix(size.astype(U64) ^ U64(_SEED))
    if not len(size):
        return out
    padded = np.concatenate((np.ascontiguousarray(buffer), np.zeros(8, np.uint8)))
    eight = np.ndarray(len(buffer) + 1, "<u8", padded, strides=(1,))  # the eight bytes from each place on
    short = np.flatnonzero(size <= 8 * LANES)
    for lane in range(LANES):
        short = short[size[short] > 8 * lane]
        if not len(short):
            break
        left = np.minimum(size[short] - 8 * lane, 8)
        value = eight[starts[short] + 8 * lane] & (U64(0xFFFFFFFFFFFFFFFF) >> (U64(64) - (left * 8).astype(U64)))
        out[short] = mix((out[short] ^ value) * _LANE + U64(lane + 1))
    for i in np.flatnonzero(size > 8 * LANES).tolist():
        out[i] = xxhash.xxh3_64_intdigest(buffer[starts[i]:ends[i]], seed=_SEED)
    return out


def same_bytes(left: np.ndarray, a: np.ndarray, right: np.ndarray, b: np.ndarray, size: np.ndarray, most: int = 8 << 20) -> np.ndarray:
    """Is left[a:a + size] equal to right[b:b + size], for each a, b and size?"""
    out = np.ones(len(size), bool)
    total = np.cumsum(size)
    i = 0
    while i < len(size):
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + most, "right")))
        some = np.flatnonzero(size[i:j]) + i
        if len(some) == 1:  # perhaps a very long one
            k = int(some[0])
            out[k] = np.array_equal(left[a[k]:a[k] + size[k]], right[b[k]:b[k] + size[k]])
        elif len(some):
            n = size[some]
            equal = left[ragged(a[some], n)] == right[ragged(b[some], n)]
            out[some] = np.logical_and.reduceat(equal, np.cumsum(n) - n)
        i = j
    return out


def rolling_hashes(buffer: np.ndarray, width: int) -> np.ndarray:
    """Hash of every ``width``-byte string of the buffer, at its start."""
    n = len(buffer) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.empty(n, U64)
    for lo in range(0, n, BLOCK_BYTES):
        hi = min(n, lo + BLOCK_BYTES)
        size = hi - lo + width - 1
        sums = np.zeros(size + 1, U64)
        np.cumsum(_BYTE_CODES[buffer[lo:lo + size]] * powers(_BASE, size), out=sums[1:])
        out[lo:hi] = (sums[width:] - sums[:-width]) * powers(_BASE_INVERSE, hi - lo)
    return mix(out)


def gram_hashes(symbols: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` symbols (64-bit word hashes)."""
    n = len(symbols) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = symbols[:n].copy()
    for k in range(1, width):
        out *= U64(_BASE)
        out += symbols[k:k + n]
    return mix(out)


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` consecutive values, by doubling."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    size = 1
    while size * 2 <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return np.minimum(values[:n], values[width - size:width - size + n]) if size < width else values


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices start, start+1, .. of every run, one run after the other."""
    total = int(lengths.sum())
    shift = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    return shift + np.arange(total)


class Vocabulary:
    """The words of a bounded reference; numbers them and finds runs of them.

    Words are looked up by hash and compared byte by byte.
    """

    BITS = 20  # of the bitmap that sets aside words the reference lacks

    def __init__(self, texts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        """``texts`` are (bytes, starts of words, ends of words)."""
        known: dict[bytes, int] = {}
        for buffer, starts, ends in texts:
            data = buffer.tobytes()
            for a, b in zip(starts.tolist(), ends.tolist()):
                known.setdefault(data[a:b], len(known))
        words = list(known)
        self.data = np.frombuffer(b"".join(words), np.uint8)
        size = np.fromiter(map(len, words), np.int64, len(words))
        start = np.cumsum(size) - size
        hashes = span_hashes(self.data, start, start + size)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.start, self.size = hashes[order], start[order], size[order]
        self.seen = np.zeros(1 << self.BITS, bool)
        self.seen[self.hashes >> U64(64 - self.BITS)] = True

    def numbers(self, buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Number of each word, -1 for a word the reference lacks."""
        hashes = span_hashes(buffer, starts, ends)
        out = np.full(len(hashes), -1, np.int64)
        maybe = np.flatnonzero(self.seen[hashes >> U64(64 - self.BITS)])
        at = np.searchsorted(self.hashes, hashes[maybe])
        while len(maybe):  # once, but for different words of the reference with one hash
            inside = at < len(self.hashes)
            maybe, at = maybe[inside], at[inside]
            alike = self.hashes[at] == hashes[maybe]
            maybe, at = maybe[alike], at[alike]
            size = (ends - starts)[maybe]
            found = size == self.size[at]
            found[found] = same_bytes(buffer, starts[maybe[found]], self.data, self.start[at[found]], size[found])
            out[maybe[found]] = at[found]
            maybe, at = maybe[~found], at[~found] + 1
        return out

    @staticmethod
    def runs(numbers: np.ndarray, per: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, start, end) of the runs of known words of at least ``least`` words inside a text."""
        first = np.cumsum(per) - per
        inside = np.concatenate(([0], (numbers >= 0).astype(np.int8), [0]))
        edge = np.diff(inside)
        a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        # a run ends where its text does
        cut = first[1:][(first[1:] > 0) & (first[1:] < len(numbers))]
        cut = np.unique(cut[(inside[cut] == 1) & (inside[cut + 1] == 1)])
        a, b = np.sort(np.append(a, cut)), np.sort(np.append(b, cut))
        keep = b - a >= least
        return np.searchsorted(first, a[keep], "right") - 1, a[keep], b[keep]
