"""Vectorised text primitives on Arrow string buffers: words as spans, 64-bit span hashes, n-grams.

Texts are never turned into Python strings: all work is on the UTF-8 bytes of an
Arrow batch. Bytes of 0x80 and above belong to words in every alphabet used here.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

MASK = (1 << 64) - 1
#: Odd multiplier of the hashes.
BASE = 0x9E3779B97F4A7C15

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: `[^\x20\x09-\x0D]+`
NON_SPACE = ~SPACES
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of lower-cased text: digits, a-z, and all beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def offsets_of(array: pa.Array) -> np.ndarray:
    """Byte offsets of each string, from the slice's own start."""
    if pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type):
        kind = np.int64
    else:
        kind = np.int32
    buffer = array.buffers()[1]
    if buffer is None or len(array) == 0:
        return np.zeros(len(array) + 1, np.int64)
    return np.frombuffer(buffer, kind)[array.offset : array.offset + len(array) + 1].astype(np.int64)


def text_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all strings in a row, and n+1 offsets into them. Null strings are empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = array.fill_null("")
    offsets = offsets_of(array)
    data = array.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


class Spans:
    """Words of a batch: byte spans `start`, `end`, and `first[d]:first[d+1]` for document d."""

    __slots__ = ("data", "offsets", "start", "end", "first")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> None:
        n = len(data)
        word = inside[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True  # a document's first byte begins a word even if the byte before is in one
        begins = word.copy()
        ends = word.copy()
        if n:
            begins[1:] &= ~(word[:-1] & ~edge[1:n])
            ends[:-1] &= ~(word[1:] & ~edge[1:n])
        self.data, self.offsets = data, offsets
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: spreads every input bit over the output."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Masks of the first 0 to 8 bytes of a word in memory.
_FIRST = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
#: Longer spans are hashed one by one.
_LONG = 256


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span; equal bytes give equal hashes in any batch. Eight bytes at a time, without arrays by byte."""
    n = len(data)
    padded = np.empty(n + 8, np.uint8)
    padded[:n], padded[n:] = data, 0
    eight = np.ndarray((n + 1,), np.dtype("<u8"), padded, strides=(1,))  # the eight bytes from each place
    size = end - start
    out = mix((eight[start] & _FIRST[np.minimum(size, 8)]) * np.uint64(BASE) + size.astype(np.uint64))
    rows, at = np.flatnonzero(size > 8), 8
    while len(rows) and at < _LONG:
        block = eight[start[rows] + at] & _FIRST[np.minimum(size[rows] - at, 8)]
        out[rows] = mix((out[rows] ^ block) * np.uint64(BASE) + np.uint64(at))
        at += 8
        rows = rows[size[rows] > at]
    for row in rows.tolist():
        digest = hashlib.blake2b(data[start[row] : end[row]].tobytes(), digest_size=8).digest()
        out[row] = np.uint64(int.from_bytes(digest, "little"))
    return out


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive word hashes (of positions 0 to len - n)."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(m, n, np.uint64)
    for k in range(n):
        out = out * np.uint64(BASE) + words[k : k + m]
    return mix(out)


def shingle_sets(texts: pa.Array, n: int, inside: np.ndarray = NON_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-word shingle hashes of each lower-cased text, sorted, end to end; and n+1 bounds.

    A text of fewer than n words, but one at least, has its whole sequence as its only shingle.
    """
    data, offsets = text_bytes(texts)
    spans = Spans(lower_ascii(data), offsets, inside)
    hashes = span_hashes(spans.data, spans.start, spans.end)
    grams = ngram_hashes(hashes, n)
    parts, bounds = [], np.zeros(len(texts) + 1, np.int64)
    for d, (a, b) in enumerate(zip(spans.first[:-1].tolist(), spans.first[1:].tolist(), strict=True)):
        if b - a >= n:
            own = np.unique(grams[a : b - n + 1])
        elif b > a:
            own = ngram_hashes(hashes[a:b], b - a)
        else:
            own = grams[:0]
        parts.append(own)
        bounds[d + 1] = bounds[d] + len(own)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), bounds
