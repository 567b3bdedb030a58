"""Words, windows and their hashes over whole Arrow text columns, in numpy.

Texts stay in the Arrow buffer; a word is a pair of byte positions. A word's
hash is a polynomial over random byte values, read off a running sum, so a
pass costs the same per byte whatever the length of texts or words. Batches
are worked off in slices of bounded bytes (a single longer text is a slice);
bytes are hashed in steps of one fixed size, also within a long text or word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19
STEP = 1 << 19  # bytes hashed at once
MASK = (1 << 64) - 1
GOLDEN = 0x9E3779B97F4A7C15
BASE = 0xD6E8FEB86659FD93  # odd, so it has an inverse modulo 2**64
WINDOW_BASES = (0xA0761D6478BD642F, 0xE7037ED1A0B428DB)


def keep_table(drop: list[tuple[int, int]]) -> np.ndarray:
    """Which bytes belong to words, from the ranges that do not."""
    table = np.ones(256, bool)
    for low, high in drop:
        table[low : high + 1] = False
    return table


#: Everything but blank and the five control characters that are white space.
NOT_SPACE = keep_table([(0x20, 0x20), (0x09, 0x0D)])
#: Digits, small letters and all beyond ASCII; capitals count as small letters.
ALNUM = keep_table([(0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _byte_values(lower: bool) -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(GOLDEN))
    if lower:
        values[65:91] = values[97:123]
    return values


BYTE_VALUES = {lower: _byte_values(lower) for lower in (False, True)}


def _powers(base: int, n: int) -> np.ndarray:
    """The first n powers of a base, by doubling."""
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), 1 << 64))])
    return out[:n]


UP, DOWN = _powers(BASE, STEP + 1), _powers(pow(BASE, -1, 1 << 64), STEP + 1)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; null is as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    if data is None or bounds[-1] == bounds[0]:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


@dataclass
class Words:
    """Words of the texts ``first`` to ``first + n_texts`` of a column."""

    data: np.ndarray  # the slice's bytes
    starts: np.ndarray  # of each word, in data
    ends: np.ndarray
    bounds: np.ndarray  # words before each text, and in all
    text_bounds: np.ndarray  # bytes before each text, and in all
    first: int
    hashes: np.ndarray  # uint64, of each word

    @property
    def n_texts(self) -> int:
        return len(self.bounds) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def text_of(self) -> np.ndarray:
        """The text (within the slice) of each word."""
        return np.repeat(np.arange(self.n_texts), self.counts)

    def windows(self, width: int, chains: int = 1, short: bool = False) -> tuple[np.ndarray, ...]:
        """Texts, first words and hashes of all windows of ``width`` words.

        ``short``: a text of fewer words, but not none, is one window.
        """
        n, counts = len(self.hashes), self.counts
        per_text = np.maximum(counts - width + 1, 0)
        if short:
            per_text = np.where((counts > 0) & (counts < width), 1, per_text)
        texts = np.repeat(np.arange(self.n_texts), per_text)
        before = np.cumsum(per_text) - per_text
        at = np.arange(len(texts)) - before[texts] + self.bounds[:-1][texts]
        length = np.minimum(counts[texts], width)
        hashes = []
        for base in WINDOW_BASES[:chains]:
            total = length.astype(np.uint64)
            for i in range(width):
                value = self.hashes[np.minimum(at + i, max(n - 1, 0))] * np.uint64(pow(base, i, 1 << 64))
                total += np.where(i < length, value, np.uint64(0)) if short else value
            hashes.append(mix(total))
        return texts, at, *hashes


def words_of(column: pa.Array, keep: np.ndarray, lower: bool, slice_bytes: int = SLICE_BYTES) -> Iterator[Words]:
    """All words of all texts, by slices of the column."""
    data, bounds = text_buffers(column)
    first, n = 0, len(bounds) - 1
    while first < n:
        last = int(np.searchsorted(bounds, bounds[first] + slice_bytes, "right")) - 1
        last = min(max(last, first + 1), n)
        yield _slice(data[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first], first, keep, lower)
        first = last


def _slice(data: np.ndarray, bounds: np.ndarray, first: int, keep: np.ndarray, lower: bool) -> Words:
    inside = keep[data]
    size = len(data)
    edges = bounds[1:-1]
    edges = edges[(edges > 0) & (edges < size)]  # texts end here though no separator stands between
    before = np.zeros(size, bool)
    before[1:] = inside[:-1]
    before[edges] = False
    after = np.zeros(size, bool)
    after[:-1] = inside[1:]
    after[edges - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    hashes = mix(_sums(data, starts, ends, BYTE_VALUES[lower]) + (ends - starts).astype(np.uint64))
    return Words(data, starts, ends, np.searchsorted(starts, bounds), bounds, first, hashes)


def _sums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Each word's polynomial, added up over the steps that it lies in."""
    out = np.zeros(len(starts), np.uint64)
    total = np.zeros(STEP + 1, np.uint64)
    for at in range(0, len(data), STEP):
        end = min(at + STEP, len(data))
        np.cumsum(values[data[at:end]] * UP[: end - at], out=total[1 : end - at + 1])
        low, high = int(np.searchsorted(ends, at, "right")), int(np.searchsorted(starts, end))
        a, b = np.maximum(starts[low:high], at) - at, np.minimum(ends[low:high], end) - at
        part = (total[b] - total[a]) * DOWN[a]
        if low < high and starts[low] < at:  # a word that began in an earlier step
            part[:1] *= np.uint64(pow(BASE, int(at - starts[low]), 1 << 64))
        out[low:high] += part
    return out


def join_words(words: Words, keep: np.ndarray) -> pa.Array:
    """The kept words of each text, joined by one blank."""
    kept = np.flatnonzero(keep)
    lengths = words.ends[kept] - words.starts[kept] + 1  # with a blank after it
    places = np.cumsum(lengths) - lengths
    size = int(lengths.sum())
    at = np.arange(size) + np.repeat(words.starts[kept] - places, lengths)
    blank = places + lengths - 1
    at[blank] = 0
    out = words.data[at] if size else np.zeros(0, np.uint8)
    out[blank] = 32
    ends = np.append(places, size)[np.searchsorted(kept, words.bounds)]
    counts = np.diff(np.searchsorted(kept, words.bounds))
    # the blank after a text's last word is not part of the text
    mask = np.ones(size, bool)
    last = ends[1:][counts > 0] - 1
    mask[last] = False
    trimmed = np.concatenate([[0], np.cumsum(np.diff(ends) - (counts > 0))]).astype(np.int64)
    return pa.Array.from_buffers(
        pa.large_string(), len(counts), [None, pa.py_buffer(trimmed), pa.py_buffer(np.ascontiguousarray(out[mask]))]
    )
