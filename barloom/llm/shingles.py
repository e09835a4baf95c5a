"""Word shingles of whole Arrow batches of texts, computed with NumPy.

Words are runs of ASCII digits, letters (A-Z lower-cased) and bytes of non-ASCII
code points. A shingle is SIZE consecutive words; a text with fewer words, but
not none, is one shingle. Hashes are 64 bit.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SIZE = 5
#: Bytes of text, about, whose working arrays are held at once.
STEP_BYTES = 1 << 18

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _byte_tables() -> tuple[np.ndarray, np.ndarray]:
    lower, is_word = np.arange(256, dtype=np.uint8), np.zeros(256, dtype=bool)
    lower[65:91] += 32
    for first, last in ((48, 57), (65, 90), (97, 122), (128, 255)):
        is_word[first : last + 1] = True
    return lower, is_word


LOWER, IS_WORD = _byte_tables()


def mix(z: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element by element."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


_KNOWN_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; those for a usual step are kept."""
    known = _KNOWN_POWERS.get(base)
    if known is None or len(known) < n:
        known = np.full(max(n, STEP_BYTES + (1 << 18)), base, dtype=np.uint64)
        known[0] = 1
        known = np.cumprod(known, dtype=np.uint64)
        if n <= STEP_BYTES + (1 << 18):
            _KNOWN_POWERS[base] = known
    return known[:n]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its texts; a null is empty."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def small_batches(batches, column: str = "text"):
    """The rows of Arrow batches in batches of about STEP_BYTES of text, one row at least."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if held and held + n > STEP_BYTES:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n + 1
        if start < batch.num_rows:
            yield batch.slice(start)


@lru_cache(maxsize=1)
def _separators() -> np.ndarray:
    """By code point, whether it is neither letter, mark nor number."""
    return np.array([unicodedata.category(chr(c))[0] not in "LMN" for c in range(0x110000)])


def word_bytes(data: np.ndarray) -> np.ndarray:
    """Which bytes are of words that also end at non-ASCII punctuation, symbols and spaces."""
    out = IS_WORD[data]
    lead = np.flatnonzero(data >= 0xC2)
    if not len(lead):
        return out
    first = data[lead].astype(np.int32)
    size = 2 + (first >= 0xE0) + (first >= 0xF0)
    point = first & (0x7F >> size)
    for k in range(1, 4):
        more = size > k
        point[more] = point[more] << 6 | data[np.minimum(lead[more] + k, len(data) - 1)] & 0x3F
    apart = _separators()[np.minimum(point, 0x10FFFF)]
    lead, size = lead[apart], size[apart]
    for k in range(4):
        out[np.minimum(lead[size > k] + k, len(data) - 1)] = False
    return out


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start and end of every word, and the index of each text's first word (one more at the end); is_word: the bytes of words, if others than by IS_WORD."""
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = IS_WORD[data] if is_word is None else is_word
    begins = inside[1:-1] & ~inside[:-2]
    ends = inside[1:-1] & ~inside[2:]
    edges = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]
    # A text's border also ends a word.
    begins[edges] = inside[1 + edges]
    ends[edges - 1] = inside[edges]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return starts, stops, np.searchsorted(starts, offsets)


class WordHashes:
    """64-bit hashes of lower-cased stretches of bytes: differences of one running polynomial, made once for all of them."""

    def __init__(self, data: np.ndarray):
        with np.errstate(over="ignore"):
            self.run = np.zeros(len(data) + 1, np.uint64)
            np.cumsum((LOWER[data].astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(data)), dtype=np.uint64, out=self.run[1:])
        self.back = _powers(_INVERSE, len(data))

    def __call__(self, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.run[stops] - self.run[starts]) * self.back[starts] + (stops - starts).astype(np.uint64))


def word_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    return WordHashes(data)(starts, stops) if len(starts) else np.zeros(0, np.uint64)


def shingle_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles in text order, and the index of each text's first shingle (one more at the end)."""
    data, offsets = text_bytes(column)
    starts, stops, first = words(data, offsets)
    hashes = word_hashes(data, starts, stops)
    counts = np.diff(first)
    n = np.where(counts >= SIZE, counts - SIZE + 1, np.minimum(counts, 1))
    bounds = np.zeros(len(n) + 1, np.int64)
    np.cumsum(n, out=bounds[1:])
    at = np.repeat(first[:-1] - bounds[:-1], n) + np.arange(bounds[-1])
    width = np.repeat(np.minimum(counts, SIZE), n)
    out = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(SIZE):
            has = width > k
            out[has] = out[has] * np.uint64(0xD6E8FEB86659FD93) + hashes[at[has] + k]
        return mix(out + width.astype(np.uint64)), bounds
