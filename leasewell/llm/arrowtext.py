"""Vectorised text helpers for Arrow batches inside Spark tasks.

A batch of texts is one UTF-8 buffer with row offsets, so hashing words, shingles and byte windows is a
handful of numpy passes over the buffer and never a Python loop over characters.

Words are maximal runs of ASCII letters, digits, ``_`` and non-ASCII characters after lower-casing; Latin-1
signs (U+0080-00BF, U+00D7, U+00F7), general punctuation (U+2000-207F) and CJK punctuation (U+3000-303F)
separate words.  A shingle is five words in a row; a text of one to four words is one shingle, a text without
words has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words in a shingle, unless a caller asks for another width.
SHINGLE_WORDS = 5
#: Bytes of text handled at once in a task; a longer single text is a slice of its own.
SLICE_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)

_WORD = np.zeros(256, bool)
_WORD[[*range(ord("a"), ord("z") + 1), *range(ord("0"), ord("9") + 1), ord("_"), *range(0x80, 0x100)]] = True


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse, modulo 2**64."""
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, SLICE_BYTES + 1)
        _powers, _inverses = np.full(size, _BASE), np.full(size, _INVERSE)
        _powers[0] = _inverses[0] = 1
        _powers, _inverses = np.cumprod(_powers), np.cumprod(_inverses)
    return _powers[:n], _inverses[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit values (in place)."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Split a batch so that each piece has at most ``limit`` bytes of text, or one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total, begin = np.concatenate([[0], np.cumsum(sizes.astype(np.int64))]), 0
    while begin < len(sizes):
        end = max(begin + 1, int(np.searchsorted(total, total[begin] + limit, "right")) - 1)
        yield batch.slice(begin, end - begin)
        begin = end


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts or byte strings (null: empty) and the offset of each in them."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    if data is None or not len(texts):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial hash: one more entry than there are bytes."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data))[0], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each byte range; equal ranges have equal hashes wherever they are."""
    return mix((prefix[end] - prefix[begin]) * powers(len(prefix))[1][begin] + (end - begin).astype(np.uint64))


class Words:
    """The words of a slice of texts: hash, byte range, and the first word of each text."""

    def __init__(self, texts: pa.Array):
        self.data, offsets = utf8(pc.utf8_lower(pc.fill_null(texts, "").cast(pa.large_string())))
        b, n = self.data, len(self.data)
        inside = _WORD[b]
        if n and b.max() >= 0x80:
            after = np.append(b[1:], np.uint8(0))
            two = (b == 0xC2) | ((b == 0xC3) & ((after == 0x97) | (after == 0xB7)))
            three = ((b == 0xE2) & ((after == 0x80) | (after == 0x81))) | ((b == 0xE3) & (after == 0x80))
            for lead, length in ((two, 2), (three, 3)):
                at = np.flatnonzero(lead)
                for k in range(length):
                    inside[at + k] = False
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1] | edge[1:-1]
        last[:-1] &= ~inside[1:] | edge[1:-1]
        self.begin, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.hash = range_hash(prefix_hash(b), self.begin, self.end) if n else np.zeros(0, np.uint64)
        self.offsets = np.searchsorted(self.begin, offsets)

    def shingles(self, width: int = SHINGLE_WORDS, whole_short: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of ``width`` words and their offsets by text; a shorter text is one run of all it
        has, or none if not ``whole_short``."""
        h, begin = self.hash, self.offsets[:-1]
        n = np.diff(self.offsets)
        many = np.where(n >= width, n - width + 1, (n > 0) & whole_short)
        offsets = np.concatenate([[0], np.cumsum(many)])
        out = np.zeros(offsets[-1], np.uint64)
        if len(h) >= width:
            starts = np.repeat(begin - offsets[:-1], np.where(n >= width, many, 0)) + _runs(offsets[:-1], np.where(n >= width, many, 0))
            joined = _join([h[k : len(h) - width + 1 + k] for k in range(width)])
            out[_runs(offsets[:-1], np.where(n >= width, many, 0))] = joined[starts]
        if whole_short:
            for length in range(1, width):
                rows = np.flatnonzero(n == length)
                if len(rows):
                    out[offsets[rows]] = _join([h[begin[rows] + k] for k in range(length)])
        return out, offsets


def _runs(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """begin[0], begin[0]+1, ... for length[0] entries, then the same for the next."""
    total = np.cumsum(length)
    return np.repeat(begin - (total - length), length) + np.arange(total[-1] if len(total) else 0)


def _join(parts: list[np.ndarray]) -> np.ndarray:
    out = parts[0].copy()
    for part in parts[1:]:
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += part
    return mix(out)


def per_text(values: np.ndarray, offsets: np.ndarray, how: np.ufunc, empty: int) -> np.ndarray:
    """Reduce the values of each text; ``empty`` for a text without values."""
    out = np.full(len(offsets) - 1, empty, values.dtype)
    some = np.flatnonzero(np.diff(offsets))
    if len(some):
        out[some] = how.reduceat(values, offsets[some])
    return out
