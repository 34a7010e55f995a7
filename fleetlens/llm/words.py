"""Words and shingles of whole Arrow columns as numpy arrays.

A word is a run of bytes other than space and 0x09-0x0D. No byte of a multi-byte UTF-8
character is one of these, so working on bytes gives the words of the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
SHINGLE = 5
#: Bytes of text worked on at once; a longer text is worked on by itself.
SLICE = 1 << 20
KEPT_POWERS = SLICE + 1
#: Texts worked on at once, so that their numbers fit 16 bits.
SLICE_TEXTS = 1 << 15

_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[list(SPACES)] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_U = np.uint64


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (a bijection)."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(_BASE))
_PLACE = mix(np.arange(101, 101 + SHINGLE, dtype=np.uint64) * _U(_BASE)) | _U(1)


class _Powers:
    """Powers of the base and of its inverse modulo 2**64; those of a slice are kept, those of a long text are not."""

    up = np.ones(1, dtype=np.uint64)
    down = np.ones(1, dtype=np.uint64)

    @classmethod
    def first(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n <= KEPT_POWERS:
            cls.up, cls.down = cls._powers(KEPT_POWERS)
        up, down = cls._powers(n) if n > len(cls.up) else (cls.up, cls.down)
        return up[:n], down[:n]

    @staticmethod
    def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
        steps = np.full((2, n), [[_BASE], [_INVERSE]], dtype=np.uint64)
        steps[:, 0] = 1
        return tuple(np.cumprod(steps, axis=1))


@dataclass
class Words:
    """The words of some texts: place and length in the bytes, text number, and a 64-bit hash."""

    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    hash: np.ndarray
    n_texts: int

    def bounds(self) -> np.ndarray:
        """Place of each text's first word, and the number of words at the end."""
        return np.searchsorted(self.text, np.arange(self.n_texts + 1))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row, and where each begins. Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    _, offsets, data = column.buffers()
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array | pa.ChunkedArray, size: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, last text + 1, bytes, offsets) for runs of texts of about ``size`` bytes, ``SLICE_TEXTS`` at most."""
    data, offsets = utf8(column)
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1)
        last = min(last, first + SLICE_TEXTS)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def table_of(inside) -> np.ndarray:
    """A byte table for ``words``: which bytes words are made of."""
    return np.array([bool(inside(b)) for b in range(256)])


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True, table: np.ndarray = _IS_WORD) -> Words:
    """Words with the hash of their bytes, A-Z lower-cased first if ``lower``."""
    n = len(offsets) - 1
    if not len(data):
        none = np.empty(0, np.int64)
        return Words(none, none, none, np.empty(0, np.uint64), n)
    inside = table[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edge = offsets[:-1][offsets[:-1] < len(data)]
    begins[edge] |= inside[edge]
    ends = np.empty_like(inside)
    ends[:-1] = inside[:-1] & (~inside[1:] | begins[1:])
    ends[-1] = inside[-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    up, down = _Powers.first(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[_LOWER[data] if lower else data] * up, out=total[1:])
    h = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    return Words(start, end, np.searchsorted(offsets[1:], start, side="right"), h, n)


def spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of runs of bytes, A-Z lower-cased."""
    up, down = _Powers.first(max(1, len(data)))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[_LOWER[data]] * up[: len(data)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def shingles(w: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every shingle in order; a text with fewer words has one of all its words."""
    n = len(w.text)
    bounds = w.bounds()
    count = np.diff(bounds)
    if n >= size:
        h = np.zeros(n - size + 1, np.uint64)
        for i in range(size):
            h += w.hash[i : n - size + 1 + i] * _PLACE[i]
        whole = w.text[: n - size + 1] == w.text[size - 1 :]
        text, h = w.text[: n - size + 1][whole], h[whole]
    else:
        text, h = np.empty(0, np.int64), np.empty(0, np.uint64)
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        own = np.zeros(len(short), np.uint64)
        for i in range(size - 1):
            has = count[short] > i
            own[has] += w.hash[bounds[short][has] + i] * _PLACE[i]
        text = np.concatenate([text, short])
        h = np.concatenate([h, own + count[short].astype(np.uint64)])
        order = np.argsort(text, kind="stable")
        text, h = text[order], h[order]
    return text, mix(h)
