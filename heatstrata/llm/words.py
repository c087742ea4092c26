"""Words of many texts at once, as numpy arrays over the UTF-8 bytes of an Arrow column.

A word is a maximal run of bytes other than the six ASCII spaces (0x20, 0x09-0x0D). Words and word
windows get 64-bit hashes that are the same in every task and run.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes handled in one go; a longer text is handled alone.
CHUNK_BYTES = 1 << 18

_SPACES = np.zeros(256, bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Plain words for matching: separators are all ASCII signs other than letters and digits.
_SIGNS = np.ones(256, bool)
_SIGNS[128:] = False
for _first, _last in ((48, 57), (65, 90), (97, 122)):
    _SIGNS[_first : _last + 1] = False


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers; equal in, equal out."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BYTE_LOWER = _BYTE[_LOWER]


class _Powers:
    """Powers of an odd number and of its inverse modulo 2**64, longer when needed."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            half = len(self.up)
            with np.errstate(over="ignore"):
                self.up = np.concatenate([self.up, self.up * np.uint64(pow(self.base, half, 1 << 64))])
                self.down = np.concatenate([self.down, self.down * np.uint64(pow(self.inverse, half, 1 << 64))])
        return self.up[:n], self.down[:n]


_OF_BYTES = _Powers(0x9E3779B97F4A7C15)
_OF_WORDS = _Powers(0xD1B54A32D192ED03)


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and where each text starts (one more for the end). Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[starts[0] : starts[-1]], starts - starts[0]


def chunks(data: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of CHUNK_BYTES at most (or one longer text): first text, bytes, starts."""
    first, n = 0, len(starts) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(starts, starts[first] + CHUNK_BYTES, "right")) - 1)
        yield first, data[starts[first] : starts[last]], starts[first : last + 1] - starts[first]
        first = last


@dataclass
class Words:
    begin: np.ndarray  #: first byte of each word
    end: np.ndarray  #: byte after each word
    text_first: np.ndarray  #: first word of each text, one more for the end

    def counts(self) -> np.ndarray:
        return np.diff(self.text_first)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.text_first) - 1), self.counts())


def find_words(data: np.ndarray, starts: np.ndarray, plain: bool = False) -> Words:
    """plain: words of letters and digits only, else all that is between spaces."""
    n = len(data)
    inside = ~(_SIGNS if plain else _SPACES)[data]
    edge = np.zeros(n + 1, bool)
    edge[starts] = True  # no word goes over the end of its text
    edge[0] = edge[n] = True
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:n]
    ends[:-1] &= ~inside[1:] | edge[1:n]
    begin = np.flatnonzero(begins)
    return Words(begin, np.flatnonzero(ends) + 1, np.searchsorted(begin, starts))


def hash_words(data: np.ndarray, words: Words, lower: bool = False) -> np.ndarray:
    """lower: A-Z count as a-z."""
    up, down = _OF_BYTES.to(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((_BYTE_LOWER if lower else _BYTE)[data] * up[:-1], out=sums[1:])
        return mix((sums[words.end] - sums[words.begin]) * down[words.begin])


def hash_windows(hashes: np.ndarray, text_first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of each window of so many words inside one text."""
    counts = np.diff(text_first)
    left = np.repeat(text_first[1:], counts) - np.arange(len(hashes))
    begin = np.flatnonzero(left >= size)
    up, down = _OF_WORDS.to(len(hashes) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * up[:-1], out=sums[1:])
        return begin, mix((sums[begin + size] - sums[begin]) * down[begin] + np.uint64(size))


def hash_wholes(hashes: np.ndarray, text_first: np.ndarray) -> np.ndarray:
    """Hash of each text's whole word sequence, as of a window of that many words."""
    up, down = _OF_WORDS.to(len(hashes) + 1)
    begin, end = text_first[:-1], text_first[1:]
    with np.errstate(over="ignore"):
        sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * up[:-1], out=sums[1:])
        return mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64))


def ids(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Integer ids; a null id counts as the largest number."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.cast(pa.int64()).fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False), np.int64)


def hash_text(text: str, lower: bool = True, plain: bool = False) -> np.ndarray:
    """Word hashes of one text, for small tables such as word lists."""
    data = np.frombuffer(text.encode(), np.uint8)
    found = find_words(data, np.array([0, len(data)]), plain)
    return hash_words(data, found, lower)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 2000) -> Iterator[pa.RecordBatch]:
    """The batches in pieces, to bound what a task holds of them."""
    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            yield batch.slice(first, rows)
