"""Words, shingles and rolling hashes of whole Arrow text columns, without a Python loop per word.

A slice of a text column is one byte buffer with offsets. A word is a maximal run of bytes other than
ASCII white space, so UTF-8 needs no decoding. Hashes are polynomials modulo 2**64, finished by a
mixing step; the same word gets the same value in every task."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = U(0x9E3779B97F4A7C15)
_POWERS: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64 bits (the published splitmix64 finisher)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int, base: np.uint64 = BASE) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _POWERS.get(int(base))
    if have is None or len(have) < n:
        size = max(n, 1 << 20)
        table = np.full(size, base, dtype=U)
        table[0] = 1
        have = _POWERS[int(base)] = np.cumprod(table, dtype=U)
    return have[:n]


INVERSE = U(pow(int(BASE), -1, 1 << 64))


@dataclass
class Texts:
    """Rows `at` .. `at + len(bounds) - 1` of a batch: their bytes, and where each row starts."""

    at: int
    data: np.ndarray
    bounds: np.ndarray

    def __len__(self) -> int:
        return len(self.bounds) - 1


def slices(column: pa.Array, most: int = 1 << 20) -> Iterator[Texts]:
    """Runs of rows of about `most` bytes; one longer text is a run of its own. A null is an empty text.
    Numbers made of each byte take some hundred times as much, and a worker keeps what it once took."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, dtype=np.uint8) if buffer is not None else np.empty(0, np.uint8)
    at, n = 0, len(column)
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
        to = min(n, max(to, at + 1))
        yield Texts(at, data[offsets[at] : offsets[to]], (offsets[at : to + 1] - offsets[at]).astype(np.int64))
        at = to


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data).astype(np.uint8)


_ALNUM = np.zeros(256, dtype=bool)
_ALNUM[48:58] = _ALNUM[65:91] = _ALNUM[97:123] = _ALNUM[128:] = True


def word_spans(data: np.ndarray, bounds: np.ndarray, alnum: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word; none crosses from one text into the next. With `alnum`, words are
    runs of ASCII letters and digits and of bytes beyond ASCII, so punctuation does not count."""
    word = _ALNUM[data] if alnum else ~((data == 32) | ((data >= 9) & (data <= 13)))
    if not len(word):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    start, end = word.copy(), word.copy()
    start[1:] &= ~word[:-1]
    end[:-1] &= ~word[1:]
    inner = bounds[1:-1]
    inner = inner[(inner > 0) & (inner < len(word))]
    start[inner] |= word[inner]
    end[inner - 1] |= word[inner - 1]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def prefix_sums(data: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(data) + 1, dtype=U)
    np.cumsum((data.astype(U) + U(1)) * powers(len(data)), dtype=U, out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hash of data[start:end], for many spans at once."""
    inverse = powers(len(sums), INVERSE)
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(U) * U(0xD6E8FEB86659FD93))


@dataclass
class Words:
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # index of each text's first word; one more entry than texts


def words(texts: Texts, lower: bool = True, alnum: bool = False) -> Words:
    data = lower_ascii(texts.data) if lower else texts.data
    start, end = word_spans(data, texts.bounds, alnum)
    hashes = span_hashes(prefix_sums(data), start, end)
    return Words(start, end, hashes, np.searchsorted(start, texts.bounds))


def grams(w: Words, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, index of first word) of every run of `n` words inside one text."""
    count = len(w.hash) - n + 1
    text_of = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
    if count <= 0:
        return np.empty(0, U), np.empty(0, np.int64), np.empty(0, np.int64)
    value = np.zeros(count, dtype=U)
    for k in range(n):
        value = value * U(0xC2B2AE3D27D4EB4F) + w.hash[k : k + count]
    same = text_of[:count] == text_of[n - 1 :]
    at = np.flatnonzero(same)
    return mix(value[at]), text_of[at], at


def longs(values: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(values).view(np.int64)


def lists(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """array<long> from flat values and the length of each row."""
    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
