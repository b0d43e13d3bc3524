"""Texts of an Arrow batch as flat numpy arrays: bytes, documents, words and 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once inside a task (a longer single text is its own block).
BLOCK_BYTES = 1 << 20

U64 = np.uint64
_STEP = U64(0x9E3779B97F4A7C15)          # odd, so it has an inverse modulo 2^64
_UNSTEP = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words, so that sums and products of hashes behave as random."""
    x = x ^ (x >> U64(32))
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty.  The bytes are those of Arrow, not a copy."""
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    buffers = column.buffers()
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(buffers[1], kind, n + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def blocks(data: np.ndarray, offsets: np.ndarray, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents that hold about `size` bytes each."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        last = min(last, n)
        yield first, last
        first = last


_powers = np.ones(1, U64), np.ones(1, U64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash step, and of its inverse."""
    global _powers
    if len(_powers[0]) < n:
        up, down = np.full(n, _STEP, U64), np.full(n, _UNSTEP, U64)
        up[0] = down[0] = 1
        _powers = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers[0][:n], _powers[1][:n]


def byte_table(fold: bool = True, seed: int = 7) -> np.ndarray:
    """Random 64-bit values of the 256 bytes; with `fold`, A-Z have those of a-z."""
    table = np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.int64).astype(U64)
    if fold:
        table[65:91] = table[97:123]
    return table


WHITE = np.zeros(256, bool)
WHITE[[32, *range(9, 14)]] = True

#: White space and ASCII punctuation but the apostrophe: what parts bare words.
PUNCTUATION = WHITE.copy()
PUNCTUATION[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'"]] = True

_FOLDED = byte_table()


@dataclass
class Words:
    """Words of some documents, in order: `start`, `end` in the bytes, `doc`, and `hash` (A-Z folded)."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray
    first: np.ndarray          # of each document (and one past the last) its first word
    prefixes: list[np.ndarray]  # hashes of the first bytes, for each length asked for


def words_of(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = WHITE, prefixes: tuple[int, ...] = ()) -> Words:
    """Maximal runs of bytes that are no separators, within each document."""
    n_docs = len(offsets) - 1
    if len(data) == 0:
        none = np.zeros(0, np.int64)
        return Words(none, none, none, none.astype(U64), np.zeros(n_docs + 1, np.int64), [none.astype(U64) for _ in prefixes])
    inside = ~separators[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    borders = offsets[1:-1]
    borders = borders[(borders > 0) & (borders < len(data))]
    begins[borders] = inside[borders]
    ends[borders - 1] = inside[borders - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum(_FOLDED[data] * up[:-1], out=sums[1:])

    def hash_until(stop: np.ndarray) -> np.ndarray:
        return mixed((sums[stop] - sums[start]) * down[start] + (stop - start).astype(U64))

    hashed = hash_until(end)
    first = np.searchsorted(start, offsets, "left")
    first[-1] = len(start)
    doc = np.repeat(np.arange(n_docs), np.diff(first))
    return Words(start, end, doc, hashed, first, [hash_until(np.minimum(start + k, end)) for k in prefixes])


def shingles_of(words: Words, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every run of `width` words; a shorter document's whole sequence counts as one."""
    counts = np.diff(words.first)
    total = np.zeros(len(words.hash), U64)
    n = len(words.hash)
    factors = mixed(np.arange(1, width + 1, dtype=U64))
    for j in range(min(width, n)):
        part = mixed(words.hash + factors[j])
        total[:n - j] += part[j:]
    per_doc = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    doc = np.repeat(np.arange(len(counts)), per_doc)
    place = np.arange(len(doc)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
    out = total[words.first[:-1][doc] + place]
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        at = np.searchsorted(doc, short)
        for d, i in zip(short, at):
            own = words.hash[words.first[d]:words.first[d + 1]]
            with np.errstate(over="ignore"):
                out[i] = (mixed(own + factors[:len(own)]).sum(dtype=U64) + U64(len(own))) * _STEP
    return doc, mixed(out)
