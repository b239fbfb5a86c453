"""Words of Arrow text columns as NumPy arrays of 64-bit hashes, without a Python object a word.

A text column is cut into blocks of about two megabytes, so the arrays stay small however many or
long the texts are.  Words take arrays of some 90 bytes for each byte of a block, in every worker of an executor at once;
callers that gain nothing from long blocks take ``SMALL_BLOCK``.  A word's hash depends on its bytes alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

BLOCK = 1 << 21
SMALL_BLOCK = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_SPACES = np.isin(np.arange(256), [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_byte = np.arange(256)
# Word bytes by kind of word: anything but white space, or ASCII letters, digits and non-ASCII.
INSIDE = {
    "spaced": ~_SPACES,
    "plain": (_byte >= 0x80) | ((_byte >= 48) & (_byte <= 57)) | ((_byte >= 65) & (_byte <= 90)) | ((_byte >= 97) & (_byte <= 122)),
}
# Letters to one class for either case, digits to one; other bytes stand for themselves.
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[(_byte >= 97) & (_byte <= 122) | (_byte >= 0x80)] = ord("a")
_SHAPE[(_byte >= 65) & (_byte <= 90)] = ord("A")
_SHAPE[(_byte >= 48) & (_byte <= 57)] = ord("9")

u64 = np.uint64
_powers: dict[tuple[str, int], np.ndarray] = {}


def power(kind: str, block: int | None = None) -> np.ndarray:
    """Powers of the base, or of its inverse, for all places of a block."""
    block = block or BLOCK
    if (kind, block) not in _powers:
        steps = np.full(block + 1, _BASE if kind == "up" else pow(_BASE, -1, 1 << 64), u64)
        steps[0] = 1
        _powers[kind, block] = np.cumprod(steps)
    return _powers[kind, block]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = h ^ (h >> u64(32))
    h *= u64(0xD6E8FEB86659FD93)
    h ^= h >> u64(29)
    return h


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1 + column.offset)[column.offset :]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


def text_blocks(column: pa.Array, block: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, bytes and offsets (from 0) of consecutive rows of about ``block`` bytes, ``BLOCK`` if not given."""
    block = block or BLOCK
    if not len(column):
        return
    data, offsets = text_bytes(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + block, "right")) - 1)
        yield row, data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
        row = stop


class Words(NamedTuple):
    row: int  # first row of the block
    first: np.ndarray  # for each row of the block the index of its first word, and the end
    hash: np.ndarray
    begin: np.ndarray  # byte positions in the block
    end: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.first) - 1

    def owner(self) -> np.ndarray:
        """Row of each word, from 0 within the block."""
        return np.repeat(np.arange(self.rows), np.diff(self.first))


def _word_hash(data: np.ndarray, begin: np.ndarray, end: np.ndarray, block: int) -> np.ndarray:
    out = np.empty(len(begin), u64)
    up, down = power("up", block), power("down", block)
    at = 0
    while at < len(begin):
        low = begin[at]
        stop = max(at + 1, int(np.searchsorted(end, low + block, "right")))
        if end[at] - low > block:  # one word larger than a block
            total, scale = 0, 1
            for piece in range(low, end[at], block):
                part = data[piece : min(piece + block, end[at])]
                total += scale * int(((part.astype(u64) + u64(1)) * up[: len(part)]).sum())
                scale = scale * pow(_BASE, block, 1 << 64) % (1 << 64)
            out[at] = total % (1 << 64)
            at += 1
            continue
        part = data[low : end[stop - 1]]
        sums = np.zeros(len(part) + 1, u64)
        np.cumsum((part.astype(u64) + u64(1)) * up[: len(part)], out=sums[1:])
        b, e = begin[at:stop] - low, end[at:stop] - low
        out[at:stop] = (sums[e] - sums[b]) * down[b]
        at = stop
    return mix(out)


def _bounds(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each run of word bytes; no run crosses a text."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    edges = offsets[(offsets > 0) & (offsets < len(inside))]
    starts[edges] = inside[edges]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    ends[edges - 1] = inside[edges - 1]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def word_blocks(column: pa.Array, kind: str = "spaced", lower: bool = True, block: int | None = None) -> Iterator[Words]:
    for row, data, offsets in text_blocks(column, block):
        begin, end = _bounds(INSIDE[kind][data], offsets)
        hashes = _word_hash(_LOWER[data] if lower else data, begin, end, block or BLOCK)
        yield Words(row, np.searchsorted(begin, offsets), hashes, begin, end)


def shape_blocks(column: pa.Array, block: int | None = None) -> Iterator[Words]:
    """Like ``word_blocks``, but a word's hash is that of its shape, such as ``Aa9`` for ``Tower77``."""
    for row, data, offsets in text_blocks(column, block):
        inside = INSIDE["spaced"][data]
        begin, end = _bounds(inside, offsets)
        shape = _SHAPE[data]
        keep = inside.copy()
        keep[1:] &= (shape[1:] != shape[:-1]) | ~inside[:-1]
        keep[begin] = True
        place = np.zeros(len(data) + 1, np.int64)
        np.cumsum(keep, out=place[1:])
        hashes = _word_hash(shape[keep], place[begin], place[end], block or BLOCK)
        yield Words(row, np.searchsorted(begin, offsets), hashes, begin, end)


def ngrams(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``n`` words and the index of its first word; no run crosses a row."""
    count = len(words.hash) - n + 1
    if count <= 0:
        return np.zeros(0, u64), np.zeros(0, np.int64)
    last = np.repeat(words.first[1:], np.diff(words.first))  # end of each word's row
    at = np.flatnonzero(np.arange(count) + n <= last[:count])
    out = np.zeros(len(at), u64)
    for k in range(n):
        out = out * u64(0xC2B2AE3D27D4EB4F) + words.hash[at + k]
    return mix(out), at
