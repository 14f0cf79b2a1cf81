"""Columnar text kernels: word boundaries and hashes straight from Arrow buffers.

Everything here works on the UTF-8 bytes of a whole Arrow string column at
once.  A *word* is ``[^\\x20\\x09-\\x0D]+``; the separators are ASCII, so the
byte view and the character view agree.  Callers feed at most a few megabytes
at a time (`slices`) because the intermediates hold eight bytes a character;
a single longer text is still taken whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20

#: True for the bytes that separate words.
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: A-Z to a-z, all else as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_MULT = np.uint64(0x9E3779B97F4A7C15)
#: Rounds of eight bytes; what is left of longer words is hashed one by one.
_DEPTH = 8
_BASE = 0x2545F4914F6CDD1D
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the odd base and of its inverse, modulo 2**64."""
    if len(_powers["up"]) < n:
        size = 1 << (n - 1).bit_length()
        inverse = pow(_BASE, -1, 1 << 64)
        for name, base in (("up", _BASE), ("down", inverse)):
            step = np.full(size, base, np.uint64)
            step[0] = 1
            _powers[name] = np.cumprod(step, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


#: Keeps the first k of eight bytes, k from 0 to 8.
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser for 64-bit hashes."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Row slices of about `limit` bytes of text each, one row at least."""
    i = batch.schema.get_field_index(column)
    if batch.num_rows == 0:
        return
    _, offsets = buffer(batch.column(i))
    start, n = 0, batch.num_rows
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        end = min(n, max(end, start + 1))
        yield batch.slice(start, end - start)
        start = end


def buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


class Words:
    """The words of a column of texts.

    ``start``/``end`` are byte offsets of each word in ``data``; words of text
    i are numbers ``first[i]`` to ``first[i + 1]``.
    """

    def __init__(self, column: pa.Array, lower: bool = False):
        self.data, self.offsets = buffer(column)
        if lower:
            self.data = LOWER[self.data]
        n = len(self.data)
        inside = ~SEPARATOR[self.data]
        edge = np.zeros(n + 1, bool)  # a word starts or ends before this byte
        if n:
            edge[0], edge[n] = inside[0], inside[-1]
            edge[1:n] = inside[1:] != inside[:-1]
            # texts that meet without a separator
            cut = self.offsets[1:-1]
            cut = cut[(cut > 0) & (cut < n)]
            cut = cut[inside[np.minimum(cut, n - 1)] & inside[cut - 1]]
        else:
            cut = np.zeros(0, np.int64)
        at = np.flatnonzero(edge)
        if len(cut):
            cut = np.unique(cut)
            at = np.sort(np.concatenate([at, cut, cut]))
        self.start, self.end = at[::2], at[1::2]
        self.first = np.searchsorted(self.start, self.offsets)

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        """For each word, the number of its text."""
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes, eight bytes at a time."""
        size = self.end - self.start
        n = len(size)
        h = (size.astype(np.uint64) + np.uint64(1)) * _MULT
        if not n:
            return h
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        eight = np.ndarray((len(self.data) + 1,), "<u8", padded, strides=(1,))
        left, at, rest, depth = None, self.start, size, 0
        while True:
            part = eight[at] & _MASKS[np.minimum(rest, 8)]
            if left is None:
                h = mix(h ^ part)
            else:
                h[left] = mix(h[left] ^ part)
            more = np.flatnonzero(rest > 8)
            if not len(more):
                return h
            left = more if left is None else left[more]
            at, rest, depth = at[more] + 8, rest[more] - 8, depth + 1
            if depth == _DEPTH:
                break
        for i, a, r in zip(left.tolist(), at.tolist(), rest.tolist(), strict=True):
            tail = hashlib.blake2b(self.data[a : a + r], digest_size=8).digest()
            h[i] = mix(h[i : i + 1] ^ np.frombuffer(tail, "<u8"))[0]
        return h

    def grams(self, h: np.ndarray, k: int) -> np.ndarray:
        """Hash of the k words from each word on; runs past a text's end are the caller's to mask."""
        n = len(h)
        if n < k:
            return np.zeros(0, np.uint64)
        up, down = _power(n)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(h * up, out=total[1:])
        return mix((total[k:] - total[:-k]) * down[: n - k + 1])
