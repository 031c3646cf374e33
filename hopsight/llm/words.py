"""Hashes of words and word runs of Arrow text batches, by numpy over the UTF-8 bytes.

Separators are single bytes, so words can be told apart without decoding. A text longer than a
block is hashed block by block, cut at separators; what is held of it is 8 bytes a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=_U) * _BASE)
_ODD = _U(0xD1B54A32D192ED03)


def _places(n: int) -> np.ndarray:
    return mix(np.arange(n, dtype=_U) * _BASE + _ODD)


def _block(data: np.ndarray, begins: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word of `data`, in which texts begin at `begins`."""
    if lower:
        data = _LOWER[data]
    solid = ~_SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    begins = begins[begins < len(data)]
    first[begins] |= solid[begins]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.empty(0, _U), starts
    rest = data[starts[0]:]
    run = np.diff(starts, append=len(data))
    place = np.arange(len(rest)) - np.repeat(starts - starts[0], run)
    # each byte is mixed with its place before the sum: in a polynomial modulo 2 ^ 64 long regular words would meet
    values = _BYTE[rest] ^ _places(int(run.max()))[place]
    values *= _ODD
    values ^= values >> _U(32)
    values *= solid[starts[0]:]
    return mix(np.add.reduceat(values, starts - starts[0])), starts


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string column; null is as empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)), at


def hashed(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of the texts `data[offsets[i]:offsets[i + 1]]` in a row, and the word offsets (n + 1)."""
    hashes, starts, lo, end = [], [], int(offsets[0]), int(offsets[-1])
    while lo < end:
        hi = min(lo + BLOCK, end)
        while hi < end and not _SPACE[data[hi - 1:hi + BLOCK - 1]].any() and hi + BLOCK < end:
            hi += BLOCK
        if hi < end:
            hi += int(np.argmax(_SPACE[data[hi:hi + BLOCK]])) if _SPACE[data[hi:hi + BLOCK]].any() else end - hi
        inside = offsets[np.searchsorted(offsets, lo):np.searchsorted(offsets, hi)] - lo
        h, s = _block(data[lo:hi], inside, lower)
        hashes.append(h)
        starts.append(s + lo)
        lo = hi
    if not hashes:
        return np.empty(0, _U), np.zeros(len(offsets), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), offsets)


def runs(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each `n` words in a row; shorter by n - 1."""
    if len(words) < n:
        return np.empty(0, _U)
    step, power, done, out, last = 1, mix(np.full(1, n, _U)) | _U(1), 0, None, mix(words + _BASE)
    while True:  # hashes of 1, 2, 4, ... words, of which those in n are strung together
        if n & step:
            length = len(words) - n + 1
            part = last[done:done + length]
            out = part.copy() if out is None else out * power + part
            done += step
        if done == n:
            return mix(out)
        last = last[:-step] * power + last[step:]
        step, power = 2 * step, mix(power) | _U(1)


def pieces(batches: Iterator[pa.RecordBatch], text: str, size: int) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of about `size` bytes of text, one row at least."""
    for batch in batches:
        _, at = texts(batch.column(text))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + size, "right")) - 1)
            yield batch.slice(lo, hi - lo)
            lo = hi
