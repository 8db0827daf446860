"""Vectorised 64-bit hashes of white-space words and word windows of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = 0xD6E8FEB86659FD93
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_POWERS = [np.ones(1, _U), np.ones(1, _U)]  # of the base and of its inverse


def mix(z: np.ndarray, seed: int = 0) -> np.ndarray:
    """splitmix64 finaliser."""
    z = z + _U((int(seed) * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> _U(27))) * _U(0x94D049BB133111EB)
    return z ^ (z >> _U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(1 << (n - 1).bit_length(), 1 << 19)
        for k, b in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, b, _U)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


def words(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts that lie end to end in ``data`` from ``starts`` (one more: the
    end): hash of every word, its text's number, its first and last+1 byte."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if not n:
        return np.zeros(0, _U), none, none, none
    solid = ~_IS_SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    at = starts[:-1][(starts[:-1] < n) & (np.diff(starts) > 0)]
    first[at] = solid[at]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    before = at[at > 0] - 1
    last[before] = solid[before]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    power, inverse = _powers(n)
    sums = np.concatenate([np.zeros(1, _U), np.cumsum((data.astype(_U) + _U(1)) * power, dtype=_U)])
    hashes = mix((sums[end] - sums[begin]) * inverse[begin] + (end - begin).astype(_U) * _U(_STEP))
    return hashes, np.searchsorted(starts, begin, side="right") - 1, begin, end


def windows(hashes: np.ndarray, text: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every window of ``size`` words inside one text, and the index of
    its first word.  The order of the words counts."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    inside = np.flatnonzero(text[:n] == text[size - 1:])
    out = np.zeros(len(inside), _U)
    for k in range(size):
        out = out * _U(_STEP) + hashes[inside + k]
    return mix(out, 1), inside


def blocks(texts: pa.Array, most: int = 1 << 19) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, starts) of runs of texts of about ``most``
    bytes each; a null is an empty text; a longer text is a block of its own.
    Hashing takes about 50 bytes for each byte of a block."""
    texts = texts.fill_null("").cast(pa.large_string()) if texts.null_count else texts.cast(pa.large_string())
    n = len(texts)
    if not n:
        return
    raw = texts.buffers()
    offsets = np.frombuffer(raw[1], np.int64, n + 1, texts.offset * 8)
    data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1)
        yield row, end, data[offsets[row]:offsets[end]], offsets[row:end + 1] - offsets[row]
        row = end
