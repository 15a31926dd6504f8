"""Hashed word shingles of Arrow text, computed over whole pieces at once."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WIDTH = 5

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (splitmix finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x5851F42D4C957F2D


class _Unsent(dict):
    """A dictionary that goes to tasks empty: they fill their own, and no function carries what the driver has made."""

    def __reduce__(self):
        return dict, ()


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = _Unsent()
_STEP = mix(np.arange(1, WIDTH + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least ``size`` of each."""
    if not _POWERS or len(_POWERS[0][0]) < size:
        size = max(size, 1 << 20)
        inverse = pow(_BASE, -1, 1 << 64)
        found = []
        for base in (_BASE, inverse):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            found.append(np.cumprod(steps, dtype=np.uint64))
        _POWERS[0] = tuple(found)
    return _POWERS[0]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column and the offset of each row in them (one more than rows); nulls are empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of the rows, A-Z in lower case, and the index of each row's first word (one more than rows).

    A word is a run of bytes other than the six ASCII white spaces; no word reaches over a row's end.
    """
    if not len(data):
        return np.zeros(0, dtype=np.uint64), np.zeros(len(offsets), dtype=np.int64)
    inside = ~_SPACE[data]
    border = np.zeros(len(data) + 1, dtype=bool)
    border[offsets] = True
    before = np.r_[False, inside[:-1]] & ~border[:-1]
    after = np.r_[inside[1:], False] & ~border[1:]
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    power, inverse = powers(len(data))
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[_LOWER[data]] * power[:len(data)], out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * inverse[starts]
    return mix(hashes ^ (ends - starts).astype(np.uint64)), np.searchsorted(starts, offsets)


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """For each row its set of distinct shingle hashes in ascending order.

    A row of fewer than five words has its whole word sequence as one shingle; a row without words has none.
    """
    words, first = word_hashes(*text_bytes(column))
    whole = len(words) - WIDTH + 1
    runs = np.zeros(max(whole, 0), dtype=np.uint64)
    for k in range(WIDTH):
        if whole > 0:
            runs += words[k:k + whole] * _STEP[k]
    runs = mix(runs)
    for start, end in zip(first[:-1], first[1:]):
        if end - start >= WIDTH:
            yield np.unique(runs[start:end - WIDTH + 1])
        elif end > start:
            short = (words[start:end] * _STEP[:end - start]).sum(dtype=np.uint64) + np.uint64(end - start)
            yield mix(np.array([short], dtype=np.uint64) ^ _STEP[0])
        else:
            yield np.zeros(0, dtype=np.uint64)


def fingerprint(shingles: np.ndarray) -> int:
    """A signed 64-bit name of a set."""
    total = mix(shingles ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64) + np.uint64(len(shingles))
    return int(mix(np.array([total], dtype=np.uint64)).view(np.int64)[0])
