"""Texts of an Arrow column as one byte array, and hashes of their words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes handled at once; the arrays made from them are some fifty times as large.
SLICE_BYTES = 2 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ODD = np.uint64(0x9E3779B97F4A7C15)
_VALUES = np.random.default_rng(20240501).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0xD1342543DE82EF95
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of a 64-bit value over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, bytes and offsets of runs of rows with about ``limit`` bytes; NULL is empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        own = offsets[first : last + 1]
        yield first, data[own[0] : own[-1]], own - own[0]
        first = last


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each run of bytes that aren't white space; none crosses rows."""
    n = data.size
    if not n:
        return (np.zeros(0, np.int64),) * 3
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = offsets[:-1][offsets[:-1] < n]
    first[begins] = inside[begins]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    ends = offsets[1:][offsets[1:] > 0] - 1
    last[ends] = inside[ends]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(offsets, starts, "right") - 1


def prefix_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running polynomial hash before each byte, and the factors that shift it to the start."""
    if not _powers or _powers[0].size <= data.size:
        size = max(data.size + 1, SLICE_BYTES + 1)
        with np.errstate(over="ignore"):
            both = [np.full(size, b, np.uint64) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
            for x in both:
                x[0] = 1
        _powers[:] = [np.cumprod(x, dtype=np.uint64) for x in both]
    up, down = _powers
    sums = np.zeros(data.size + 1, np.uint64)
    np.cumsum(_VALUES[data] * up[: data.size], out=sums[1:])
    return sums, down


def span_hashes(sums: np.ndarray, down: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of bytes, independent of where it stands."""
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _ODD)


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every word, A-Z lower-cased."""
    data = _LOWER[data] if lower else data
    starts, ends, rows = word_spans(data, offsets)
    return span_hashes(*prefix_hashes(data), starts, ends), rows


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each row's runs of ``size`` words; fewer words are one run."""
    words, rows = word_hashes(data, offsets)
    bounds = np.searchsorted(rows, np.arange(offsets.size))
    counts = np.diff(bounds)
    runs = mix(words[: max(words.size - size + 1, 0)])
    for k in range(1, size):
        runs = mix(runs * _ODD + words[k : k + runs.size])
    sets = []
    for a, n in zip(bounds[:-1].tolist(), counts.tolist()):
        if n >= size:
            sets.append(np.unique(runs[a : a + n - size + 1]))
        elif n:
            whole = mix(words[a : a + 1])
            for k in range(1, n):
                whole = mix(whole * _ODD + words[a + k : a + k + 1])
            sets.append(mix(whole + np.uint64(n)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets
