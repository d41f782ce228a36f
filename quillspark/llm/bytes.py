"""Vectorised work on the UTF-8 bytes of many texts at once: tokens, 64-bit hashes, shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at once; a longer single text is a chunk of its own.
CHUNK_BYTES = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def seeded(n: int, seed: int) -> np.ndarray:
    """n fixed 64-bit values: a splitmix64 sequence."""
    return mix64((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 20)) * np.uint64(0x9E3779B97F4A7C15))


BYTE_VALUE = seeded(256, 1)
BASE = 0xD6E8FEB86659FD93
BASE_INVERSE = pow(BASE, -1, 1 << 64)
STEP = seeded(64, 2) | np.uint64(1)


def powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def chunks(batch: pa.RecordBatch, column: int | str = "text") -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) of consecutive rows with about CHUNK_BYTES of text; offsets start at 0."""
    array = batch.column(batch.schema.get_field_index(column) if isinstance(column, str) else column)
    if array.null_count:
        array = pc.fill_null(array, "")
    array = array.cast(pa.large_string())
    if not len(array):
        return
    buffers = array.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64, count=len(array) + 1 + array.offset)[array.offset :]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    row = 0
    while row < len(array):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK_BYTES, side="right")) - 1)
        yield slice(row, end), data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes for which inside[] holds, cut at text ends: starts, ends, and the first run of each text."""
    flag = inside[data]
    start = flag.copy()
    start[1:] &= ~flag[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    start[first] = flag[first]
    end = flag.copy()
    end[:-1] &= ~flag[1:]
    last = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    end[last] = flag[last]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes: a polynomial of random byte values, from prefix sums, then mixed."""
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(BYTE_VALUE[data] * powers(len(data), BASE), out=sums[1:])
    inverse = powers(len(data) + 1, BASE_INVERSE)
    return mix64((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * STEP[63])


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (runs without ASCII white space, A-Z lower-cased) of a chunk, and the first word of each text."""
    data = LOWER[data]
    starts, ends, firsts = spans(data, offsets, ~IS_SPACE)
    return span_hashes(data, starts, ends), firsts


def window_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all windows of n consecutive words, across text ends too."""
    m = max(0, len(hashes) - n + 1)
    out = np.full(m, n, dtype=np.uint64) * STEP[62]
    for k in range(n):
        out += hashes[k : k + m] * STEP[k]
    return mix64(out)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """The sorted distinct n-word shingle hashes of each text.  Fewer words: the whole sequence is one; none: empty."""
    hashes, firsts = words(data, offsets)
    windows = window_hashes(hashes, n)
    out = []
    for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist()):
        if b - a >= n:
            out.append(np.unique(windows[a : b - n + 1]))
        elif b > a:
            out.append(window_hashes(hashes[a:b], b - a))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out
