"""Words of whole Arrow columns as numpy arrays: blanks are found and words hashed for a whole batch at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 18
_rng = np.random.default_rng(20240517)
_BYTE_VALUES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
IS_BLANK = np.zeros(256, bool)
IS_BLANK[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit values; one to one."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chunks(texts: pa.Array | pa.ChunkedArray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, row offsets in them) for runs of rows of about `most` bytes; nulls are empty."""
    texts = pc.fill_null(texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts, "")
    texts = texts.cast(pa.large_string())
    n = len(texts)
    if not n:
        return
    _, offset_buffer, data_buffer = texts.buffers()
    offsets = np.frombuffer(offset_buffer, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data_buffer, np.uint8) if data_buffer is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        end = min(end, n)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _STEP, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Words:
    """The words of some rows: byte starts and ends, hashes, and for each row where its words begin and end."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        n = len(data)
        if lower:
            data = _LOWER[data]
        solid = ~IS_BLANK[data]
        begins = solid.copy()
        begins[1:] &= ~solid[:-1]
        inner = offsets[1:-1]
        inner = inner[(inner > 0) & (inner < n)]
        begins[inner] = solid[inner]
        ends = np.zeros(n, bool)
        if n:
            ends[:-1] = solid[:-1] & ~solid[1:]
            ends[-1] = solid[-1]
            ends[inner - 1] = solid[inner - 1]
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(ends) + 1
        lengths = self.ends - self.starts
        self.first = np.searchsorted(self.starts, offsets[:-1])
        self.last = np.searchsorted(self.starts, offsets[1:])
        if len(self.starts):
            within = self._within(n)
            within[~solid] = 0
            values = _BYTE_VALUES[data] * _powers(int(lengths.max()))[within]
            values[~solid] = 0
            self.hashes = mix(np.add.reduceat(values, self.starts) + lengths.astype(np.uint64) * _STEP)
        else:
            self.hashes = np.zeros(0, np.uint64)

    def _within(self, n: int) -> np.ndarray:
        place = np.zeros(n, np.int64)
        place[self.starts[0] :] = np.arange(self.starts[0], n) - np.repeat(
            self.starts, np.diff(np.append(self.starts, n))
        )
        return place


_PLACE = _rng.integers(0, 1 << 63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def runs(hashes: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """A hash for each run of k consecutive words. Each place of the run has a random factor of its own."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, mix(np.array([k * 65537 + salt], np.uint64))[0], np.uint64)
    for j in range(k):
        total += hashes[j : j + n] * _PLACE[j]
    return mix(total)
