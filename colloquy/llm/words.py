"""Words of whole columns of texts as numpy arrays, without a Python object per word.

A word is a run of bytes other than 0x20 and 0x09-0x0D. Its key is a 64-bit hash of its
bytes with A-Z lower-cased, the same in every task and run.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SLICE = 1 << 20  # bytes hashed at once; bounds the arrays of 8 bytes per byte
_RANDOM = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finish of splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.empty(n, dtype=np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        out[1:] = base
        np.multiply.accumulate(out, out=out)
    return out


_POWERS: dict[str, np.ndarray] = {}


def _power(base: np.uint64, name: str, n: int) -> np.ndarray:
    if name not in _POWERS or len(_POWERS[name]) < n:
        _POWERS[name] = _powers(base, max(n, SLICE + 1))
    return _POWERS[name][:n]


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a column of strings or bytes, and where each row starts (one entry more than rows); a null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    if not len(texts):
        return raw[:0], np.zeros(1, np.int64)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """The words of a string column: `start`, `end` in `raw`, `first` word of each row (one entry more than rows)."""

    def __init__(self, texts: pa.Array):
        self.raw, self.offsets = flat(texts)
        raw, offsets = self.raw, self.offsets
        inside = ~_SPACE[raw]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        cuts = offsets[:-1][offsets[:-1] < len(raw)]
        begins[cuts] = inside[cuts]  # a row's first byte never continues the row before
        ends = inside.copy()
        ends[:-1] &= ~inside[1:]
        lasts = offsets[1:][offsets[1:] > 0] - 1
        ends[lasts] = inside[lasts]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), self.counts)

    def keys(self) -> np.ndarray:
        """A 64-bit key per word; equal words have equal keys, A-Z and a-z alike."""
        out = np.empty(len(self.start), dtype=np.uint64)
        at = 0
        while at < len(self.start):
            low = self.start[at]
            to = max(at + 1, int(np.searchsorted(self.end, low + SLICE, side="right")))
            part = self.raw[low : self.end[to - 1]]
            with np.errstate(over="ignore"):
                sums = np.empty(len(part) + 1, dtype=np.uint64)
                sums[0] = 0
                np.cumsum(_BYTE[part] * _power(_STEP, "step", len(part)), out=sums[1:])
                begin = self.start[at:to] - low
                span = sums[self.end[at:to] - low] - sums[begin]
                length = (self.end[at:to] - self.start[at:to]).astype(np.uint64)
                out[at:to] = mix(span * _power(_BACK, "back", len(part) + 1)[begin] + length * _BYTE[0])
            at = to
        return out


def shingles(keys: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `width` words, and the first run of each row.

    A row with fewer words, but one at least, has one run: the whole row.
    """
    counts = np.diff(first)
    runs = np.where(counts >= width, counts - width + 1, (counts > 0).astype(counts.dtype))
    start_of_run = np.concatenate([[0], np.cumsum(runs)])
    within = np.arange(start_of_run[-1]) - np.repeat(start_of_run[:-1], runs)
    begin = np.repeat(first[:-1], runs) + within
    size = np.repeat(np.minimum(counts, width), runs)
    total = np.zeros(len(begin), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            have = k < size
            at = np.where(have, begin + k, 0)
            term = mix(keys[at] + np.uint64(k + 1) * _BYTE[k]) if len(keys) else np.zeros(0, np.uint64)
            total += np.where(have, term, np.uint64(0))
        return mix(total + size.astype(np.uint64)), start_of_run


def by_bytes(batch: pa.RecordBatch, column: str, most: int = 2 << 20):
    """Cut a batch so that a piece holds about `most` bytes of `column`, one row at least."""
    texts = batch.column(column).cast(pa.large_binary()).fill_null(b"")
    sizes = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(sizes, sizes[at] + most, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to
