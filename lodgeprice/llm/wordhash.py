"""Words of Arrow text columns as numpy arrays: positions and 64-bit hashes.

Works on the UTF-8 buffer of a whole batch at once; no Python string is made.
The hash of a word is a polynomial over its bytes modulo 2**64, taken from
prefix sums and then mixed; word windows are hashed in the same way over the
hashes of their words.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Bytes hashed in one go; bounds the size of the temporary arrays.
CHUNK = 1 << 20

BLANK = np.zeros(256, dtype=bool)
BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SAME = np.arange(256, dtype=np.uint8)

_powers: dict[str, np.ndarray] = {}


def _power(n: int, base: np.uint64, name: str) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        have = np.full(max(n, CHUNK + 1), base, dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if n <= CHUNK + 1:
            _powers[name] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Words:
    """Words of a batch: byte range and hash of each, and where each row's words begin."""

    data: np.ndarray  # bytes of the batch
    rows: np.ndarray  # byte offset of each row, one more at the end
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # index of each row's first word, one more at the end

    def __len__(self) -> int:
        return len(self.rows) - 1

    def row(self, i: int) -> np.ndarray:
        return self.hash[self.first[i]:self.first[i + 1]]


def buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row offsets from 0) of a string column; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(texts.buffers()[1], dtype=np.int64, count=n + 1, offset=8 * texts.offset)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[at[0]:at[-1]], at - at[0]


def split(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start and end of every word, and each row's first word."""
    inside = ~BLANK[data]
    begin, stop = inside.copy(), inside.copy()
    edge = rows[(rows > 0) & (rows < len(data))]
    if len(data):
        begin[1:] &= ~inside[:-1]
        begin[edge] = inside[edge]
        stop[:-1] &= ~inside[1:]
        stop[edge - 1] = inside[edge - 1]
    start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    return start, end, np.searchsorted(start, rows)


def hash_ranges(data: np.ndarray, start: np.ndarray, end: np.ndarray, table: np.ndarray = SAME) -> np.ndarray:
    """Hash of each byte range; ranges are in order and don't overlap."""
    out = np.empty(len(start), dtype=np.uint64)
    lo = 0
    while lo < len(start):
        hi = max(lo + 1, int(np.searchsorted(end, start[lo] + CHUNK, side="right")))
        s0 = int(start[lo])
        seg = table[data[s0:int(end[hi - 1])]].astype(np.uint64)
        seg += np.uint64(1)
        seg *= _power(len(seg), _BASE, "base")
        total = np.zeros(len(seg) + 1, dtype=np.uint64)
        np.cumsum(seg, out=total[1:])
        a, b = start[lo:hi] - s0, end[lo:hi] - s0
        out[lo:hi] = (total[b] - total[a]) * _power(len(seg), _INVERSE, "inverse")[a]
        lo = hi
    return mix(out)


def words(texts: pa.Array, lower: bool = False) -> Words:
    data, rows = buffer(texts)
    start, end, first = split(data, rows)
    return Words(data, rows, start, end, hash_ranges(data, start, end, LOWER if lower else SAME), first)


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` word hashes; entry i covers words i to i + n - 1."""
    if len(h) < n:
        return np.empty(0, dtype=np.uint64)
    out = np.empty(len(h) - n + 1, dtype=np.uint64)
    step = CHUNK // 4
    for lo in range(0, len(out), step):
        hi = min(lo + step, len(out))
        seg = h[lo:hi + n - 1] * _power(hi - lo + n - 1, _BASE, "base")
        total = np.zeros(len(seg) + 1, dtype=np.uint64)
        np.cumsum(seg, out=total[1:])
        m = hi - lo
        out[lo:hi] = (total[n:n + m] - total[:m]) * _power(m, _INVERSE, "inverse")
    return mix(out)


def parts(batch: pa.RecordBatch, column: str, most: int = 8 << 20):
    """Slices of a batch whose texts hold about ``most`` bytes; a longer text is a slice of its own."""
    texts = batch.column(batch.schema.get_field_index(column))
    if batch.num_rows == 0:
        return
    size = np.cumsum(np.array(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64))
    lo = 0
    while lo < batch.num_rows:
        base = size[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(size, base + most, side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi
