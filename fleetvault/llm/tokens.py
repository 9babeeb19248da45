"""Words of whole Arrow batches as numpy arrays: places, hashes and hashes of windows.

Everything works on the UTF-8 bytes of all texts of a batch at once, without a Python loop over
words. Hashes are the same in every task and on every machine.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
MIX_1 = np.uint64(0xBF58476D1CE4E5B9)
MIX_2 = np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    x = x ^ (x >> np.uint64(30))
    x = x * MIX_1
    x = x ^ (x >> np.uint64(27))
    x = x * MIX_2
    return x ^ (x >> np.uint64(31))


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * MULTIPLIER)


def _table(inside) -> np.ndarray:
    return np.array([inside(b) for b in range(256)], dtype=bool)


# Bytes that separate words. Every byte of a longer UTF-8 sequence is 128 or more.
WHITE = _table(lambda b: b == 0x20 or 0x09 <= b <= 0x0D)
NOT_ALNUM = _table(lambda b: b <= 0x2F or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F)


@dataclass
class Words:
    """Words of several texts; word i is data[starts[i]:ends[i]], those of text d are first[d]:first[d+1]."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def slices(batch: pa.RecordBatch | pa.Table, column: str, most_bytes: int) -> Iterator:
    """Consecutive rows whose texts have about ``most_bytes`` together; one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False)
    at = np.cumsum(sizes, dtype=np.int64)
    begin, rows = 0, batch.num_rows
    while begin < rows:
        end = int(np.searchsorted(at, (at[begin - 1] if begin else 0) + most_bytes, "right"))
        end = min(max(end, begin + 1), rows)
        yield batch.slice(begin, end - begin)
        begin = end


def cut(texts, separators: np.ndarray = WHITE, lower: bool = False) -> Words:
    """Words of a text column; a null has none. ``lower`` turns A-Z into a-z and nothing else."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    raw = [t or b"" for t in texts.cast(pa.large_binary()).to_pylist()]
    data = np.frombuffer(b" ".join([*raw, b""]) or b" ", dtype=np.uint8)
    if lower:
        data = data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)
    word = ~separators[data]
    edge = np.flatnonzero(np.diff(word.view(np.int8), prepend=np.int8(0)))
    starts, ends = edge[::2], edge[1::2]
    text_ends = np.cumsum([len(t) + 1 for t in raw], dtype=np.int64) if raw else np.zeros(0, np.int64)
    first = np.concatenate([[0], np.searchsorted(starts, text_ends, "left")]).astype(np.int64)
    return Words(data, starts, ends, first)


def hashes(words: Words) -> np.ndarray:
    """A 64-bit hash of the bytes of each word."""
    if not len(words.starts):
        return np.zeros(0, np.uint64)
    lengths = words.ends - words.starts
    powers = np.full(int(lengths.max()) + 1, MULTIPLIER, dtype=np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    inside = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    byte_at = inside + np.repeat(words.starts, lengths)
    terms = BYTE_VALUES[words.data[byte_at]] * powers[inside]
    sums = np.add.reduceat(terms, np.cumsum(lengths) - lengths)
    return mix(sums + lengths.astype(np.uint64) * MIX_1)


def window_starts(first: np.ndarray, width: int) -> np.ndarray:
    """Indices of the words at which ``width`` words of the same text begin."""
    counts = np.maximum(np.diff(first) - width + 1, 0)
    total = int(counts.sum())
    return np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(first[:-1], counts)


def rolling(values: np.ndarray, width: int, base: np.uint64 = MULTIPLIER) -> np.ndarray:
    """Rabin-Karp hash of every ``width`` consecutive values, modulo 2**64, then mixed."""
    count = len(values) - width + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(count, np.uint64)
    for step in range(width):
        total *= base
        total += values[step : step + count]
    return mix(total + np.uint64(width))


def pack(values: np.ndarray) -> bytes:
    """Compressed numbers: their bytes by place value, so that equal high bytes take no room."""
    planes = values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()
    return len(values).to_bytes(4, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def unpack(blob: bytes, kind) -> np.ndarray:
    count, size = int.from_bytes(blob[:4], "little"), np.dtype(kind).itemsize
    planes = pa.decompress(blob[4:], decompressed_size=count * size, codec="zstd", asbytes=True)
    return np.frombuffer(planes, np.uint8).reshape(size, count).T.copy().reshape(-1).view(kind)
