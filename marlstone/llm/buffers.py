"""Numpy views of Arrow text columns: texts of a batch lie end to end in one byte buffer.

All kernels work on such a buffer with the offsets of its texts, so that their cost does not depend
on how many texts there are. Batches are cut into pieces of bounded size; a text longer than the
bound is a piece of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1_000_000

_rng = np.random.default_rng(20240229)
#: Random odd multiplier and byte codes of the polynomial hash (mod 2^64).
_BASE = int(_rng.integers(1 << 62, 1 << 63)) | 1
_BACK = pow(_BASE, -1, 1 << 64)
BYTE_CODES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Finish a hash: every bit of the input sways every bit of the output."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        step = np.full(max(n, 1 << 16), _BASE if kind == "up" else _BACK, dtype=np.uint64)
        step[0] = 1
        have = _powers[kind] = np.cumprod(step, dtype=np.uint64)
    return have[:n]


class Polynomial:
    """Hashes of any slice of a sequence of 64-bit codes: sum of code[i] * base^(i - start)."""

    def __init__(self, codes: np.ndarray) -> None:
        self.sums = np.zeros(len(codes) + 1, dtype=np.uint64)
        np.cumsum(codes * _power("up", len(codes)), out=self.sums[1:], dtype=np.uint64)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        down = _power("down", len(self.sums))
        return mix((self.sums[end] - self.sums[start]) * down[start] + np.uint64(0x51) * (end - start).astype(np.uint64))


def _weights(n: int) -> np.ndarray:
    """A random number for every position, of any count."""
    have = _powers.get("weights")
    if have is None or len(have) < n:
        have = _powers["weights"] = mix(np.arange(1, max(n, 1 << 12) + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return have[:n]


def inner_places(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... inside each of the runs of these sizes, one run behind the other."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def runs_of_bytes(size: np.ndarray, most: int = PIECE_BYTES) -> Iterator[slice]:
    """Slices of neighbouring words with at most ``most`` bytes each, or one word. Places inside words
    are 64-bit numbers: what is made for every byte is many times the bytes."""
    last = np.cumsum(size)
    start, n = 0, len(size)
    while start < n:
        before = int(last[start] - size[start])
        end = max(start + 1, int(np.searchsorted(last, before + most, side="right")))
        yield slice(start, end)
        start = end


def word_codes(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit code of every word: its bytes' codes times random numbers by position, summed up.

    Unlike powers of one base, independent numbers leave no pair of unequal words of any length
    that the sum cannot tell apart, other than by chance.
    """
    sizes = ends - starts
    weights = _weights(int(sizes.max()) if len(sizes) else 0)
    codes = np.zeros(len(sizes), np.uint64)
    for run in runs_of_bytes(sizes):
        size = sizes[run]
        inner = inner_places(size)
        sums = np.zeros(len(inner) + 1, np.uint64)
        np.cumsum(BYTE_CODES[buffer[inner + np.repeat(starts[run], size)]] * weights[inner], out=sums[1:], dtype=np.uint64)
        last = np.cumsum(size)
        codes[run] = sums[last] - sums[last - size]
    return mix(codes + sizes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64 bits of a cryptographic hash of each slice of ``data``: equal only if the bytes are."""
    view = memoryview(np.ascontiguousarray(data))
    made = b"".join([hashlib.blake2b(view[a:b], digest_size=8).digest() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
    return np.frombuffer(made, np.uint64)


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than texts) of a string column; null texts are empty."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    n = len(column)
    _, where, data = column.buffers()
    if n == 0 or where is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(where, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    buffer = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if column.null_count:
        lengths = np.diff(offsets)
        empty = ~np.asarray(column.is_valid())
        if lengths[empty].any():
            return texts(pa.array(column.fill_null("").to_pylist(), pa.large_string()))
    return buffer[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batch: pa.RecordBatch, text: str = "text", most: int = PIECE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch with at most ``most`` bytes of text each (or one text), and their bytes."""
    _, offsets = texts(batch.column(text))
    start, n = 0, batch.num_rows
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1
        end = min(n, max(start + 1, end))
        part = batch.slice(start, end - start)
        yield part, *texts(part.column(text))
        start = end


_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True


def words(buffer: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word (run of bytes that are not ASCII white space), and the
    number of the first word of every text (one more than texts). Words never cross texts."""
    n = len(buffer)
    solid = np.zeros(n + 2, bool)
    solid[1:-1] = ~_BLANK[buffer]
    starts_here = solid[1:-1] & ~solid[:-2]
    ends_here = solid[1:-1] & ~solid[2:]
    inner = offsets[(offsets > 0) & (offsets < n)]
    starts_here[inner] = solid[1:-1][inner]
    ends_here[inner - 1] = solid[1:-1][inner - 1]
    starts, ends = np.flatnonzero(starts_here), np.flatnonzero(ends_here) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of every window of ``width`` values, by doubling."""
    have, out = 1, values
    while have * 2 <= width:
        out = np.minimum(out[:-have] if have < len(out) else out[:0], out[have:])
        have *= 2
    if have < width:
        rest = width - have
        out = np.minimum(out[:-rest] if rest < len(out) else out[:0], out[rest:])
    return out
