"""Vectorised text primitives for Arrow batches inside Spark tasks.

A block is a run of rows of one Arrow batch with about BLOCK_BYTES of UTF-8. All functions work on the
concatenated bytes of a block; rows never run into each other because the row bounds are always given.
Hashes are 64 bits, equal in every task: a byte string's hash is sum(T[b_i] * A**i) modulo 2**64 for a fixed
random table T, finished with an avalanche step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 19
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_TABLE = np.random.Generator(np.random.PCG64(20240101)).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i <= n; a worker keeps one block's length a base, longer ones are made anew."""
    have = _powers.get(base)
    if have is None or len(have[0]) <= n:
        made = []
        for b in (base, pow(base, -1, 1 << 64)):
            steps = np.full(max(n, BLOCK_BYTES) + 1, b, _U)
            steps[0] = 1
            made.append(np.cumprod(steps, dtype=_U))
        have = (made[0], made[1])
        if n <= BLOCK_BYTES:
            _powers[base] = have
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """Avalanche of 64-bit values (a bijection)."""
    h = h ^ (h >> _U(30))
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


def spans_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = _BASE) -> np.ndarray:
    """Hash of values[s:e] for each span; values are uint64."""
    power, inverse = _power(base, len(values))
    total = np.zeros(len(values) + 1, _U)
    np.cumsum(values * power[: len(values)], out=total[1:])
    h = (total[ends] - total[starts]) * inverse[starts]
    return mix(h ^ ((ends - starts).astype(_U) * _U(0xD6E8FEB86659FD93)))


def windows_hash(values: np.ndarray, size: int, base: int = 0xD1342543DE82EF95) -> np.ndarray:
    """Hash of each run of size consecutive values: sum(v[i + j] * base**j), put together from runs of powers of two."""
    n = len(values) - size + 1
    if n <= 0:
        return np.zeros(0, _U)
    total, part, width, done = np.zeros(n, _U), values, 1, 0
    for bit in range(size.bit_length()):
        if size >> bit & 1:
            total += part[done : done + n] * _U(pow(base, done, 1 << 64))
            done += width
        if size >> bit > 1:
            part = part[:-width] + part[width:] * _U(pow(base, width, 1 << 64))
            width *= 2
    return mix(total ^ _U(size * 0xD6E8FEB86659FD93 % (1 << 64)))


def byte_values(buf: np.ndarray) -> np.ndarray:
    return _TABLE[buf]


def word_spans(buf: np.ndarray, bounds: np.ndarray, white: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): the words of a block; the words of row r are first[r]:first[r + 1]."""
    n = len(buf)
    inside = ~white[buf]
    cut = np.zeros(n + 1, bool)
    cut[bounds] = True
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | cut[:n]))
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def text_blocks(texts: pa.Array | pa.ChunkedArray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(low, high, bytes, bounds) of runs of rows; null counts as empty. Every row is in one block, whole."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    low = 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(bounds, bounds[low] + limit, "right")) - 1)
        yield low, high, raw[bounds[low] : bounds[high]], bounds[low : high + 1] - bounds[low]
        low = high


def row_of(bounds: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """The row that holds each position (empty rows hold none)."""
    return np.searchsorted(bounds, positions, "right") - 1


def row_sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def repeated(keys: np.ndarray) -> np.ndarray:
    """Whether each key occurs twice or more."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = np.zeros(len(keys), bool)
    equal = ranked[1:] == ranked[:-1]
    same[1:] |= equal
    same[:-1] |= equal
    out = np.empty(len(keys), bool)
    out[order] = same
    return out


def covered(starts: np.ndarray, size: int | np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in some [start, start + size)."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.subtract.at(edge, starts + size, 1)
    return np.cumsum(edge[:n]) > 0
