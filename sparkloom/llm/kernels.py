"""numpy kernels over Arrow batches: text buffers, word hashes, content-chosen anchors."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Fixed random tables; every executor must use the same.
_RNG = np.random.default_rng(20240607)
BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = int(_RNG.integers(2**40, 2**62)) * 2 + 1
INVERSE = pow(BASE, -1, 2**64)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def give_back() -> None:
    """Return freed memory to the system: idle workers share an executor's limit with its JVM."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library than glibc
        pass


def returning(run):
    """run over a task's batches, then give_back."""

    def trimmed(batches):
        yield from run(batches)
        give_back()

    return trimmed


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if len(_POWERS["up"]) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", BASE), ("down", INVERSE)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _POWERS[name] = np.cumprod(x, dtype=np.uint64)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def prefix(symbols: np.ndarray) -> np.ndarray:
    """Prefix sums whose differences hash any slice of symbols."""
    up, _ = powers(len(symbols) + 1)
    out = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum(symbols * up[: len(symbols)], out=out[1:])
    return out


def slices(p: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of symbols[start:end] from prefix sums, the same wherever the slice stands."""
    _, down = powers(len(p))
    return mix((p[end] - p[start]) * down[start] + (end - start).astype(np.uint64))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets of n + 1) of a string or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    n, (_, offsets, data) = len(column), column.buffers()
    if n == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def blocks(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges that hold at most limit symbols, or one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j
        i = j


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z as a-z."""
    up = (data >= 65) & (data <= 90)
    return np.where(up, data + 32, data).astype(np.uint8) if up.any() else data


def packed(data: np.ndarray, start: np.ndarray, size: np.ndarray, most: int, first: int = 0) -> list[np.ndarray]:
    """Bytes 8 * first, ... of each string, as `most` little-endian 64-bit words padded with zeros."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    view = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    out = []
    for i in range(first, first + most):
        left = size - 8 * i
        some = left > 0
        word = view[np.where(some, start + 8 * i, 0)]
        drop = np.clip(8 * (8 - left), 0, 63).astype(np.uint64)  # bits beyond the string's end
        out.append(np.where(some, (word << drop) >> drop, np.uint64(0)))
    return out


LONG_WORD = 64  # bytes from which a word is hashed by itself: the same function of the bytes for every copy


def word_hashes(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each string's bytes, not linear in them: eight bytes at a time, mixed after each step."""
    h = mix(size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x2545F4914F6CDD1D))
    todo = np.flatnonzero(size <= LONG_WORD)
    i = 0
    while len(todo):
        (word,) = packed(data, start[todo], size[todo], 1, i)
        h[todo] = mix(h[todo] ^ word) * np.uint64(0xBF58476D1CE4E5B9)
        i += 1
        todo = todo[size[todo] > 8 * i]
    for j in np.flatnonzero(size > LONG_WORD).tolist():
        h[j] = xxhash.xxh3_64_intdigest(data[start[j] : start[j] + size[j]].tobytes(), 7)
    return h


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, first byte, end byte, word offsets by row) of rows of UTF-8 bytes.

    Words are maximal runs of bytes other than space and 0x09 to 0x0D; they never cross rows.
    """
    n = len(data)
    inside = np.empty(n + 1, bool)
    inside[:n] = ~SPACE[data]
    inside[n] = False
    before = np.zeros(n + 1, bool)
    before[1:] = inside[:-1]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    start = np.flatnonzero(inside & (~before | edge))
    end = np.flatnonzero(before & (~inside | edge))
    hashes = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):  # in pieces that stay near the caches
        j = max(i + 1, int(np.searchsorted(end, start[i] + (1 << 19), "right")))
        lo = start[i]
        hashes[i:j] = word_hashes(data[lo : end[j - 1]], start[i:j] - lo, end[i:j] - start[i:j])
        i = j
    return hashes, start, end, np.searchsorted(start, offsets)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least of each w neighbours, by doubling."""
    step, out = 1, x
    while step * 2 <= w:
        out = np.minimum(out[:-step], out[step:])
        step *= 2
    rest = w - step
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def anchors(symbols: np.ndarray, offsets: np.ndarray, window: int, k: int, piece: int = 1 << 18) -> dict[str, np.ndarray]:
    """Content-chosen anchors of every window of `window` symbols.

    Each window owns the k-gram in it with the least hash (leftmost of equals), so equal
    windows own equal k-grams at equal places. Neighbouring windows with one anchor form a
    run. Per run: row, start (in its row), count (windows), off (anchor - start),
    h (hash of the k-gram), c (hash of the run's symbols, count and off).
    """
    out: list[tuple] = []
    w, mask = window - k + 1, np.uint64((1 << 22) - 1)
    pieces: list[tuple[int, int]] = []  # of neighbouring rows, or parts of a long row, overlapping by window - 1
    i, n = 0, len(offsets) - 1
    for lo, hi in blocks(offsets, piece):
        a, b = int(offsets[lo]), int(offsets[hi])
        while b - a > 2 * piece:
            pieces.append((a, a + piece + window - 1))
            a += piece
        pieces.append((a, b))
    for a, b in pieces:
        size = b - a
        if size < window:
            continue
        p = prefix(symbols[a:b])
        _, down = powers(size + 1)
        grams = mix((p[k:] - p[:-k]) * down[: size - k + 1])
        owner = (sliding_min((grams & ~mask) | np.arange(len(grams), dtype=np.uint64), w) & mask).astype(np.int64)
        first, last = int(np.searchsorted(offsets, a, "right")) - 1, int(np.searchsorted(offsets, b, "left"))
        ends = offsets[first + 1 : last + 1]
        starts = np.maximum(offsets[first:last], a)
        delta = np.zeros(size + 1, np.int64)
        good = np.minimum(ends, b) - window + 1 > starts
        np.add.at(delta, starts[good] - a, 1)
        np.add.at(delta, (np.minimum(ends, b) - window + 1)[good] - a, -1)
        at = np.flatnonzero(np.cumsum(delta[: len(owner)]))
        if not len(at):
            continue
        own = owner[at]
        cut = np.flatnonzero(np.concatenate(([True], (own[1:] != own[:-1]) | (at[1:] != at[:-1] + 1))))
        s, count, anchor = at[cut], np.diff(np.append(cut, len(at))), own[cut]
        row = np.searchsorted(offsets, s + a, "right") - 1
        c = mix(slices(p, s, s + count - 1 + window) + (anchor - s).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + count.astype(np.uint64))
        out.append((row, s + a - offsets[row], count, anchor - s, grams[anchor], c))
    names = ("row", "start", "count", "off", "h", "c")
    if not out:
        return {x: np.zeros(0, np.uint64 if x in "hc" else np.int64) for x in names}
    return {x: np.concatenate([y[i] for y in out]) for i, x in enumerate(names)}
