"""Periodic runs within documents (operator 11): suffix automaton, end-position sets merged small to large.

A run is a stretch of consecutive words with smallest period q, at least `min_length` words and
`min_exponent * q` words long, that no neighbouring word extends keeping period q. Each text is worked
on by itself, so the job needs no shuffle.

1. In a run every k-gram, k = min_length * (1 - 2 / min_exponent), occurs twice at least (q words apart,
   within the run). Words outside all repeated k-grams of their document thus lie in no run and touch
   none; the stretches between them are looked at one by one. Here hashes only let too much through.
2. The suffix automaton of a stretch (words as exact numbers) is built word by word. In the order of
   falling length the ordered sets of end positions are merged along suffix links, the smaller into the
   larger. End positions that become neighbours at distance d in a state of length s have just s words
   before them in common, so if d <= s they end a square of period d whose left end is the run's.
3. Seeds of one period and start are taken together, extended to the right, and of equal stretches the
   least period stays.

Results, one row per row of the table: null or blank texts have no words and no runs; repeated rows and rows without
an id are worked on alike; other columns are ignored. Memory is bounded by one text (about 100 bytes a
word of its repetitive stretches) and 1 MB of others.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sparkloom.llm import kernels as K

PIECE = 1 << 20  # bytes of text that are tokenized at once
RUNS = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed binary"


class Ordered:
    """A sorted set of integers in blocks, so that an insertion moves at most a block."""

    __slots__ = ("blocks", "tops", "size")
    BLOCK = 1024

    def __init__(self, value: int):
        self.blocks, self.tops, self.size = [[value]], [value], 1

    def insert(self, value: int) -> tuple[int, int]:
        """Put value in; its neighbours, -1 where there is none."""
        at = min(bisect_left(self.tops, value), len(self.tops) - 1) if len(self.tops) > 1 else 0
        block = self.blocks[at]
        i = bisect_left(block, value)
        before = block[i - 1] if i else (self.tops[at - 1] if at else -1)
        after = block[i] if i < len(block) else -1
        block.insert(i, value)
        self.tops[at] = block[-1]
        self.size += 1
        if len(block) > self.BLOCK:
            half = len(block) // 2
            self.blocks[at : at + 1] = [block[:half], block[half:]]
            self.tops[at : at + 1] = [block[half - 1], block[-1]]
        return before, after

    def __iter__(self):
        for block in self.blocks:
            yield from block


class Automaton:
    """The suffix automaton of a sequence of numbers; most states have one transition, kept in two lists."""

    def __init__(self, symbols: list[int]):
        self.length, self.link, self.end = [0], [-1], [-1]
        self.by, self.to, self.more = [-1], [-1], {}
        last = 0
        for place, c in enumerate(symbols):
            last = self._extend(last, place, c)

    def _state(self, length: int, end: int) -> int:
        self.length.append(length)
        self.link.append(0)
        self.end.append(end)
        self.by.append(-1)
        self.to.append(-1)
        return len(self.length) - 1

    def _next(self, p: int, c: int) -> int:
        if self.by[p] == c:
            return self.to[p]
        more = self.more.get(p)
        return -1 if more is None else more.get(c, -1)

    def _set(self, p: int, c: int, q: int) -> None:
        if self.by[p] in (-1, c):
            self.by[p], self.to[p] = c, q
        else:
            self.more.setdefault(p, {})[c] = q

    def _extend(self, last: int, place: int, c: int) -> int:
        new = self._state(self.length[last] + 1, place)
        p = last
        while p != -1 and (q := self._next(p, c)) == -1:
            self._set(p, c, new)
            p = self.link[p]
        if p == -1:
            return new
        if self.length[p] + 1 == self.length[q]:
            self.link[new] = q
            return new
        twin = self._state(self.length[p] + 1, -1)  # holds no prefix of its own
        self.by[twin], self.to[twin] = self.by[q], self.to[q]
        if q in self.more:
            self.more[twin] = dict(self.more[q])
        self.link[twin] = self.link[q]
        while p != -1 and self._next(p, c) == q:
            self._set(p, c, twin)
            p = self.link[p]
        self.link[q] = self.link[new] = twin
        return new


def seeds(symbols: list[int]) -> dict[tuple[int, int], int]:
    """(start, period) -> end of squares, every run's own period and start among them."""
    found: dict[tuple[int, int], int] = {}
    auto = Automaton(symbols)
    length, link, end = auto.length, auto.link, auto.end
    order = np.argsort(-np.array(length[1:], np.int64), kind="stable") + 1  # the root is left out
    del auto
    held: list[Ordered | None] = [None if e < 0 else Ordered(e) for e in end]

    def seed(left: int, right: int, size: int) -> None:
        if left >= 0 and right - left <= size:
            key = (left - size + 1, right - left)
            if found.get(key, -1) < right:
                found[key] = right

    for state in order.tolist():
        own, held[state] = held[state], None
        above = link[state]
        if above == 0:  # no word in common
            continue
        other = held[above]
        if other is None:
            held[above] = own
            continue
        if own.size > other.size:
            own, other = other, own
        size, put = length[above], -1
        for e in own:
            before, after = other.insert(e)
            if before != put:  # else both have been neighbours in a longer state
                seed(before, e, size)
            if after >= 0:
                seed(e, after, size)
            put = e
        held[above] = other
    return found


def runs_of(symbols: list[int], min_length: int = 24, min_exponent: int = 3) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence, by start and period."""
    found: dict[tuple[int, int], int] = {}
    here: list[tuple[int, int]] = []  # runs of the present start: period, end
    at = -1
    n = len(symbols)
    for (start, period), end in sorted(seeds(symbols).items()):
        if start != at:
            at, here = start, []
        if any(period % p == 0 and end <= e for p, e in here):  # a power of a shorter period
            continue
        while end + 1 < n and symbols[end + 1] == symbols[end + 1 - period]:
            end += 1
        here.append((period, end))
        if end - start + 1 >= max(min_length, min_exponent * period):
            found.setdefault((start, end), period)
    return sorted((s, e - s + 1, p) for (s, e), p in found.items())


def stretches(hashes: np.ndarray, at: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, end) of stretches of at least `least` words under repeated k-grams of their row; at: word offsets by row."""
    n = len(hashes)
    none = np.zeros(0, np.int64)
    if n < k:
        return none, none
    p = K.prefix(hashes)
    s = np.arange(n - k + 1)
    row = np.searchsorted(at, s, "right") - 1
    s = s[s + k <= at[row + 1]]
    row = np.searchsorted(at, s, "right") - 1
    key = K.mix(K.slices(p, s, s + k) ^ K.mix(row.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(s), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    s = s[twice]
    under = np.zeros(n + 1, np.int64)
    np.add.at(under, s, 1)
    np.add.at(under, s + k, -1)
    under = np.append(np.cumsum(under[:n]) > 0, False)
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    before = np.append(False, under[:-1])
    first = np.flatnonzero(under & (~before | edge))
    end = np.flatnonzero(before & (~under | edge))
    long = end - first >= least
    return first[long], end[long]


def joined(data: np.ndarray, start: np.ndarray, end: np.ndarray, at: np.ndarray, kept: np.ndarray) -> pa.Array:
    """Kept words of each row, joined by one space."""
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))[kept]
    s, size = start[kept], (end - start)[kept] + 1
    place = np.append(0, np.cumsum(size))
    out = np.append(data, np.uint8(32))[np.repeat(s - place[:-1], size) + np.arange(place[-1])]
    out[place[1:] - 1] = 32
    edge = place[np.searchsorted(row, np.arange(len(at)))]
    filled = np.diff(edge) > 0  # the last space of each row goes
    last = edge[1:][filled] - 1
    out = np.delete(out, last)
    offsets = edge - np.append(0, np.cumsum(filled))
    return pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out)]).cast(pa.binary())


def _search(min_length: int, min_exponent: int):
    k = max(1, min_length * (min_exponent - 2) // min_exponent)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches):
        for batch in batches:
            all_data, all_offsets = K.buffers(batch.column(1))
            for i, j in K.blocks(all_offsets, PIECE):
                data, offsets = all_data[all_offsets[i] : all_offsets[j]], all_offsets[i : j + 1] - all_offsets[i]
                hashes, start, end, at = K.words(data, offsets)
                kept = np.ones(len(hashes), bool)
                found: list[list[dict]] = [[] for _ in range(j - i)]
                for a, b in zip(*(x.tolist() for x in stretches(hashes, at, k, min_length)), strict=True):
                    row = int(np.searchsorted(at, a, "right")) - 1
                    number: dict[bytes, int] = {}
                    flat, base = data[start[a] : end[b - 1]].tobytes(), int(start[a])
                    symbols = [number.setdefault(flat[s - base : e - base], len(number)) for s, e in zip(start[a:b].tolist(), end[a:b].tolist(), strict=True)]
                    for s, length, period in runs_of(symbols, min_length, min_exponent):
                        found[row].append({"start": a + s - int(at[row]), "length": length, "period": period})
                        kept[a + s + period : a + s + length] = False
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(at)), pa.array(found, kind), joined(data, start, end, at, kept)], names=["doc_id", "n_words", "runs", "collapsed"])

    return K.returning(run)


def find_runs(docs: DataFrame, min_length: int = 24, min_exponent: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(RUNS) for every row: runs by start and period; collapsed: the words left once each run keeps its first period only."""
    if min_exponent < 3 or min_length < 1:
        raise ValueError("min_exponent must be 3 or more and min_length 1 or more")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_search(min_length, min_exponent), RUNS)
