"""Ids of whole texts, chunk by chunk in numpy: known chunks come from a hashed table, new ones from a learner."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from sparkloom.llm import kernels as K

MOST_BYTES = 23  # of a chunk in the table: three words, the last byte holding the length
ENTRIES = 800_000  # chunks that a table keeps; it starts anew beyond that
BLOCK = 1 << 20  # bytes of text encoded together

#: Lead bytes in UTF-8 of white space beyond ASCII, and the encodings themselves.
_LEADS = np.zeros(256, bool)
_LEADS[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_WHITE = np.array(sorted({int.from_bytes(chr(c).encode().ljust(3, b"\0"), "big") for c in range(0x80, 0x3001) if chr(c).isspace()}), np.int64)
#: Bytes that a character other than white space can begin with, beyond doubt.
_SOLID = np.zeros(256, bool)
_SOLID[0x21:0x7F] = True
_SOLID[0x80:] = ~_LEADS[0x80:]


#: Letters of ASCII, and ASCII punctuation but the apostrophe.
_LETTER, _POINT = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_POINT[[c for c in range(0x21, 0x7F) if not chr(c).isalnum() and c != 0x27]] = True


def chunk_starts(data: np.ndarray, offsets: np.ndarray, whole: np.ndarray | None = None) -> np.ndarray:
    """First bytes of chunks: a row's first byte, and places where a match of the patterns always begins.

    That is a space before a character that is no white space, a lone line break between two such
    characters and the character after it, and ASCII punctuation (no apostrophe) after a letter of
    ASCII or Latin-1. So chunks can be encoded one by one. whole: rows that stay one chunk.
    """
    n = len(data)
    flag = np.zeros(n + 1, bool)
    if n > 1:
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        at = np.flatnonzero(data[:-1] == 32)
        at = at[~edge[at + 1]]
        nxt = data[at + 1]
        good = _SOLID[nxt]
        odd = np.flatnonzero(_LEADS[nxt])
        if len(odd):
            d = np.concatenate((data, np.zeros(3, np.uint8))).astype(np.int64)
            p = at[odd] + 1
            code = d[p] << 16 | d[p + 1] << 8 | np.where(d[p] == 0xC2, 0, d[p + 2])
            good[odd] = ~np.isin(code, _WHITE)
        flag[at[good]] = True
        latin = np.zeros(n, bool)  # last bytes of Latin-1 letters
        latin[1:] = (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
        at = np.flatnonzero(_POINT[data[1:]] & (_LETTER[data[:-1]] | latin[:-1])) + 1
        flag[at] = True
        at = np.flatnonzero(data[1:-1] == 10) + 1
        at = at[((data[at - 1] > 32) & (data[at - 1] < 127) | latin[at - 1]) & _SOLID[data[at + 1]] & ~edge[at] & ~edge[at + 1]]
        flag[at] = True
        flag[at + 1] = True
    if whole is not None:
        for i in whole.tolist():
            flag[offsets[i] : offsets[i + 1]] = False
    flag[offsets[:-1]] = True
    flag[n] = False
    return np.flatnonzero(flag)


class ChunkTable:
    """Open addressing from short byte strings, compared exactly, to runs of ids in a pool."""

    def __init__(self, entries: int = ENTRIES):
        self.most = entries
        self.clear()

    def clear(self) -> None:
        self.n, self.used, self.room = 0, 0, 1 << 12
        self.keys = [np.zeros(self.room, np.uint64) for _ in range(3)]
        self.at, self.size = np.zeros(self.room, np.int32), np.zeros(self.room, np.int32)
        self.pool = np.zeros(self.room * 4, np.uint32)
        self.bits = 14
        self.slots = np.full(1 << self.bits, -1, np.int32)

    def _slot(self, k: list[np.ndarray]) -> np.ndarray:
        h = K.mix(K.mix(k[0]) ^ k[1]) + k[2] * np.uint64(0x9E3779B97F4A7C15)
        return ((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, k: list[np.ndarray]) -> np.ndarray:
        """Entry of each key, -1 where there is none."""
        slot, mask = self._slot(k), len(self.slots) - 1
        e = self.slots[slot]
        same = (self.keys[0][e] == k[0]) & (self.keys[1][e] == k[1]) & (self.keys[2][e] == k[2])
        open_ = np.flatnonzero(~same & (e >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & mask
            f = self.slots[slot[open_]]
            e[open_] = f
            same = (f < 0) | (self.keys[0][f] == k[0][open_]) & (self.keys[1][f] == k[1][open_]) & (self.keys[2][f] == k[2][open_])
            open_ = open_[~same]
        return e

    def _place(self, first: int) -> None:
        todo = np.arange(first, self.n)
        slot, mask = self._slot([x[first : self.n] for x in self.keys]), len(self.slots) - 1
        while len(todo):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = todo[free]  # one of those that meet wins
            lost = self.slots[slot] != todo
            todo, slot = todo[lost], (slot[lost] + 1) & mask

    def add(self, k: list[np.ndarray], ids: list[bytes]) -> None:
        """New, distinct keys and their ids (little-endian uint32)."""
        m, size = len(ids), np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        n, used = self.n + m, self.used + int(size.sum())
        if n > self.room:
            self.room = max(2 * self.room, n)
            self.keys, self.at, self.size = [_grown(x, self.room) for x in self.keys], _grown(self.at, self.room), _grown(self.size, self.room)
        if used > len(self.pool):
            self.pool = _grown(self.pool, max(2 * len(self.pool), used))
        for x, y in zip(self.keys, k, strict=True):
            x[self.n : n] = y
        self.at[self.n : n], self.size[self.n : n] = self.used + np.cumsum(size) - size, size
        self.pool[self.used : used] = np.frombuffer(b"".join(ids), "<u4")
        first, self.n, self.used = self.n, n, used
        if 2 * n > len(self.slots):
            while 2 * n > 1 << self.bits:
                self.bits += 1
            self.slots, first = np.full(1 << self.bits, -1, np.int32), 0
        self._place(first)


def _grown(x: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(size, x.dtype)
    out[: len(x)] = x
    return out


class ChunkEncoder:
    """Rows of UTF-8 bytes -> ids. learn: chunks -> ids of each; whole: byte strings whose rows stay one chunk.

    folds: the learner does not tell letter case; bare: nor a chunk from the same one after a space.
    """

    def __init__(self, learn: Callable[[list[str]], list[bytes]], whole: list[bytes] = (), entries: int = ENTRIES, folds: bool = False, bare: bool = False):
        self.learn, self.whole, self.table, self.folds, self.bare = learn, list(whole), ChunkTable(entries), folds, bare

    def block(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids uint32, their offsets by row)."""
        table, own = self.table, data
        if self.folds:
            data = K.lower(data)
        raw = data.tobytes()
        whole = self._whole_rows(raw, offsets)
        if whole is not None and self.folds:  # added tokens are found in the text as it is
            data = data.copy()
            for i in whole.tolist():
                data[offsets[i] : offsets[i + 1]] = own[offsets[i] : offsets[i + 1]]
            raw = data.tobytes()
        start = chunk_starts(data, offsets, whole)
        size = np.diff(np.append(start, len(data)))
        first_chunk = np.searchsorted(start, offsets)
        if self.bare:
            spaced = (data[start] == 32) & (size > 1)
            start, size = start + spaced, size - spaced
        short = np.flatnonzero(size <= MOST_BYTES)
        k = K.packed(data, start[short], size[short], 3)
        k[2] |= size[short].astype(np.uint64) << np.uint64(56)
        if table.n > table.most:
            table.clear()
        entry = table.find(k)
        new, long = np.flatnonzero(entry < 0), np.flatnonzero(size > MOST_BYTES)
        at, many = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        pool = table.pool
        if len(new) or len(long):
            s = start[short[new]].tolist()
            first: dict[bytes, int] = {}
            for i, (a, n) in enumerate(zip(s, size[short[new]].tolist(), strict=True)):
                first.setdefault(raw[a : a + n], i)
            far: dict[bytes, int] = {}
            place = [far.setdefault(raw[a : a + n], len(far)) for a, n in zip(start[long].tolist(), size[long].tolist(), strict=True)]
            ids = self.learn([x.decode() for x in (*first, *far)])
            pick = new[np.fromiter(first.values(), np.int64, len(first))]
            table.add([x[pick] for x in k], ids[: len(first)])
            entry[new] = table.find([x[new] for x in k])
            pool = table.pool
            if far:
                more = ids[len(first) :]
                lens = np.fromiter(map(len, more), np.int64, len(more)) // 4
                at[long] = (table.used + np.cumsum(lens) - lens)[place]
                many[long] = lens[place]
                pool = np.concatenate((pool[: table.used], np.frombuffer(b"".join(more), "<u4")))
        at[short], many[short] = table.at[entry], table.size[entry]
        edge = np.append(0, np.cumsum(many))
        total = int(edge[-1])
        flat = pool[np.repeat(at - edge[:-1], many) + np.arange(total)] if total else np.zeros(0, np.uint32)
        return flat, edge[first_chunk]

    def _whole_rows(self, raw: bytes, offsets: np.ndarray) -> np.ndarray | None:
        rows: set[int] = set()
        for w in self.whole:
            at = raw.find(w)
            while at >= 0:
                row = int(np.searchsorted(offsets, at, "right")) - 1
                if at + len(w) <= offsets[row + 1]:
                    rows.add(row)
                at = raw.find(w, at + 1)
        return np.array(sorted(rows)) if rows else None

    def column(self, column: pa.Array, block: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, end row, ids, offsets) of bounded blocks of a string column; null is empty."""
        data, offsets = K.buffers(column)
        for i, j in K.blocks(offsets, block):
            yield i, j, *self.block(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])

    def texts(self, texts: list[str | None]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for _, _, ids, at in self.column(pa.array(texts, pa.string())):
            out += np.split(ids, at[1:-1])
        return out
