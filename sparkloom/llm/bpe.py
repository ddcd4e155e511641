"""Byte-level BPE on padded numpy matrices (operator 6).

Distinct pieces of a block are put into matrices by length. In each round every row merges its
leftmost pair of least rank: pair ranks come from a hashed table, rows are compacted by one column
and finished rows leave the matrix. Only the two pairs beside a merge are looked up again.

Results: one row per row of docs; a null or empty text has no ids.
"""

from __future__ import annotations

import base64
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sparkloom.llm import kernels as K
from sparkloom.llm.chunks import ChunkEncoder

NONE = np.int32(2**31 - 1)
LONG = 192  # bytes from which a piece is merged with a heap instead: a matrix would cost its square


class PairTable:
    """Open addressing over (left, right) -> rank."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(rank)) * 4))))
        size = 1 << self.bits
        self.keys, self.values = np.full(size, -1, np.int64), np.full(size, NONE, np.int32)
        key = (left.astype(np.int64) << 32) | right.astype(np.int64)
        todo, slot = np.arange(len(key)), self._slot(key)
        self.probes = 0
        while len(todo):
            self.probes += 1
            free = self.keys[slot] == -1
            winner = np.full(size, -1, np.int64)
            winner[slot[free]] = todo[free]
            placed = winner[slot] == todo
            self.keys[slot[placed]], self.values[slot[placed]] = key[todo[placed]], rank[todo[placed]]
            todo, slot = todo[~placed], (slot[~placed] + 1) & (size - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks, NONE where a pair has none or a side is padding (negative)."""
        key = (left.astype(np.int64) << 32) | right.astype(np.int64)
        slot = self._slot(key)
        found = self.keys[slot]
        out = np.where(found == key, self.values[slot], NONE)
        open_ = np.flatnonzero((found != key) & (found != -1))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (len(self.keys) - 1)
            found = self.keys[slot[open_]]
            hit = found == key[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        out[(left < 0) | (right < 0)] = NONE
        return out


class Codec(ChunkEncoder):
    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, f))}
        self.ranks, self.vocab = ranks, {i: t for t, i in ranks.items()}
        self.find = regex.compile(pattern).findall
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        pairs = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        left, right, rank = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
        self.merges = PairTable(left, right, rank.astype(np.int32))
        self.pair = {(a, b): r for a, b, r in pairs}
        lens = np.array([len(self.vocab.get(i, b"")) for i in range(max(self.vocab) + 1)], np.int64)
        self.starts, self.lens = np.cumsum(lens) - lens, lens
        self.bytes = np.frombuffer(b"".join(self.vocab.get(i, b"") for i in range(len(lens))), np.uint8)
        super().__init__(self._learn)

    def _matrix(self, rows: np.ndarray) -> list[np.ndarray]:
        """Ids of rows of bytes, padded with -1."""
        ids = rows.copy()
        out: list = [None] * len(ids)
        which = np.arange(len(ids))
        rank = self.merges.get(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(ids), -1)
        while True:
            j = rank.argmin(1) if rank.shape[1] else np.zeros(len(ids), np.int64)
            best = rank[np.arange(len(ids)), j] if rank.shape[1] else np.full(len(ids), NONE)
            done = best == NONE
            if done.any():
                lens = (ids[done] >= 0).sum(1)
                for k, row, n in zip(which[done].tolist(), ids[done], lens.tolist(), strict=True):
                    out[k] = row[:n]
                ids, rank, which, j, best = ids[~done], rank[~done], which[~done], j[~done], best[~done]
            if not len(ids):
                return out
            at, wide = np.arange(len(ids)), np.arange(ids.shape[1] - 1)
            ids[at, j] = best
            ids = np.take_along_axis(ids, wide + (wide > j[:, None]), 1)  # drops column j + 1 of each row
            wide = wide[:-1]
            rank = np.take_along_axis(rank, wide + (wide >= j[:, None]), 1)  # drops pair j
            if rank.shape[1]:
                has = j < rank.shape[1]
                rank[at[has], j[has]] = self.merges.get(ids[at[has], j[has]], ids[at[has], j[has] + 1])
                has = j > 0
                rank[at[has], j[has] - 1] = self.merges.get(ids[at[has], j[has] - 1], ids[at[has], j[has]])

    def _heap(self, piece: bytes) -> np.ndarray:
        """The same merges for one long piece, by a heap over a linked list."""
        ids = self.byte[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        nxt, prev = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := self.pair.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = nxt[i] if ids[i] is not None else n
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = r, None
            nxt[i] = nxt[j]
            if nxt[i] < n:
                prev[nxt[i]] = i
            for x, y in ((prev[i], i), (i, nxt[i])):
                if x >= 0 and y < n and (q := self.pair.get((ids[x], ids[y]))) is not None:
                    heapq.heappush(heap, (q, x, ids[x], ids[y]))
        return np.array([x for x in ids if x is not None], np.int32)

    def pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each piece; a piece that is a token as a whole gives that token."""
        out: list = [None] * len(pieces)
        by: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            if (r := self.ranks.get(p)) is not None:
                out[i] = np.array([r], np.int32)
            elif len(p) > LONG:
                out[i] = self._heap(p)
            else:
                by.setdefault(len(p) if len(p) < 24 else -(-len(p) // 24) * 24, []).append(i)
        for width, which in by.items():
            for k in range(0, len(which), step := max(256, 400_000 // width)):
                part = which[k : k + step]
                lens = np.array([len(pieces[i]) for i in part])
                rows = np.full((len(part), width), -1, np.int32)
                rows[np.arange(width) < lens[:, None]] = self.byte[np.frombuffer(b"".join(pieces[i] for i in part), np.uint8)]
                for i, ids in zip(part, self._matrix(rows), strict=True):
                    out[i] = ids
        return out

    def _learn(self, chunks: list[str]) -> list[bytes]:
        cut = [[p.encode() for p in self.find(c)] for c in chunks]
        distinct = list(set().union(*cut))
        ids = dict(zip(distinct, (x.tobytes() for x in self.pieces(distinct)), strict=True))
        return [b"".join(map(ids.__getitem__, ps)) for ps in cut]

    def decode(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, offsets) of rows of ids."""
        size = self.lens[ids]
        edge = np.append(0, np.cumsum(size))
        return self.bytes[np.repeat(self.starts[ids] - edge[:-1], size) + np.arange(edge[-1])], edge[at]


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(path, pattern)
    return _CODECS[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>, decoded binary): ids of each whole text, and the bytes they decode to."""

    def run(batches):
        c = codec(path, pattern)
        for batch in batches:
            for i, j, ids, at in c.column(batch.column(1)):
                raw, edge = c.decode(ids, at)
                decoded = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(edge.astype(np.int32)), pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.view(np.int32))), decoded], names=["doc_id", "ids", "decoded"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(K.returning(run), "doc_id long, ids array<int>, decoded binary")
