"""Vector bin packing of token sequences (operator 2).

Examples go into sequences under three limits at once: tokens, segments and loss-bearing tokens.
Bins are filled one after another; each step places the example with the largest dot product of
its demand and what the bin has left (each dimension as a share of its limit). Examples longer
than a sequence give whole sequences first. If no example fits a gap of at least `min_cut` tokens,
the largest one is cut to fill it (off for instruction data).

Every task packs its own rows, a block of tokens at a time; the bin that a block leaves open goes on
with the next block. The bin that a task leaves open, one sequence at most, is packed again with those
of `share` neighbouring tasks, so padding does not grow with the number of partitions. Pieces are
written to the shared folder in between: a repeated task gives the same sequences. A sequence's id
holds the partition (or, above 2 ** 62, the group of partitions) and a number in it.

Results: a row for each piece. A null or empty text is a document of the end id alone; a null id comes
back as null; an empty table gives no row; repeated rows, ids and texts are packed each by itself, and
columns other than id, text and loss count are ignored. Documents of one task are taken in the order of its rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from sparkloom.llm import kernels as K, tokens as T
from sparkloom.util import Scratch


@dataclass(frozen=True)
class Limits:
    tokens: int = 2048
    segments: int = 128
    loss: int = 2048
    min_cut: int = 8  # the least piece that a cut may leave or fill; 0: never cut
    block: int = 4_000_000  # tokens that come in before bins are filled
    share: int = 2048  # tasks whose open bins are packed together


class Packer:
    """Items come in with add; fill closes bins. An item's loss-bearing tokens are its last ones."""

    def __init__(self, limits: Limits):
        self.limits, self.cap = limits, np.array([limits.tokens, limits.segments, limits.loss], float)
        self.bins = 0
        # classes of equal demand: (tokens, loss) -> pieces waiting, as (item, start, length, loss)
        self.waiting: dict[tuple[int, int], list[tuple[int, int, int, int]]] = {}
        self.whole: list[tuple[int, int, int, int, int]] = []

    def add(self, item: int, n: int, loss: int, start: int = 0) -> None:
        loss, at = min(loss, n), 0
        most, bears_most = self.limits.tokens, self.limits.loss
        while at < n:
            take = min(n - at, most)
            plain = n - loss  # tokens before the first that bears loss
            if at + take - max(at, plain) > bears_most:
                take = max(at, plain) + bears_most - at
            bears = max(0, at + take - max(at, plain))
            if take == most:
                self.whole.append((item, start + at, take, self.bins, 0))
                self.bins += 1
            else:
                self.waiting.setdefault((take, bears), []).append((item, start + at, take, bears))
            at += take

    def fill(self, last: bool) -> list[tuple[int, int, int, int, int]]:
        """(item, start, length, bin, offset) of pieces in closed bins; unless last, an open bin's go back to waiting."""
        out, self.whole = self.whole, []
        limits, cap = self.limits, self.cap
        keys = sorted(k for k, v in self.waiting.items() if v)
        waiting = {k: self.waiting[k] for k in keys}
        index = {k: i for i, k in enumerate(keys)}
        demand = np.array([(a, 1, b) for a, b in keys], float).reshape(-1, 3)
        count = np.array([len(waiting[k]) for k in keys], np.int64)
        share = demand / cap
        self.waiting = {}
        while count.any():
            left, offset, inside = cap.copy(), 0, []
            while True:
                fits = (count > 0) & (demand <= left).all(1)
                if fits.any():
                    k = int(np.argmax(np.where(fits, share @ (left / cap), -1.0)))
                    piece = waiting[keys[k]].pop()
                    count[k] -= 1
                    inside.append((piece, offset))
                    offset += piece[2]
                    left -= demand[k]
                    continue
                gap = int(left[0])
                rest = np.flatnonzero((count > 0) & (demand[:, 0] >= gap + limits.min_cut))
                if not limits.min_cut or gap < limits.min_cut or left[1] < 1 or not len(rest):
                    break
                k = int(rest[-1])
                item, at, n, loss = waiting[keys[k]][-1]
                bears = max(0, gap - (n - loss))
                if bears > left[2]:
                    break
                waiting[keys[k]].pop()
                count[k] -= 1
                inside.append(((item, at, gap, bears), offset))
                offset += gap
                left -= (gap, 1, bears)
                other = (n - gap, loss - bears)
                if other not in index:
                    index[other] = len(keys)
                    keys.append(other)
                    demand = np.vstack((demand, [(other[0], 1, other[1])]))
                    share, count = demand / cap, np.append(count, 0)
                    waiting.setdefault(other, [])
                waiting[other].append((item, at + gap, n - gap, loss - bears))
                count[index[other]] += 1
                break
            if last or count.any() or left[0] < max(1, limits.min_cut) or left[1] < 1:
                out += [(item, at, n, self.bins, off) for (item, at, n, _), off in inside]
                self.bins += 1
            else:
                for (item, at, n, loss), _ in inside:
                    self.waiting.setdefault((n, loss), []).append((item, at, n, loss))
        return out

    def left(self) -> list[tuple[int, int, int, int]]:
        """(item, start, length, loss) of pieces that wait."""
        return [p for v in self.waiting.values() for p in v]


def pack(length: np.ndarray, loss: np.ndarray, limits: Limits) -> list[tuple[int, int, int, int, int]]:
    """(item, start, length, bin, offset) of all pieces; bins count from 0. loss: how many of an item's last tokens bear loss."""
    packer = Packer(limits)
    for i, (n, m) in enumerate(zip(length.tolist(), loss.tolist(), strict=True)):
        packer.add(i, n, m)
    return packer.fill(True)


SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, loss long"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


class _Task:
    """Items of a task and the packer of their lengths; ids of an item are kept until all its pieces are out."""

    def __init__(self, limits: Limits, base: int):
        self.packer, self.base, self.items = Packer(limits), base, {}
        self.n = self.held = 0

    def add(self, doc: int | None, ids: bytes, loss: int, start: int, doc_tokens: int) -> None:
        self.items[self.n] = (doc, ids, loss, start, doc_tokens)
        self.packer.add(self.n, len(ids) // 4, loss)
        self.n += 1
        self.held += len(ids) // 4

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=NAMES)

    def _row(self, item: int, at: int, n: int, seq: int | None, off: int) -> tuple:
        doc, ids, loss, start, total = self.items[item]
        bears = max(0, at + n - max(at, len(ids) // 4 - loss))
        return doc, start + at, n, ids[4 * at : 4 * (at + n)], total, seq, off, bears

    def closed(self, last: bool = False) -> list[pa.RecordBatch]:
        rows = [self._row(i, at, n, self.base + b, off) for i, at, n, b, off in self.packer.fill(last)]
        wait = {p[0] for p in self.packer.left()}
        self.items, self.held = {i: x for i, x in self.items.items() if i in wait}, 0
        return [self._batch(rows[k : k + 4096]) for k in range(0, len(rows), 4096)]

    def open(self) -> pa.RecordBatch:
        return self._batch([self._row(i, at, n, None, 0) for i, at, n, _ in self.packer.left()])


def first_pass(path: str, end_id: int, limits: Limits):
    """(id, text, loss count or null) -> pieces; those of the open bin have no sequence."""

    def run(batches):
        end = np.array([end_id], "<u4").tobytes()
        task = _Task(limits, TaskContext.get().partitionId() << 32)
        for batch in batches:
            docs, bears = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for i, j, ids, at in T.encoder(path).column(batch.column(1)):
                raw, cut = ids.astype("<u4").tobytes(), (4 * at).tolist()
                for k in range(i, j):
                    own = raw[cut[k - i] : cut[k - i + 1]] + end
                    loss = len(own) // 4 if bears[k] is None else max(0, bears[k])
                    task.add(docs[k], own, loss, 0, len(own) // 4)
                if task.held >= limits.block:
                    yield from task.closed()
        yield from task.closed()
        yield task.open()

    return run


def second_pass(limits: Limits):
    """Open pieces of a group, sorted by it, -> the same pieces in sequences."""

    def run(batches):
        task, last = None, None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("doc_id", "start", "ids", "doc_tokens", "loss", "team")]
            for doc, start, ids, total, loss, team in zip(*columns, strict=True):
                if team != last:
                    if task:
                        yield from task.closed(True)
                    task, last = _Task(limits, (1 << 62) + (team << 32)), team
                task.add(doc, ids, loss, start, total)
        if task:
            yield from task.closed(True)

    return run


def pack_documents(docs: DataFrame, path: str, scratch: Scratch, end_id: int = 1, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text", loss_col: str | None = None) -> DataFrame:
    """Pieces with their ids (little-endian uint32), sequence and offset in it.

    loss_col: how many of a document's last tokens, the end id among them, bear loss; without it, or null, all do.
    """
    loss = F.lit(None).cast("long") if loss_col is None else F.col(loss_col).cast("long")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), loss.alias("loss"))
    made = scratch.keep(rows.mapInArrow(K.returning(first_pass(path, end_id, limits)), SCHEMA).withColumn("part", F.spark_partition_id()))
    team = (F.col("part") / limits.share).cast("int")
    # a task leaves one sequence at most, so a team holds `share` sequences at most; teams are dealt to as many tasks
    rest = made.filter("sequence_id is null").withColumn("team", team).repartition("team").sortWithinPartitions("team", "part", "doc_id", "start", "doc_tokens", "ids")
    again = rest.mapInArrow(K.returning(second_pass(limits)), SCHEMA)
    return made.filter("sequence_id is not null").drop("part").unionByName(again)
