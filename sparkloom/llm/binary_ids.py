"""Token ids in binary files with a shared zstandard dictionary (operator 10).

A file holds documents in ascending id order: magic, the dictionary's hash, number of documents,
bytes of an id (2 or 4), an offset index, document ids, token counts, then one zstandard frame per
document, compressed by itself against the shared dictionary, so that a short document is read
without its neighbours. The dictionary is trained on the serialized ids of a bounded sample: of
`sample` documents of least id hash a slice of `sample_ids` ids each, from a place that the hash
chooses; every document is written whole. Where there is too little to train on, the samples'
bytes are the dictionary.

Files are written by the tasks into the shared folder, each under a name of its own, and a table
of them (the manifest) by Spark's committer: files of a lost or repeated task are named by no row,
so they do not count. The folder must be one that pyarrow can open (file, s3, gs, abfs, hdfs).
Range partitions of the id give the order; a file's row has its position within its part, and a
part's own position is a sum over parts (a row for each partition), which is broadcast.

Results: one row per row of docs. A null or empty text holds the end id alone; null ids come
first; equal ids are ordered by text; columns but id and text are ignored; an empty table gives no file.
"""

from __future__ import annotations

import hashlib
import struct
import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from sparkloom.llm import kernels as K, tokens as T
from sparkloom.util import Scratch

MAGIC = b"LOOMIDS2"
HEAD = struct.Struct("<8s16sQB")
LEAST = -(2**63)
MANIFEST = "part int, file int, n_docs long, n_ids long, before long, uri string"
ROWS = "doc_id long, part int, before long, n_tokens long, ids binary"


def dictionary_hash(dictionary: bytes) -> bytes:
    return hashlib.sha256(dictionary).digest()[:16]


def train_dictionary(samples: list[bytes], size: int = 65536) -> bytes:
    """A zstandard dictionary; of few or small samples, the plain bytes serve as one."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


def _dict(dictionary: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(dictionary) if dictionary else None


def file_bytes_of(doc_ids: list[int], frames: list[bytes], counts: list[int], dictionary: bytes, width: int) -> bytes:
    index = np.append(0, np.cumsum([len(f) for f in frames])).astype("<u8")
    return b"".join([HEAD.pack(MAGIC, dictionary_hash(dictionary), len(frames), width), index.tobytes(), np.array(doc_ids, "<i8").tobytes(), np.array(counts, "<u4").tobytes(), *frames])


class IdFile:
    """A file's reader: the index is read once, document(i) then reads and decompresses one document only."""

    def __init__(self, uri: str, dictionary: bytes):
        import zstandard

        where, path = fs.FileSystem.from_uri(uri)
        self.file = where.open_input_file(path)
        magic, want, n, width = HEAD.unpack(self.file.read_at(HEAD.size, 0))
        if magic != MAGIC or want != dictionary_hash(dictionary):
            raise ValueError("not a file of this dictionary")
        part = self.file.read_at(20 * n + 8, HEAD.size)
        self.index = np.frombuffer(part, "<u8", n + 1).astype(np.int64)
        self.doc_ids = np.frombuffer(part, "<i8", n, 8 * (n + 1))
        self.counts = np.frombuffer(part, "<u4", n, 8 * (2 * n + 1)).astype(np.int64)
        self.base, self.kind = HEAD.size + len(part), "<u2" if width == 2 else "<u4"
        self.reader = zstandard.ZstdDecompressor(dict_data=_dict(dictionary)) if dictionary else zstandard.ZstdDecompressor()

    def __len__(self) -> int:
        return len(self.doc_ids)

    def __enter__(self) -> IdFile:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()

    def documents(self, i: int, j: int) -> list[np.ndarray]:
        """Ids of documents i to j - 1, by one read."""
        at = self.index[i : j + 1] - self.index[i]
        raw = self.file.read_at(int(at[-1]), int(self.base + self.index[i]))
        out = [np.frombuffer(self.reader.decompress(raw[a:b]), self.kind).astype("<u4") for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        if any(len(x) != n for x, n in zip(out, self.counts[i:j].tolist(), strict=True)):
            raise ValueError("token count differs from the index")
        return out

    def document(self, i: int) -> np.ndarray:
        return self.documents(i, i + 1)[0]


def writer(path: str, end_id: int, dictionary: bytes, width: int, file_bytes: int, folder: str):
    def run(batches):
        import zstandard

        part, file, before = TaskContext.get().partitionId(), 0, 0
        end = np.array([end_id], "<u2" if width == 2 else "<u4").tobytes()
        press = zstandard.ZstdCompressor(level=3, dict_data=_dict(dictionary)) if dictionary else zstandard.ZstdCompressor(level=3)
        ids, frames, counts, size = [], [], [], 0

        def flush():
            where, top = fs.FileSystem.from_uri(folder)
            where.create_dir(top, recursive=True)
            name = f"{part:08d}-{file:06d}-{uuid.uuid4().hex}.ids"  # an attempt's own: no other writes to it
            with where.open_output_stream(f"{top}/{name}", compression=None) as out:
                out.write(file_bytes_of(ids, frames, counts, dictionary, width))
            row = (part, file, len(ids), sum(counts), before, f"{folder}/{name}")
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=["part", "file", "n_docs", "n_ids", "before", "uri"])

        for batch in batches:
            docs = batch.column(0).to_pylist()
            for i, j, flat, at in T.encoder(path).column(batch.column(1)):
                raw = (flat.astype("<u2") if width == 2 else flat.astype("<u4")).tobytes()
                cut = (at * width).tolist()
                for k in range(i, j):
                    own = raw[cut[k - i] : cut[k - i + 1]] + end
                    frames.append(press.compress(own))
                    ids.append(LEAST if docs[k] is None else docs[k])
                    counts.append(len(own) // width)
                    size += len(frames[-1])
                    if size >= file_bytes:
                        yield flush()
                        file, before = file + 1, before + sum(counts)
                        ids, frames, counts, size = [], [], [], 0
        if ids:
            yield flush()

    return run


def reader(dictionary: bytes, rows: int = 512):
    def run(batches):
        for batch in batches:
            for part, before, uri in zip(*(batch.column(c).to_pylist() for c in ("part", "before", "uri")), strict=True):
                with IdFile(uri, dictionary) as f:
                    first = before + np.cumsum(f.counts) - f.counts
                    for k in range(0, len(f), rows):
                        j = min(k + rows, len(f))
                        none = f.doc_ids[k:j] == LEAST
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(f.doc_ids[k:j], mask=none), pa.array([part] * (j - k), pa.int32()), pa.array(first[k:j]), pa.array(f.counts[k:j]), pa.array([x.tobytes() for x in f.documents(k, j)], pa.binary())],
                            names=["doc_id", "part", "before", "n_tokens", "ids"],
                        )

    return run


def write_files(docs: DataFrame, path: str, scratch: Scratch, end_id: int = 1, sample: int = 1000, sample_ids: int = 4096, file_bytes: int = 4 << 20, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, bytes]:
    """(manifest of the files, dictionary)."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    width = 2 if T.encoder(path).tok.get_vocab_size() <= 65536 and end_id < 65536 else 4
    chosen = [r.doc_id for r in docs.filter("doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()]

    def serialized(batches):
        for batch in batches:
            place = batch.column(2).to_pylist()
            for i, _, ids, at in T.encoder(path).column(batch.column(1)):
                raw = []
                for k, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                    a += place[i + k] % max(1, b - a - sample_ids + 1)
                    raw.append(ids[a : min(b, a + sample_ids)].astype("<u2" if width == 2 else "<u4").tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(raw, pa.binary())], names=["raw"])

    some = docs.filter(F.col("doc_id").isin(chosen)).select("doc_id", "text", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(2**40)).alias("place"))
    samples = sorted(bytes(r.raw) for r in some.mapInArrow(K.returning(serialized), "raw binary").collect()) if chosen else []
    dictionary = train_dictionary([s for s in samples if s])
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    made = ordered.mapInArrow(K.returning(writer(path, end_id, dictionary, width, file_bytes, f"{scratch.base}/ids")), MANIFEST)
    return scratch.keep(made), dictionary


def read_files(files: DataFrame, dictionary: bytes) -> DataFrame:
    """(doc_id, start, n_tokens, ids) from the files that the manifest names."""
    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    totals = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("first"))
    rows = files.select("part", "file", "before", "uri").repartition(n, "part", "file").mapInArrow(K.returning(reader(dictionary)), ROWS)
    # a row for each partition of the writer, which its own task count bounds
    return rows.join(F.broadcast(parts), "part").select("doc_id", (F.col("first") + F.col("before")).alias("start"), "n_tokens", "ids")
