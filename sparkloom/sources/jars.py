"""JARs by entry: directories first, then ranges of bytes, so that entries and not archives are dealt to tasks."""

from __future__ import annotations

import io
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkloom.sources.assembler import jar as build

#: Bytes of an archive that a task reads at once.
STRETCH = 4 << 20
ENTRIES = "path string, error string, names array<string>, offsets array<long>, sizes array<long>, methods array<int>, sums array<long>"
_SCHEMA = pa.schema([("path", pa.string()), ("error", pa.string()), ("names", pa.list_(pa.string())), ("offsets", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("methods", pa.list_(pa.int32())), ("sums", pa.list_(pa.int64()))])


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path as Spark writes it, and the path in it."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


class _Seekable(io.RawIOBase):
    """An input file that says OSError to a seek before its start, as zipfile expects of files."""

    def __init__(self, f):
        self.f = f

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.f.tell()

    def seek(self, offset: int, whence: int = 0) -> int:
        at = offset + (0, self.f.tell(), self.f.size())[whence]
        if at < 0:
            raise OSError("before the start")
        return self.f.seek(at)

    def readinto(self, b) -> int:
        data = self.f.read(len(b))
        b[: len(data)] = data
        return len(data)


def _directory(stretch: int):
    """(path) -> rows (ENTRIES) of neighbouring class entries, or of what makes the archive unreadable."""

    def rows(path: str) -> Iterator[tuple]:
        fs, at = opened(path)
        with fs.open_input_file(at) as f, zipfile.ZipFile(_Seekable(f)) as z:
            held: list = []
            for e in sorted((e for e in z.infolist() if e.filename.endswith(".class")), key=lambda e: e.header_offset):
                if held and e.header_offset + e.compress_size - held[0].header_offset > stretch:
                    yield tuple([getattr(h, a) for h in held] for a in ("filename", "header_offset", "compress_size", "compress_type", "CRC"))
                    held = []
                held.append(e)
            if held:
                yield tuple([getattr(h, a) for h in held] for a in ("filename", "header_offset", "compress_size", "compress_type", "CRC"))

    def run(batches):
        for b in batches:
            out = []
            for path in b.column(0).to_pylist():
                try:
                    out += [(path, None, *r) for r in rows(path)]
                except (zipfile.BadZipFile, OSError, ValueError, NotImplementedError) as e:
                    out.append((path, str(e), *[None] * 5))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t.type) for i, t in enumerate(_SCHEMA)], schema=_SCHEMA)

    return run


def entries(spark: SparkSession, paths: list[str], stretch: int = STRETCH) -> DataFrame:
    """(ENTRIES) of all JARs below the paths, a row for each stretch, dealt out evenly."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.jar").option("recursiveFileLookup", True).load(paths)
    rows = found.select("path").mapInArrow(_directory(stretch), ENTRIES)
    return rows.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def _content(data: bytes, at: int, size: int, method: int, crc: int) -> bytes | str:
    """An entry's content from the bytes of its stretch, or why it cannot be read."""
    head = data[at : at + 30]
    if len(head) < 30 or head[:4] != b"PK\3\4":
        return "BadZipFile: no entry where the directory says"
    flags, (name, extra) = struct.unpack_from("<H", head, 6)[0], struct.unpack_from("<HH", head, 26)
    start = at + 30 + name + extra
    raw = data[start : start + size]
    if flags & 1:
        return "RuntimeError: encrypted"
    try:
        out = raw if method == zipfile.ZIP_STORED else zlib.decompress(raw, -15) if method == zipfile.ZIP_DEFLATED else None
    except zlib.error as e:
        return f"error: {e}"
    if out is None:
        return f"NotImplementedError: compression method {method}"
    return out if zlib.crc32(out) == crc else "BadZipFile: wrong checksum"


def contents(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, bytes | str]]:
    """(path!/entry, content or the reason why there is none) of rows ENTRIES."""
    for b in batches:
        for r in b.to_pylist():
            if r["error"] is not None:
                yield r["path"], r["error"]
                continue
            first, last = r["offsets"][0], r["offsets"][-1] + r["sizes"][-1] + 30 + 2 * 65_535  # a name and extra fields at most
            fs, at = opened(r["path"])
            with fs.open_input_file(at) as f:
                data = f.read_at(min(last, f.size()) - first, first)
            for name, offset, size, method, crc in zip(r["names"], r["offsets"], r["sizes"], r["methods"], r["sums"], strict=True):
                yield f"{r['path']}!/{name}", _content(data, offset - first, size, method, crc)


def write(files: DataFrame, folder: str, count: int) -> DataFrame:
    """(path, content) packed into at most `count` JARs of a shared folder; (jar, entries) of each, once the result is run."""

    def pack(pdf):
        name = f"{folder}/{pdf['jar'].iat[0]}.jar"
        fs, at = opened(name)
        fs.create_dir(at.rsplit("/", 1)[0])
        rows = pdf.sort_values("path")
        other = f"{at}.{uuid.uuid4().hex}"  # a task that runs twice replaces a whole file by its equal
        with fs.open_output_stream(other) as f:
            f.write(build(zip(rows["path"], rows["content"], strict=True)))
        fs.move(other, at)
        return rows.head(1).assign(entries=len(rows))[["jar", "entries"]]

    return files.withColumn("jar", F.pmod(F.xxhash64("path"), F.lit(count)).cast("int")).groupBy("jar").applyInPandas(pack, "jar int, entries long")
