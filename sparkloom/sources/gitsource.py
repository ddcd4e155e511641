"""Logs of version control as a data source: a row per commit, cut at commit headers by ranges of bytes.

`spark.read.format("commitlog").load(path)` reads a log or a folder of logs with a task for each `splitBytes` bytes; a commit belongs to
the range that its header starts in, so a log of any size is read by many tasks and no row holds more than a commit.
`spark.readStream.format("commitlog")` follows one growing log: its offset is the place of the last header, so a
restart goes on where it stopped. The last commit, which may still be written, comes once another follows it,
or at once with option final=true.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from sparkloom.sources.jars import _Seekable, opened

SCHEMA = "file string, at long, commit string"
_ARROW = pa.schema([("file", pa.string()), ("at", pa.int64()), ("commit", pa.string())])
#: Fixed value: the form of a commit's first line, as bytes.
HEADER = re.compile(rb"--[^-\n]+--\d{4}-\d{2}-\d{2}--[^\r\n]")
SPLIT = 64 << 20


class Range(InputPartition):
    """Commits of a log whose headers start in [start, end)."""

    def __init__(self, file: str, start: int, end: int):
        self.file, self.start, self.end = file, start, end


def commits(part: Range, rows: int = 1000) -> Iterator[pa.RecordBatch]:
    if part is None or part.start >= part.end:  # a source without partitions is asked to read none
        return
    fs, name = opened(part.file)
    held: list[tuple[int, str]] = []
    with fs.open_input_file(name) as raw:
        f = io.BufferedReader(_Seekable(raw), 1 << 20)
        at = part.start
        if at:  # the range may begin inside a line, which then is another's
            f.seek(at - 1)
            at += len(f.readline()) - 1
        lines: list[bytes] = []
        start = -1
        while True:
            line = f.readline()
            ends = not line
            if ends or HEADER.match(line):
                if start >= 0:
                    held.append((start, b"".join(lines).decode("utf-8", "replace")))
                if ends or at >= part.end:
                    break
                start, lines = at, []
            if start >= 0:
                lines.append(line)
            elif at >= part.end:  # no header in this range
                break
            at += len(line)
            if len(held) >= rows:
                yield _batch(part.file, held)
                held = []
    if held:
        yield _batch(part.file, held)


def _batch(file: str, held: list[tuple[int, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([file] * len(held)), pa.array([a for a, _ in held], pa.int64()), pa.array([c for _, c in held])], schema=_ARROW)


def last_header(file: str, low: int, block: int = 1 << 20) -> int:
    """Where the last header from `low` on starts; low where there is none."""
    fs, name = opened(file)
    with fs.open_input_file(name) as f:
        end = f.size()
        while end > low:
            begin = max(low, end - block)
            # a header may reach past the block's end
            data = f.read_at(min(f.size(), end + 4096) - begin, begin)
            found = [m.start() for m in HEADER.finditer(data) if begin + m.start() < end and (data[m.start() - 1 : m.start()] == b"\n" if m.start() else begin == 0 or f.read_at(1, begin - 1) == b"\n")]
            if found:
                return begin + found[-1]
            end = begin
    return low


class _Reader(DataSourceReader):
    def __init__(self, path: str, split: int):
        self.path, self.split = path, split

    def partitions(self) -> list[Range]:
        fs, name = opened(self.path)
        info = fs.get_file_info(name)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        head = self.path[: len(self.path) - len(name)] if self.path.endswith(name) else ""
        files = [info] if info.is_file else [i for i in fs.get_file_info(pafs.FileSelector(name, recursive=True)) if i.is_file and not i.base_name.startswith(("_", "."))]
        return [Range(head + i.path, a, min(i.size, a + self.split)) for i in sorted(files, key=lambda i: i.path) for a in range(0, i.size, self.split)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return commits(partition)


class _Stream(DataSourceStreamReader):
    def __init__(self, path: str, split: int, final: bool):
        self.path, self.split, self.final, self.at = path, split, final, 0

    def initialOffset(self) -> dict:
        return {"at": 0}

    def latestOffset(self) -> dict:
        fs, name = opened(self.path)
        self.at = fs.get_file_info(name).size if self.final else last_header(self.path, self.at)
        return {"at": self.at}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return [Range(self.path, a, min(end["at"], a + self.split)) for a in range(start["at"], end["at"], self.split)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return commits(partition)


class CommitLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "commitlog"

    def schema(self) -> str:
        return SCHEMA

    def _split(self) -> int:
        return int(self.options.get("splitBytes", SPLIT))

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self._split())

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options["path"], self._split(), str(self.options.get("final", "false")).lower() == "true")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CommitLog)
