"""Growing logs as a stream of lines: every file is followed from a byte position.

The offset of the stream maps each file to the byte after its last whole line; a line that is still being written waits.
A file is known by its identity, not by its name (the inode, where there is one), and by a checksum of its first bytes:

* renamed (``a.jsonl`` to ``a.jsonl.1``): the same identity goes on where it was, the new ``a.jsonl`` begins at zero;
* cut, or written anew: shorter than the position, or other first bytes, so it begins at zero;
* copied and then cut: a new file with the first bytes of one that was cut goes on at that one's position.

All of this is in the offsets, so a restarted query sees what happened while it was down.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "path string, position long, line string"
_ARROW = pa.schema([("path", pa.string()), ("position", pa.int64()), ("line", pa.string())])
_HEAD, _STEP, _LINES = 256, 1 << 16, 4096


class Piece(InputPartition):
    """Lines that begin at bytes [low, high) of a file; ``whole``: low is where a line begins."""

    def __init__(self, path: str, identity: str, low: int, high: int, whole: bool, head: int, crc: int) -> None:
        self.path, self.identity, self.low, self.high, self.whole, self.head, self.crc = path, identity, low, high, whole, head, crc


class LogTailReader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        at = options["path"]
        self.fs, self.root = pafs.FileSystem.from_uri(at) if "://" in at else (pafs.LocalFileSystem(), os.path.abspath(at.removeprefix("file:")))
        self.name = re.compile(options.get("pattern", r".*\.jsonl(\.\d+)?$"))
        self.earliest = options.get("start", "latest") == "earliest"
        self.chunk = int(options.get("bytes", 1 << 26))

    def _files(self) -> dict[str, tuple[str, int]]:
        """Path and size by identity."""
        out = {}
        for f in self.fs.get_file_info(pafs.FileSelector(self.root, recursive=True, allow_not_found=True)):
            if f.is_file and self.name.match(f.base_name):
                try:
                    found = os.stat(f.path) if isinstance(self.fs, pafs.LocalFileSystem) else None
                except FileNotFoundError:
                    continue  # renamed meanwhile: the next call sees it
                out[f"{found.st_dev}:{found.st_ino}" if found else f.path] = (f.path, f.size)
        return out

    def _head(self, path: str, n: int) -> int | None:
        """The checksum of the first ``n`` bytes; None where the file is gone or shorter."""
        try:
            with self.fs.open_input_file(path) as f:
                data = f.read(n)
        except FileNotFoundError:
            return None
        return zlib.crc32(data) if len(data) == n else None

    def _whole(self, path: str, size: int) -> int:
        """The byte after the last newline before ``size``."""
        with self.fs.open_input_file(path) as f:
            while size > 0:
                low = max(0, size - _STEP)
                at = f.read_at(size - low, low).rfind(b"\n")
                if at >= 0:
                    return low + at + 1
                size = low
        return 0

    def _marks(self, zero: bool = False) -> dict:
        out = {}
        for identity, (path, size) in sorted(self._files().items()):
            try:
                at = 0 if zero else self._whole(path, size)
                head = min(at, _HEAD)
                out[identity] = {"path": path, "at": at, "head": head, "crc": self._head(path, head) or 0}
            except FileNotFoundError:
                continue
        return out

    def initialOffset(self) -> dict:
        return {"files": {} if self.earliest else self._marks()}

    def latestOffset(self) -> dict:
        return {"files": self._marks()}

    def _begin(self, identity: str, mark: dict, start: dict, end: dict) -> int:
        """Where a file goes on."""

        def same(old: dict, new: dict) -> bool:
            if new["at"] < old["at"]:
                return False
            return new["crc"] == old["crc"] if new["head"] == old["head"] else self._head(new["path"], old["head"]) == old["crc"]

        if identity in start:
            return start[identity]["at"] if same(start[identity], mark) else 0
        for other, old in start.items():
            # A copy made before its original was cut. A file that goes on elsewhere was not copied.
            if old["head"] and same(old, mark) and not (other in end and same(old, end[other])):
                return old["at"]
        return 0

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        out: list[InputPartition] = []
        before, now = start["files"], end["files"]
        for identity, mark in now.items():
            low = self._begin(identity, mark, before, now)
            for at in range(low, mark["at"], self.chunk):
                out.append(Piece(mark["path"], identity, at, min(at + self.chunk, mark["at"]), at == low, mark["head"], mark["crc"]))
        return out

    def read(self, part: Piece) -> Iterator[pa.RecordBatch]:
        path = part.path
        here = self._files()
        if part.identity in here:
            path = here[part.identity][0]  # renamed since the batch was planned
        if self._head(path, part.head) != part.crc:
            return  # cut since: these lines are gone
        with self.fs.open_input_file(path) as f:
            f.seek(part.low if part.whole else part.low - 1)
            if not part.whole:
                self._line(f)  # began before this piece
            rows: list[tuple] = []
            at = f.tell()
            while at < part.high:
                line = self._line(f)
                if not line:
                    break
                rows.append((path, at, line.rstrip(b"\r\n").decode("utf-8", "replace")))
                at += len(line)
                if len(rows) == _LINES:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)

    @staticmethod
    def _line(f: pa.NativeFile) -> bytes:
        """The rest of the line at the file's position, with its newline."""
        start, out = f.tell(), b""
        while step := f.read(_STEP):
            at = step.find(b"\n")
            if at >= 0:
                out += step[: at + 1]
                break
            out += step
        f.seek(start + len(out))
        return out


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], schema=_ARROW)


class LogTail(DataSource):
    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> LogTailReader:  # noqa: ANN001
        return LogTailReader(self.options)


def lines(spark: SparkSession, folder: str, start: str = "latest", **options: str) -> DataFrame:
    """path, position (the byte at which the line begins) and line (without its end) of the logs below ``folder``, as a
    stream. ``start``: ``latest``, only what is written from now on, or ``earliest``. Also ``pattern`` of file names and
    ``bytes`` of a task. The folder may not be there yet."""
    spark.dataSource.register(LogTail)
    return spark.readStream.format("log_tail").options(start=start, **options).load(folder)
