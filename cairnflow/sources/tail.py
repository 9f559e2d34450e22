"""Logs that only grow, read from their ends: a data source for tables and streams.

``spark.read.format("log_tail").option("path", ...).option("lines", n)`` gives the newest n lines of a log and the files it was rotated to
(newest first, by commas; a folder stands for its files by falling name): file, at (the byte that the line begins at), line.  The end of a file is looked
through backwards, a block at a time, until n lines begin behind; only what holds them is read, cut in ranges of bytes.

On a stream each batch has the complete lines added since the last one.  A file is known by its first bytes, not by its name, so that after
a rotation what was added to the old file before it is read under its new name, and the new one from its beginning.  Offsets are positions by file and never fall.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

BLOCK = 1 << 16
RANGE = 1 << 20
HEAD = 256


@dataclass
class Range(InputPartition):
    """Lines that begin in bytes [lo, hi) of a file."""

    path: str
    lo: int
    hi: int


def _store(path: str):
    from pyarrow import fs

    u = urlparse(path)
    return (fs.LocalFileSystem(), u.path or path) if u.scheme in ("", "file") else fs.FileSystem.from_uri(path)


def files_of(paths: str) -> list[str]:
    """The files of a comma list, folders as their files by falling name; what isn't there is left out."""
    from pyarrow import fs

    out = []
    for path in filter(None, (p.strip() for p in paths.split(","))):
        store, inner = _store(path)
        info = store.get_file_info(inner)
        if info.type == fs.FileType.File:
            out.append(path)
        elif info.type == fs.FileType.Directory:
            names = sorted((f.base_name for f in store.get_file_info(fs.FileSelector(inner)) if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))), reverse=True)
            out += [f"{path.rstrip('/')}/{n}" for n in names]
    return out


def _open(path: str):
    store, inner = _store(path)
    return store.open_input_file(inner)


def newest_from(path: str, lines: int, block: int = BLOCK) -> tuple[int, int, int]:
    """Where the newest lines of a file begin, where the file ends, and how many they are."""
    with _open(path) as f:
        end = f.size()
        pos, found, start = end, 0, 0
        while pos > 0:
            size = min(block, pos)
            pos -= size
            f.seek(pos)
            data = f.read(size)
            at = len(data)
            while (at := data.rfind(b"\n", 0, at)) >= 0:
                if pos + at + 1 < end:  # a line begins behind this one
                    found, start = found + 1, pos + at + 1
                    if found == lines:
                        return start, end, found
        return 0, end, found + (end > 0)


def lines_between(path: str, lo: int, hi: int, block: int = BLOCK) -> Iterator[tuple[int, bytes]]:
    """Lines that begin in [lo, hi), with their places."""
    with _open(path) as f:
        at = lo
        if lo:
            # the line that holds the byte before belongs to another range
            f.seek(lo - 1)
            at = lo - 1
            while data := f.read(block):
                k = data.find(b"\n")
                if k >= 0:
                    at += k + 1
                    break
                at += len(data)
            else:
                return
        f.seek(at)
        held = b""
        while at < hi:
            data = f.read(block)
            *whole, held = (held + data).split(b"\n") if data else (held, b"")
            for line in whole:
                if at >= hi or not data and not line:
                    return
                yield at, line
                at += len(line) + 1
            if not data:
                return


def _ranges(path: str, lo: int, hi: int) -> list[Range]:
    return [Range(path, k, min(hi, k + RANGE)) for k in range(lo, hi, RANGE)]


def _rows(part: Range) -> Iterator[tuple[str, int, str]]:
    for at, line in lines_between(part.path, part.lo, part.hi):
        yield part.path, at, line.decode("utf-8", "replace")


class TailReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths, self.lines = options["path"], int(options.get("lines", 200))

    def partitions(self) -> list[Range]:
        out, left = [], self.lines
        for path in files_of(self.paths):
            if left <= 0:
                break
            lo, hi, n = newest_from(path, left)
            out += _ranges(path, lo, hi)
            left -= n
        return out

    def read(self, partition: Range) -> Iterator[tuple[str, int, str]]:
        return _rows(partition)


def _known_by(path: str) -> str | None:
    """A hash of a file's first complete line, at most HEAD bytes of it; none until it has one."""
    with _open(path) as f:
        head = f.read(HEAD)
    if b"\n" not in head and len(head) < HEAD:
        return None
    return hashlib.sha256(head.split(b"\n", 1)[0]).hexdigest()[:16]


def _complete(path: str, lo: int) -> int:
    """Where the last complete line from lo on ends."""
    with _open(path) as f:
        pos = f.size()
        while pos > lo:
            size = min(BLOCK, pos - lo)
            f.seek(pos - size)
            k = f.read(size).rfind(b"\n")
            if k >= 0:
                return pos - size + k + 1
            pos -= size
    return lo


class TailStream(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.paths, self.from_end, self.seen = options["path"], options.get("startingOffsets", "earliest") == "latest", {}

    def _ends(self) -> dict:
        for path in files_of(self.paths):
            key = _known_by(path)
            if key is not None:
                self.seen[key] = _complete(path, self.seen.get(key, 0))
        return self.seen

    def initialOffset(self) -> dict:
        return {"at": json.dumps(self._ends() if self.from_end else {}, sort_keys=True)}

    def latestOffset(self) -> dict:
        return {"at": json.dumps(self._ends(), sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        was, now = json.loads(start["at"]), json.loads(end["at"])
        self.seen = {k: max(self.seen.get(k, 0), n) for k, n in (self.seen | was | now).items()}  # those of before a restart, too
        out = []
        for path in files_of(self.paths):
            key = _known_by(path)
            if key in now:
                out += _ranges(path, was.get(key, 0), now[key])
        return out

    def read(self, partition: Range) -> Iterator[tuple[str, int, str]]:
        return _rows(partition)


class TailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return "file string, at long, line string"

    def reader(self, schema) -> TailReader:
        return TailReader(self.options)

    def streamReader(self, schema) -> TailStream:
        return TailStream(self.options)
