"""Log files read by byte ranges: a batch scan with fixed line identities and a tail of growing files.

Both are one Python data source, ``growing_log``. Its columns: ``path``, ``block`` (first byte of
the range), ``line_id`` (place of the line in the range), ``offset`` (first byte of the line),
``value``. Ranges depend on file sizes and the source's own options only, so the identity of a line
is the same in every pass, whatever the cluster or the session settings are meanwhile.

Files are opened through Arrow's file systems: local or mounted folders, HDFS and object stores.
"""

from __future__ import annotations

import hashlib
import json
import sys
import time
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "path string, block bigint, line_id bigint, offset bigint, value string"
FORMAT = "growing_log"
SPLIT_BYTES = 64 << 20
READ_BYTES = 4 << 20
# leading bytes that tell one file from another
HEAD_BYTES = 1024
SETTLE_SECONDS = 10.0

# executors get the classes themselves and need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass
class Span:
    """Bytes of a file whose lines a task reads: lines that begin in [start, end), the first at or after ``start``.

    ``low`` is a known beginning of a line, ``high`` the end of what may be read.
    """

    path: str
    start: int
    end: int
    low: int
    high: int


@dataclass
class Spans(InputPartition):
    spans: list[Span]


class Store:
    """Files below the given paths."""

    def __init__(self, paths: list[str], recursive: bool):
        self.recursive = recursive
        self.roots = []
        for path in paths:
            system, base = fs.FileSystem.from_uri(path)
            prefix = path[: -len(base)] if "://" in path and path.endswith(base) else "file://" if isinstance(system, fs.LocalFileSystem) else ""
            self.roots.append((system, base, prefix))

    def files(self) -> dict[str, tuple[int, float]]:
        """Path -> (size, time of the last change); hidden files are passed over."""
        out = {}
        for system, base, prefix in self.roots:
            found = system.get_file_info(base)
            listed = [found] if found.type == fs.FileType.File else []
            if found.type == fs.FileType.Directory:
                listed = system.get_file_info(fs.FileSelector(base, recursive=self.recursive))
            for info in listed:
                below = info.path[len(base) :].split("/")
                if info.type == fs.FileType.File and not any(p.startswith(("_", ".")) for p in below if p):
                    out[prefix + info.path] = (info.size, (info.mtime_ns or 0) / 1e9)
        return dict(sorted(out.items()))

    def open(self, path: str) -> pa.NativeFile:
        for system, _, prefix in self.roots:
            if path.startswith(prefix):
                return system.open_input_file(path[len(prefix) :])
        raise FileNotFoundError(path)


def splits(path: str, low: int, high: int, size: int) -> Iterator[Span]:
    """Ranges of ``size`` bytes over [low, high), cut at multiples of ``size``."""
    at = low
    while at < high:
        end = min((at // size + 1) * size, high)
        yield Span(path, at, end, low, high)
        at = end


def lines_of(file: pa.NativeFile, span: Span) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of consecutive lines with the offset of the first one.

    A line belongs to the range it begins in, so one that crosses the end is read to its own end.
    """
    at = span.start
    if at > span.low:
        at = _after_newline(file, at - 1, span.high)
    rest = b""
    file.seek(at)
    while at < span.end and at + len(rest) < span.high:
        chunk = file.read(min(READ_BYTES, span.high - at - len(rest)))
        if not chunk:
            break
        rest += chunk
        done = rest.rfind(b"\n") + 1
        if not done:
            continue
        lines, after = rest[: done - 1].split(b"\n"), rest[done:]
        if at + done > span.end:  # the lines from the range's end on belong to the next one
            taken, place = 0, at
            while taken < len(lines) and place < span.end:
                place += len(lines[taken]) + 1
                taken += 1
            yield at, lines[:taken]
            return
        yield at, lines
        at, rest = at + done, after
    if rest and at < span.end:
        yield at, [rest]


def _after_newline(file: pa.NativeFile, at: int, high: int) -> int:
    """Offset after the first line end at or after ``at``."""
    file.seek(at)
    while at < high:
        chunk = file.read(min(1 << 16, high - at))
        found = chunk.find(b"\n")
        if found >= 0:
            return at + found + 1
        if not chunk:
            break
        at += len(chunk)
    return high


def _text(lines: list[bytes]) -> pa.Array:
    clean = [x[:-1] if x.endswith(b"\r") else x for x in lines]
    try:
        return pa.array(clean, pa.binary()).cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([x.decode("utf-8", "replace") for x in clean], pa.string())


def read_spans(store: Store, spans: list[Span]) -> Iterator[pa.RecordBatch]:
    for span in spans:
        number = 0
        with store.open(span.path) as file:
            for first, lines in lines_of(file, span):
                offsets, at = [], first
                for x in lines:
                    offsets.append(at)
                    at += len(x) + 1
                n = len(lines)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([span.path] * n, pa.string()), pa.array([span.start] * n, pa.int64()),
                        pa.array(range(number, number + n), pa.int64()), pa.array(offsets, pa.int64()), _text(lines),
                    ],
                    ["path", "block", "line_id", "offset", "value"],
                )
                number += n


def packed(spans: list[Span], size: int) -> list[Spans]:
    """Partitions of about ``size`` bytes: a piece of a large file or several small files."""
    out, held = [], 0
    for span in spans:
        length = span.end - span.start
        if not out or held + length > size:
            out.append(Spans([]))
            held = 0
        out[-1].spans.append(span)
        held += length
    return out


class GrowingLogSource(DataSource):
    """Options: ``paths`` (a JSON list), ``recursive``, ``splitBytes``; for streams ``settleSeconds``
    and ``maxBytesPerTrigger``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def store(self) -> Store:
        return Store(json.loads(self.options["paths"]), self.options.get("recursive", "false") == "true")

    def reader(self, schema) -> DataSourceReader:
        return RangeReader(self.store(), int(self.options.get("splitBytes", SPLIT_BYTES)))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return TailReader(
            self.store(), int(self.options.get("splitBytes", SPLIT_BYTES)),
            float(self.options.get("settleSeconds", SETTLE_SECONDS)), int(self.options.get("maxBytesPerTrigger", 0)),
        )


class RangeReader(DataSourceReader):
    """All lines of the files as they are now."""

    def __init__(self, store: Store, size: int):
        self.store, self.size = store, size

    def partitions(self) -> list[Spans]:
        spans = [s for path, (size, _) in self.store.files().items() for s in splits(path, 0, size, self.size)]
        return packed(spans, self.size) or [Spans([])]

    def read(self, partition: Spans) -> Iterator[pa.RecordBatch]:
        return read_spans(self.store, partition.spans)


class TailReader(DataSourceStreamReader):
    """Lines added to the files of a folder; an offset is the bytes read of every file.

    A file is known by its leading bytes, so the reading position survives a rename: a rolled file
    is read to its end under its new name, and the file that took its place from its beginning,
    even if it is larger by then. A file that was truncated starts over. A last line without an
    end waits until its file has not changed for ``settle`` seconds.
    """

    def __init__(self, store: Store, size: int, settle: float, most: int):
        self.store, self.size, self.settle, self.most = store, size, settle, most
        self.seen: dict[str, tuple[int, float, int]] = {}  # size, time and whole lines' end at the last poll
        self.at: dict | None = None  # where the next batch starts, as far as known

    def initialOffset(self) -> dict:
        self.at = {}
        return {"files": {}}

    def latestOffset(self) -> dict:
        out, left = {}, self.most
        for path, (size, changed) in self.store.files().items():
            end = self._whole_lines(path, size, changed)
            if self.most and self.at is not None:
                end, left = self._capped(path, self._start(self.at, path, path, size), end, left)
            if end:
                head = min(end, HEAD_BYTES)
                out[path] = {"bytes": end, "size": size, "head": head, "digest": self._digest(path, head)}
        if self.at is not None:
            self.at = out
        return {"files": out}

    def partitions(self, start: dict, end: dict) -> list[Spans]:
        before, spans = start["files"], []
        for path, state in end["files"].items():
            place = self._found(path, state)
            spans += splits(place, self._start(before, path, place, state["size"]), state["bytes"], self.size)
        if self.at is None:
            self.at = end["files"]
        return packed(spans, self.size)

    def read(self, partition: Spans) -> Iterator[pa.RecordBatch]:
        return read_spans(self.store, partition.spans)

    def _digest(self, path: str, length: int) -> str:
        with self.store.open(path) as file:
            head = file.read(length)
        return hashlib.sha1(head).hexdigest() if len(head) == length else ""

    def _holds(self, path: str, state: dict) -> bool:
        """The file at ``path`` begins as the one that ``state`` was taken of."""
        try:
            return self._digest(path, state["head"]) == state["digest"]
        except FileNotFoundError:
            return False

    def _start(self, before: dict, path: str, place: str, size: int) -> int:
        """Bytes of a file that were read: under its own name, else under the one it had before.

        A file shorter than what was read of it has been truncated and starts over.
        """
        own = before.get(path)
        if own and self._holds(place, own):
            return own["bytes"] if size >= own["bytes"] else 0
        for name, state in before.items():
            if name != path and size >= state["bytes"] and self._holds(place, state) and not self._holds(name, state):
                return state["bytes"]
        return 0

    def _found(self, path: str, state: dict) -> str:
        """Where the file is now: a planned batch may be run again after a rotation."""
        for place, (size, _) in sorted(self.store.files().items(), key=lambda x: x[0] != path):
            if size >= state["bytes"] and self._holds(place, state):
                return place
        raise FileNotFoundError(f"{path}: the file with the lines of a planned batch is gone")

    def _whole_lines(self, path: str, size: int, changed: float) -> int:
        """End of the last whole line; of the file, once it has settled."""
        known = self.seen.get(path)
        if time.time() - changed >= self.settle:
            return size
        if known and known[:2] == (size, changed):
            return known[2]
        end = size
        with self.store.open(path) as file:
            while end:
                start = max(0, end - (1 << 16))
                file.seek(start)
                found = file.read(end - start).rfind(b"\n") + 1
                end = start + found if found else start
                if found:
                    break
        self.seen[path] = (size, changed, end)
        return end

    def _capped(self, path: str, start: int, end: int, left: int) -> tuple[int, int]:
        """``end`` moved so that at most about ``left`` new bytes are read, whole lines still."""
        if end - start > left:
            with self.store.open(path) as file:
                end = min(end, _after_newline(file, start + left - 1, end)) if left else start
        return end, max(0, left - max(0, end - start))


def growing_reader(spark: SparkSession, paths: str | list[str], recursive: bool, stream: bool, **options: str):
    """A reader of the source, registered with the session."""
    spark.dataSource.register(GrowingLogSource)
    reader = (spark.readStream if stream else spark.read).format(FORMAT)
    listed = [paths] if isinstance(paths, str) else list(paths)
    return reader.option("paths", json.dumps(listed)).option("recursive", str(recursive).lower()).options(**options)
