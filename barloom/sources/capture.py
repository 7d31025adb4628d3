"""Files of captured responses as a data source of Spark: batch and stream reader, and writer.

    capture.register(spark)
    spark.read.format("responses").load(path).where("type = 4029")
    df.select("data").write.format("responses").mode("append").save(path)

A file is split by ranges of bytes. A range's reader finds where a response begins by following every chain of headers
that may run there until all agree, so that a prefix within some body misleads none; tests on `type` are pushed to the
reader, which then inflates no other response."""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, EqualTo, In, InputPartition, IsNotNull, WriterCommitMessage

from barloom.deploy import ship
from barloom.sources.wire import RESPONSE_PREFIX

SCHEMA = "file string, offset long, control int, msg_id long, type int, body binary"
_ARROW = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("control", pa.int32()), ("msg_id", pa.int64()), ("type", pa.int32()), ("body", pa.binary())])
HEAD = 16
#: A response's header and the largest body that its 16 bits can name.
LONGEST = HEAD + 0xFFFF
RANGE_BYTES = 32 << 20
_CHUNK = 1 << 20
_BATCH_BYTES, _BATCH_ROWS = 8 << 20, 5000


def _at(uri: str) -> tuple[fs.FileSystem, str]:
    return (fs.FileSystem.from_uri(uri) if urlsplit(uri).scheme else (fs.LocalFileSystem(), os.path.abspath(uri)))


def _files(uri: str) -> dict[str, int]:
    """Paths, below the file system's own root, and sizes of a file or of a folder's files, hidden ones left out."""
    system, path = _at(uri)
    info = system.get_file_info(path)
    if info.type == fs.FileType.File:
        return {path: info.size}
    found = system.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True))
    return {f.path: f.size for f in sorted(found, key=lambda f: f.path) if f.type == fs.FileType.File and not f.base_name.startswith((".", "_"))}


class _Bytes:
    """A file's bytes by place; a few chunks are held."""

    def __init__(self, system: fs.FileSystem, path: str, size: int):
        self._file, self.size, self._held = system.open_input_file(path), size, {}

    def read(self, at: int, n: int) -> bytes:
        end, out = min(at + n, self.size), []
        while at < end:
            k = at // _CHUNK
            if k not in self._held:
                if len(self._held) >= 4:
                    self._held.pop(next(iter(self._held)))
                self._held[k] = self._file.read_at(min(_CHUNK, self.size - k * _CHUNK), k * _CHUNK)
            part = self._held[k][at - k * _CHUNK : end - k * _CHUNK]
            out.append(part)
            at += len(part)
        return b"".join(out)

    def find(self, at: int) -> int:
        """Where the next prefix begins, -1 if there is none."""
        while at < self.size:
            found = self.read(at, _CHUNK).find(RESPONSE_PREFIX)
            if found >= 0:
                return at + found
            at += _CHUNK - len(RESPONSE_PREFIX) + 1
        return -1

    def packed(self, at: int) -> int | None:
        """The length of the body of the response at a place; None if its header is cut off."""
        head = self.read(at, HEAD)
        return struct.unpack_from("<H", head, 12)[0] if len(head) == HEAD else None


def first_response(data: _Bytes, at: int) -> int:
    """Where the first response from `at` on begins if one reads the file from its start; -1 if there is none.

    Looks back over a window that no response can span, follows the headers from each prefix in it, and widens it
    until all these chains come to the same place."""
    window = 2 * LONGEST
    while True:
        low = max(0, at - window)
        text = data.read(low, at - low + len(RESPONSE_PREFIX) - 1)
        places, k = [], text.find(RESPONSE_PREFIX)
        while 0 <= k < at - low:
            places.append(low + k)
            k = text.find(RESPONSE_PREFIX, k + 1)
        after = data.find(at)
        if not places:
            return after
        comes_to: dict[int, int] = {}
        for place in reversed(places):
            packed = data.packed(place)
            end = data.size if packed is None else place + HEAD + packed
            later = bisect_left(places, end)
            comes_to[place] = comes_to[places[later]] if end < at and later < len(places) else data.find(max(at, end))
        if low == 0:
            return comes_to[places[0]]
        ends = set(comes_to.values())
        if places[-1] < at - LONGEST:  # one that began before the window may hold them all
            ends.add(after)
        if len(ends) == 1:
            return ends.pop()
        window *= 2


def responses(data: _Bytes, low: int, high: int, types: frozenset[int] | None = None) -> Iterator[tuple]:
    """offset, control, msg_id, type, body of the responses that end after low and not after high. Bodies are
    inflated where the header says so; a response whose lengths don't agree is left out."""
    at = first_response(data, max(0, low - LONGEST)) if low else data.find(0)
    while 0 <= at < high:
        head = data.read(at, HEAD)
        if len(head) < HEAD:
            return
        control, msg_id, _, kind, packed, size = struct.unpack_from("<BIBHHH", head, 4)
        end = at + HEAD + packed
        if end > high:
            return
        if end > low and (types is None or kind in types):
            body = data.read(at + HEAD, packed)
            if packed != size:
                try:
                    body = zlib.decompress(body)
                except zlib.error:
                    body = None
            if body is not None and len(body) == size:
                yield at, control, msg_id, kind, body
        at = data.find(end)


@dataclass
class _Range(InputPartition):
    path: str
    size: int
    low: int
    high: int


def _ranges(path: str, size: int, low: int, high: int, step: int) -> list[_Range]:
    return [_Range(path, size, a, min(a + step, high)) for a in range(low, high, step)]


def _read(uri: str, part: _Range, types: frozenset[int] | None) -> Iterator[pa.RecordBatch]:
    system, _ = _at(uri)
    rows, size = [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)

    for row in responses(_Bytes(system, part.path, part.size), part.low, part.high, types):
        rows.append((part.path, *row))
        size += len(row[-1])
        if size >= _BATCH_BYTES or len(rows) >= _BATCH_ROWS:
            yield batch()
            rows, size = [], 0
    if rows:
        yield batch()


class _Batch(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self._uri, self._step, self._types = options["path"], int(options.get("rangebytes", RANGE_BYTES)), None

    def pushFilters(self, filters):
        """Tests of `type` against values are done here; Spark does the others."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("type",):
                values = {f.value}
            elif isinstance(f, In) and f.attribute == ("type",):
                values = set(f.value)
            else:
                if not (isinstance(f, IsNotNull) and f.attribute == ("type",)):
                    yield f
                continue
            self._types = frozenset(values if self._types is None else self._types & values)

    def partitions(self):
        return [r for path, size in _files(self._uri).items() for r in _ranges(path, size, 0, size, self._step)] or [_Range("", 0, 0, 0)]

    def read(self, part: _Range):
        return _read(self._uri, part, self._types) if part.size else iter(())


class _Stream(DataSourceStreamReader):
    """Files only grow or come new; an offset says how much of each has been read. A response that is not whole yet is
    read once it is."""

    def __init__(self, options: dict[str, str]):
        self._uri, self._step = options["path"], int(options.get("rangebytes", RANGE_BYTES))

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        return {"files": json.dumps(_files(self._uri), sort_keys=True)}

    def partitions(self, start: dict, end: dict):
        before, now = json.loads(start["files"]), json.loads(end["files"])
        return [r for path, size in now.items() for r in _ranges(path, size, before.get(path, 0), size, self._step)]

    def read(self, part: _Range):
        return _read(self._uri, part, None)


@dataclass
class _Written(WriterCommitMessage):
    name: str


class _Writer(DataSourceWriter):
    """Each task writes the bytes of column data into one file, which gets its name at the commit."""

    def __init__(self, options: dict[str, str], schema, overwrite: bool):
        self._uri, self._overwrite, self._id = options["path"], overwrite, uuid.uuid4().hex
        self._column = schema.fieldNames().index("data")

    def write(self, rows):
        system, folder = _at(self._uri)
        system.create_dir(folder, recursive=True)
        name = f"{self._id}-{TaskContext.get().taskAttemptId():08d}.responses"
        with system.open_output_stream(f"{folder}/.{name}", compression=None) as out:
            for row in rows:
                if row[self._column] is not None:
                    out.write(bytes(row[self._column]))
        return _Written(name)

    def commit(self, messages):
        system, folder = _at(self._uri)
        if self._overwrite:
            for path in _files(self._uri):
                system.delete_file(path)
        for m in messages:
            if m is not None:
                system.move(f"{folder}/.{m.name}", f"{folder}/{m.name}")

    def abort(self, messages):
        system, folder = _at(self._uri)
        for m in messages:
            if m is not None:
                system.delete_file(f"{folder}/.{m.name}")


class Responses(DataSource):
    """Format "responses". Options: path, a file or folder; rangebytes, the most bytes of a task."""

    @classmethod
    def name(cls) -> str:
        return "responses"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options, schema, overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to the session, and lets it take filters."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Responses)
