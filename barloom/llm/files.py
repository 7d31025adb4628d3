"""Files that tasks write to and read from the folder that driver and executors share, by its URI."""

from __future__ import annotations

import uuid
from urllib.parse import urlsplit

from pyarrow import fs


def at(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI and the path on it; a URI without a scheme is a local path."""
    if not urlsplit(uri).scheme:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


class Replacing:
    """Writes a file under a name of its own and moves it to its place once it is whole, so that a task that
    is lost leaves nothing half-written there and one that runs again just writes it anew."""

    def __init__(self, uri: str):
        self._fs, self._path = at(uri)
        self._own = f"{self._path}.{uuid.uuid4().hex}.part"
        self._fs.create_dir(self._path.rpartition("/")[0], recursive=True)
        self._out = self._fs.open_output_stream(self._own)

    def write(self, data: bytes) -> None:
        self._out.write(data)

    def close(self) -> None:
        self._out.close()
        self._fs.move(self._own, self._path)


def read_range(uri: str, offset: int, length: int) -> bytes:
    """Bytes of a file from offset; reads no others."""
    system, path = at(uri)
    with system.open_input_file(path) as f:
        return f.read_at(length, offset)


def read_whole(uri: str) -> bytes:
    system, path = at(uri)
    with system.open_input_file(path) as f:
        return f.readall()
