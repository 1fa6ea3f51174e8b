"""Files written and read by Python workers, on any file system that pyarrow knows; bytes as they are, whatever a name ends with."""

from __future__ import annotations

from typing import BinaryIO

from pyarrow import fs


def _resolved(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def create(uri: str) -> BinaryIO:
    """A stream to a new file; its folder is made if missing."""
    store, path = _resolved(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    return store.open_output_stream(path, compression=None, buffer_size=1 << 20)


def open_stream(uri: str) -> BinaryIO:
    store, path = _resolved(uri)
    return store.open_input_stream(path, compression=None, buffer_size=1 << 20)


def open_seekable(uri: str) -> BinaryIO:
    store, path = _resolved(uri)
    return store.open_input_file(path)
