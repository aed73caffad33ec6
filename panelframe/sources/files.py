"""Files of the shared store from within tasks, by Arrow's file systems; written whole or not at all."""

from __future__ import annotations

import uuid

import pyarrow.fs as pafs


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """(file system, path) of a path or URI."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def read(fs: pafs.FileSystem, path: str) -> bytes | None:
    """The file's bytes, None if it is not there."""
    if fs.get_file_info(path).type != pafs.FileType.File:
        return None
    with fs.open_input_stream(path) as f:
        return f.read()


def put(fs: pafs.FileSystem, path: str, data: bytes) -> None:
    """Write a file under another name, then give it its own: readers never see half of it."""
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    other = f"{path}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(other) as f:
        f.write(data)
    fs.move(other, path)
