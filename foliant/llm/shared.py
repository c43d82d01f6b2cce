"""The folder that driver and executors share, and files in it."""

from __future__ import annotations

import uuid

from ..shared import fresh, remove, shared_dir, written

__all__ = ["filesystem", "fresh", "put", "remove", "shared_dir", "written"]


def filesystem(uri: str):
    """A pyarrow file system and the path in it; for file:, hdfs:, s3: and gs: URIs."""
    import pyarrow.fs as fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def put(uri: str, parts) -> None:
    """Writes a file under another name, then moves it: a lost or repeated task leaves no half file."""
    store, path = filesystem(uri)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    half = f"{path}.{uuid.uuid4().hex}.part"
    with store.open_output_stream(half) as out:
        for part in parts:
            out.write(part)
    store.move(half, path)
