"""Files as tasks see them: opened, and put in place, by the system where they are local or mounted, else by Arrow's file systems."""

from __future__ import annotations

import re
import uuid
from pathlib import PurePosixPath

from pyarrow import fs


def store_of(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a name with or without scheme, and the path in it."""
    if re.match(r"file:|/", uri):
        return fs.LocalFileSystem(), re.sub(r"^file:/*", "/", uri)
    return fs.FileSystem.from_uri(uri)


def open_file(uri: str):
    """A file opened for reading at any place."""
    store, path = store_of(uri)
    return store.open_input_file(path)


def put_file(folder: str, name: str, content: bytes) -> None:
    """Write a file below ``folder``; it appears under its name when it is whole.  A name that leaves the folder raises."""
    parts = PurePosixPath(name).parts
    if not parts or name.startswith("/") or ".." in parts:
        raise ValueError(f"{name} leaves {folder}")
    store, base = store_of(folder.rstrip("/"))
    parent = "/".join([base, *parts[:-1]])
    store.create_dir(parent, recursive=True)
    side = f"{parent}/.{parts[-1]}.{uuid.uuid4().hex}.tmp"
    with store.open_output_stream(side) as out:
        out.write(content)
    store.move(side, f"{parent}/{parts[-1]}")
