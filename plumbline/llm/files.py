"""Files that tasks write to shared storage under temporary names and then rename."""

from __future__ import annotations

import uuid

from pyarrow import fs
from pyspark import TaskContext


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI or path, and the path in it."""
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def commit_file(folder: str, name: str, content: bytes) -> None:
    """Write a whole file, so that its final name only ever shows complete content.

    Attempts of one task write equal content, so it does not matter whose rename comes last.
    """
    store, path = open_store(folder)
    store.create_dir(path, recursive=True)
    task = TaskContext.get()
    attempt = f"{task.taskAttemptId()}-" if task else ""
    temporary = f"{path}/_temporary-{name}-{attempt}{uuid.uuid4().hex}"
    with store.open_output_stream(temporary) as out:
        out.write(content)
    store.move(temporary, f"{path}/{name}")


def read_file(folder: str, name: str) -> bytes:
    """A whole file."""
    store, path = open_store(folder)
    with store.open_input_file(f"{path}/{name}") as f:
        return f.read()
